"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words, all of them. Each passage is encoded as surface
statistics; a gated attention head, softmax over w . (tanh(V h) * sigmoid(U h)), weighs the passages, and
a logistic layer scores the weighted passage. V, U, w and the layer are learned together from document
labels only, on a bounded sample of labelled, not held-out rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.llm.common import held_out, training_rows, written
from regolith.llm.wordstream import Words, chunks

PASSAGE_WORDS = 64
MAX_TRAINING_ROWS = 6_000
#: Most passages of all training texts together, half of them of either class: texts that do not fit are left out as a whole.
MAX_TRAINING_PASSAGES = 200_000
#: Words of a long text that are encoded at a time, a multiple of the passage size.
PIECE_WORDS = 1 << 18
HIDDEN = 12
THRESHOLD = 0.3

_CLASSES = np.full(256, 8, dtype=np.int64)  # other punctuation and controls
_CLASSES[[0x20, *range(0x09, 0x0E)]] = 0
_CLASSES[ord("a") : ord("z") + 1] = 1
_CLASSES[ord("A") : ord("Z") + 1] = 2
_CLASSES[ord("0") : ord("9") + 1] = 3
_CLASSES[[ord(c) for c in ".,;:"]] = 4
_CLASSES[[ord(c) for c in "!?"]] = 5
_CLASSES[[ord(c) for c in "|#$%&*@^~<>{}[]\\/_=+"]] = 6
_CLASSES[0x80:] = 7
_VOWELS = np.zeros(256, dtype=np.int64)
_VOWELS[[ord(c) for c in "aeiouyAEIOUY"]] = 1
FEATURES = 20


def passages(texts: list[bytes], size: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and how many each text has (one, of zeros, without words)."""
    w = Words(texts)
    if len(w.starts) > PIECE_WORDS:  # bounds the work space: a long text comes in pieces of whole passages
        if len(texts) > 1:
            parts = [passages([t], size) for t in texts]
            return np.vstack([x for x, _ in parts]), np.concatenate([per for _, per in parts])
        step = max(PIECE_WORDS // size, 1) * size
        cuts = [w.data[w.starts[i] : w.ends[min(i + step, len(w.starts)) - 1]] for i in range(0, len(w.starts), step)]
        x = np.vstack([passages([c], size)[0] for c in cuts])
        return x, np.array([len(x)])
    per = np.maximum(-(-w.counts // size), 1)
    bag = np.repeat(np.arange(len(texts)), per)
    x = np.zeros((len(bag), FEATURES))
    n = len(w.starts)
    if not n:
        return x, per
    begin = np.concatenate(([0], np.cumsum(per)[:-1]))
    owner = w.owner()
    within = np.arange(n) - w.first[owner]
    place = begin[owner] + within // size
    words = np.bincount(place, minlength=len(bag)).astype(float)
    cum = np.zeros((10, len(w.buf) + 1), dtype=np.int32)
    kinds = _CLASSES[w.buf]
    for k in range(9):
        np.cumsum(kinds == k, out=cum[k, 1:])
    np.cumsum(_VOWELS[w.buf], out=cum[9, 1:])
    of_word = (cum[:, w.ends] - cum[:, w.starts]).astype(float)  # by class, of each word
    length = (w.ends - w.starts).astype(float)
    total = lambda v: np.bincount(place, v, len(bag))
    some, chars = np.maximum(words, 1), np.maximum(total(length), 1)
    for k in range(1, 9):
        x[:, k - 1] = total(of_word[k]) / chars
    x[:, 8] = total(of_word[9]) / chars
    x[:, 9] = total(length) / some / 10
    x[:, 10] = np.sqrt(np.maximum(total(length**2) / some - (total(length) / some) ** 2, 0)) / 10
    h = w.hashes()
    again = np.zeros(n)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    x[:, 11] = total(again) / some
    order = np.lexsort((h, place))
    fresh = np.ones(n)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (place[order][1:] != place[order][:-1])
    x[:, 12] = np.bincount(place[order], fresh, len(bag)) / some
    letters = of_word[1] + of_word[2] + of_word[7]
    x[:, 13] = total(letters == 0) / some
    x[:, 14] = total((of_word[2] == letters) & (of_word[2] > 1)) / some
    x[:, 15] = total(of_word[6] > 0) / some
    x[:, 16] = total(of_word[5] > 0) / some
    x[:, 17] = total((of_word[2] > 0) & (_CLASSES[w.buf[w.starts]] == 2)) / some
    x[:, 18] = total(length > 20) / some
    x[:, 19] = np.log1p(words) / 5
    return x, per


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    v: np.ndarray
    u: np.ndarray
    attend: np.ndarray
    layer: np.ndarray
    bias: float

    def score(self, x: np.ndarray, per: np.ndarray) -> np.ndarray:
        """One score for each bag of per[i] consecutive passages."""
        h = (x - self.mean) / self.scale
        gate = np.tanh(h @ self.v) / (1 + np.exp(-np.clip(h @ self.u, -30, 30)))
        a, _ = _softmax(gate @ self.attend, per)
        z = np.add.reduceat(a[:, None] * h, np.concatenate(([0], np.cumsum(per)[:-1])), axis=0)
        return 1 / (1 + np.exp(-np.clip(z @ self.layer + self.bias, -30, 30)))


def _softmax(s: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Softmax within consecutive groups, and the group of each member."""
    begin = np.concatenate(([0], np.cumsum(per)[:-1]))
    group = np.repeat(np.arange(len(per)), per)
    e = np.exp(s - np.maximum.reduceat(s, begin)[group])
    return e / np.add.reduceat(e, begin)[group], group


def fit(x: np.ndarray, per: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, steps: int = 400, rate: float = 0.03, decay: float = 1e-3, seed: int = 3) -> Model:
    """Full-batch Adam on the log loss, both classes weighed alike."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    h = (x - mean) / scale
    begin, d = np.concatenate(([0], np.cumsum(per)[:-1])), x.shape[1]
    p = {"v": rng.normal(0, 0.2, (d, hidden)), "u": rng.normal(0, 0.2, (d, hidden)), "a": rng.normal(0, 0.2, hidden), "w": np.zeros(d), "b": np.zeros(1)}
    first, second = ({k: np.zeros_like(q) for k, q in p.items()} for _ in range(2))
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for t in range(1, steps + 1):
        th, sg = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-np.clip(h @ p["u"], -30, 30)))
        gate = th * sg
        a, group = _softmax(gate @ p["a"], per)
        z = np.add.reduceat(a[:, None] * h, begin, axis=0)
        out = 1 / (1 + np.exp(-np.clip(z @ p["w"] + p["b"][0], -30, 30)))
        g = weight * (out - y)
        # the loss reaches a passage's attention through its share of the bag
        part = (h @ p["w"]) * g[group]
        ds = a * (part - np.add.reduceat(a * part, begin)[group])
        dg = ds[:, None] * p["a"]
        grads = {"v": h.T @ (dg * sg * (1 - th**2)), "u": h.T @ (dg * th * sg * (1 - sg)), "a": gate.T @ ds, "w": z.T @ g, "b": np.array([g.sum()])}
        for k, q in p.items():
            gr = grads[k] + (decay * q if k != "b" else 0)
            first[k] = 0.9 * first[k] + 0.1 * gr
            second[k] = 0.999 * second[k] + 0.001 * gr**2
            q -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, p["v"], p["u"], p["a"], p["w"], float(p["b"][0]))


def taken_texts(sizes: list[tuple[int, int, int]], most: int) -> list[int]:
    """Keys of the texts (key, label, passages) that are learned from: each class in the order of the keys, up to half of the passages.

    A text that does not fit is passed over and the next one tried; the smallest of a class is taken in any case.
    """
    keys: set[int] = set()
    for label in (0, 1):
        own = [(k, n) for k, y, n in sizes if y == label]
        left = most // 2
        for k, n in own:
            if n <= left:
                keys.add(k)
                left -= n
        if own and left == most // 2:
            keys.add(min(own, key=lambda x: (x[1], x[0]))[0])
    return sorted(keys)


def learn(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, most_passages: int = MAX_TRAINING_PASSAGES) -> Model:
    """Fits the model on at most about max_rows labelled, not held-out rows, and at most about most_passages of their passages.

    Passages of the sample are encoded by the tasks, all of a text; the driver gets numbers only. With one
    class alone, or no labels, every text scores alike: near that class, or 0.5.
    """

    def encode(batches):
        for rows in chunks(batches):
            x, per = passages([r[-1] for r in rows])
            begin = np.concatenate(([0], np.cumsum(per)[:-1]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array(per, pa.int64()),
                    pa.array([x[b : b + n].ravel() for b, n in zip(begin, per, strict=True)], pa.list_(pa.float64())),
                ],
                names=["doc_id", "label", "n", "x"],
            )

    sample = training_rows(documents, labels, "quality", max_rows)
    encoded = written(sample.select("doc_id", "label", F.col("text").cast("binary").alias("data")).mapInArrow(encode, "doc_id long, label int, n long, x array<double>"), "encoded")
    encoded = encoded.withColumn("key", F.xxhash64("doc_id", F.lit(29)))
    sizes = encoded.select("key", "label", "n").orderBy("key", "n").collect()  # max_rows numbers
    keys = taken_texts([(r["key"], r["label"], r["n"]) for r in sizes], most_passages)
    chosen = encoded.sparkSession.createDataFrame([(k,) for k in keys], "key long")
    rows = encoded.join(F.broadcast(chosen), "key", "left_semi").select("doc_id", "label", "x").collect() if keys else []
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    y = np.array([r["label"] for r in rows], dtype=float)
    if len(set(y.tolist())) < 2:
        zero = np.zeros(FEATURES)
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(zero, zero + 1, np.zeros((FEATURES, 1)), np.zeros((FEATURES, 1)), np.zeros(1), zero, float(np.log(share / (1 - share))))
    x = [np.array(r["x"]).reshape(-1, FEATURES) for r in rows]
    return fit(np.vstack(x), np.array([len(b) for b in x]), y)


def score_quality(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (score >= threshold), from all passages of the whole text.

    A text that is null or has no words is one passage of zeros. Repeated rows are kept, a null doc_id
    stays null and is not held out; further columns are ignored.
    """

    def run(batches):
        for rows in chunks(batches):
            s = model.score(*passages([r[-1] for r in rows]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text.alias("data")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )
