"""Toxicity scores from a weighted finite-state pattern grammar.

The tokens of a clause (text between . ! ? ; and line ends) become symbols by a lexicon: I insult of the seed
list, S insult that labelled texts have shown to be one, H threat, T target, N negation, R reported speech, Q quotation
mark, O other. Five weighted transducers rewrite the symbols, each reading what the one before has written:

* negation: N opens a scope of NEGATION_SPAN tokens in which insults and threats are scaled down
* report:   R opens a scope to the clause's end, Q one to the closing mark, in which they are scaled down
* target:   tells insults and threats by the T of their clause: near (within AIM_SPAN tokens), far or none;
            for a T that is still to come it guesses, and a guess that no T fulfils leads to no final state
* insult:   makes hits of insults, of aimed ones with more weight; a seed without a target needs company, another
            insult or threat in its clause (it guesses, as target does, and drops what stays alone)
* threat:   makes hits of threats that have a target; a threat without one is dropped

compose() joins them to one machine; the weight of a clause is that of its best path: the sum of the lexicon
weights of its hits, each times the product of the scales on its arc. A logistic model over the matched
clauses of a text, fitted on labelled rows, turns their weights into the score. Clauses whose one insult has
neither target nor company match nothing by themselves: they count only where a text has two of them or a matched
one. So no seed decides alone; what labels prove does, for they mark texts that have nothing else.

The insult lexicon is induced from labelled texts: whole tokens and token stems of 4 to 8 letters that
(nearly) only toxic texts hold, more often than chance gives any of so many candidates, and in many
different contexts (that of a token's first occurrence in each text); it is joined with a small seed list.
A stem has to be that of STEM_TOKENS different tokens, seeds apart, so no seed's beginning becomes one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.llm.common import held_out, training_rows, written
from regolith.llm.wordstream import chunks

#: Seed words of the grammar.
SEED_INSULTS = "idiot moron stupid loser pathetic worthless scum trash clown disgusting imbecile dumbass bastard".split()
SEEDS = frozenset(SEED_INSULTS)
THREATS = "kill hurt destroy beat punch stab shoot murder töten tuer matar".split()
TARGETS = "you your you're u he she they them him her these those du ihr tu toi vous tú usted ustedes".split()
NEGATIONS = "not no never isn't aren't wasn't don't nicht kein pas jamais nunca".split()
REPORTS = "said says quoted wrote called reported claimed allegedly sagte dit dijo word term wort palabra".split()

MAX_TRAINING_ROWS = 12_000
STEMS = (4, 5, 6, 7, 8)
#: Largest share of non-toxic texts among those that hold a token or stem of the lexicon.
IMPURE = 0.1
NEGATION_SPAN, NEGATION_SCALE = 3, 0.35
REPORT_SCALE = 0.5
AIM_SPAN, AIM_SCALE = 4, 1.5
SEED_WEIGHT = 1.0
#: Different whole tokens that a stem needs behind it.
STEM_TOKENS = 2

_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;\n\"“”«»]")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_END, _QUOTE = frozenset(".!?;\n"), frozenset("\"“”«»")


@dataclass(frozen=True)
class Transducer:
    """Weighted arcs (state, symbol read) -> [(symbol written, scale, next state)], a start and final states."""

    start: object
    arcs: dict
    final: frozenset


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that reads with first and lets second read what first writes; scales are multiplied."""
    start = (first.start, second.start)
    arcs, seen, todo = defaultdict(list), {start}, [start]
    out_of = defaultdict(list)
    for (state, read), ways in first.arcs.items():
        out_of[state].append((read, ways))
    while todo:
        p, q = here = todo.pop()
        for read, ways in out_of[p]:
            for middle, x, to in ways:
                for written_, y, on in second.arcs.get((q, middle), ()):
                    arcs[here, read].append((written_, x * y, (to, on)))
                    if (to, on) not in seen:
                        seen.add((to, on))
                        todo.append((to, on))
    return Transducer(start, dict(arcs), frozenset(s for s in seen if s[0] in first.final and s[1] in second.final))


def best_path(machine: Transducer, symbols: list[tuple[str, float]]) -> float:
    """Weight of the best path over (symbol, lexicon weight): weight times scale, summed over the hits ("!")."""
    front = {machine.start: 0.0}
    for symbol, weight in symbols:
        new: dict = {}
        for state, total in front.items():
            for written_, scale, to in machine.arcs.get((state, symbol), ()):
                value = total + weight * scale if written_ == "!" else total
                if value > new.get(to, -1.0):
                    new[to] = value
        front = new
    return max((v for s, v in front.items() if s in machine.final), default=0.0)


def negation_machine(span: int = NEGATION_SPAN, scale: float = NEGATION_SCALE) -> Transducer:
    """States: tokens left in the scope of a negation."""
    arcs = {}
    for left in range(span + 1):
        on = max(left - 1, 0)
        arcs |= {(left, x): [(x, scale if left and x in "IHS" else 1.0, on)] for x in "IHSTRQO"}
        arcs[left, "N"] = [("O", 1.0, span)]
    return Transducer(0, arcs, frozenset(range(span + 1)))


def report_machine(scale: float = REPORT_SCALE) -> Transducer:
    """States: plain, reported (to the clause's end), quoted (to the closing mark)."""
    arcs = {}
    for state in ("plain", "reported", "quoted"):
        arcs |= {(state, x): [(x, scale if state != "plain" and x in "IHS" else 1.0, state)] for x in "IHSTO"}
        arcs[state, "R"] = [("O", 1.0, "reported")]
        arcs[state, "Q"] = [("O", 1.0, {"plain": "quoted", "quoted": "plain"}.get(state, state))]
    return Transducer("plain", arcs, frozenset(("plain", "reported", "quoted")))


def target_machine(span: int = AIM_SPAN) -> Transducer:
    """Writes insults as A (near a target), B or E, threats as C (near), D (far) or O.

    States: (tokens since the last target up to span, span + 1 if longer ago, 0 if none; what is owed: 0
    nothing, 1..span a target within so many tokens, span + 1 one before the clause ends).
    """
    arcs = {}
    states = [(ago, owed) for ago in range(span + 2) for owed in range(span + 2)]
    for ago, owed in states:
        later = min(ago + 1, span + 1) if ago else 0
        # a token passes: a debt with a term comes nearer, and one that ends here has no way on
        rest = owed - 1 if 0 < owed <= span else owed
        lapsed = owed == 1
        near = 0 < ago <= span
        arcs[(ago, owed), "T"] = [("O", 1.0, (1, 0))]
        if lapsed:
            continue
        here = (later, rest)
        nearer = (later, rest if 0 < rest <= span else span)
        arcs[(ago, owed), "O"] = [("O", 1.0, here)]
        for read, alone in (("I", "B"), ("S", "E")):
            arcs[(ago, owed), read] = [("A", 1.0, here)] if near else [(alone, 1.0, here), ("A", 1.0, nearer)]
        if near:
            arcs[(ago, owed), "H"] = [("C", 1.0, here)]
        else:
            far = ("D", 1.0, here if ago or rest else (later, span + 1))
            arcs[(ago, owed), "H"] = [("C", 1.0, nearer), far] + ([] if ago else [("O", 1.0, here)])
    return Transducer((0, 0), arcs, frozenset(s for s in states if not s[1]))


def hit_machine(scales: dict[str, float], others: str) -> Transducer:
    """One state: the symbols with a scale become hits, the others stay."""
    arcs = {(0, k): [("!", v, 0)] for k, v in scales.items()} | {(0, x): [(x, 1.0, 0)] for x in others}
    return Transducer(0, arcs, frozenset((0,)))


def insult_machine(aimed: float = AIM_SCALE, lone: bool = False) -> Transducer:
    """Hits of insults; states: nothing yet, an untargeted insult that owes the clause another hit, and company.

    With lone, untargeted insults are hits by themselves.
    """
    arcs = {}
    for state in ("none", "owed", "company"):
        arcs[state, "A"] = [("!", aimed, "company")]
        arcs[state, "B"] = [("!", 1.0, "owed" if state == "none" else "company")] + ([("O", 1.0, "none")] if state == "none" else [])
        arcs[state, "E"] = [("!", 1.0, "company")]
        arcs |= {(state, x): [(x, 1.0, "company")] for x in "CD"}
        arcs[state, "O"] = [("O", 1.0, state)]
    return Transducer("none", arcs, frozenset(("none", "company", *(("owed",) if lone else ()))))


def grammar_machine(lone: bool = False) -> Transducer:
    machine = negation_machine()
    for step in (report_machine(), target_machine(), insult_machine(lone=lone), hit_machine({"C": AIM_SCALE, "D": 1.0}, "!O")):
        machine = compose(machine, step)
    return machine


MACHINE, LONE_MACHINE = grammar_machine(), grammar_machine(lone=True)


@dataclass(frozen=True)
class Grammar:
    insults: dict[str, float]
    stems: dict[str, float]
    bias: float = -3.0
    slopes: tuple[float, float, float] = (2.0, 1.0, 1.0)
    roles: dict[str, str] = field(default_factory=lambda: {
        **dict.fromkeys(THREATS, "H"), **dict.fromkeys(TARGETS, "T"), **dict.fromkeys(NEGATIONS, "N"), **dict.fromkeys(REPORTS, "R"),
    })

    def __post_init__(self):
        object.__setattr__(self, "lengths", sorted({len(k) for k in self.stems}))
        object.__setattr__(self, "starts", {*self.insults, *(w for w, role in self.roles.items() if role == "H")})

    def symbol(self, token: str) -> tuple[str, float]:
        """Symbol and weight of a token."""
        weight = max([self.insults.get(token, 0.0), *(self.stems.get(token[:n], 0.0) for n in self.lengths)])
        return ("I" if token in SEEDS else "S", weight) if weight else (self.roles.get(token, "O"), 1.0)

    def touches(self, words) -> bool:
        """Whether any word can start a match, so that most texts need no clause work."""
        return not words.isdisjoint(self.starts) or any(w[:n] in self.stems for n in self.lengths for w in words)


def matches(grammar: Grammar, text: str) -> tuple[list[float], list[float]]:
    """Weights of the matched clauses of a whole text, and of those whose insult has neither target nor company."""
    found, lone, symbols, hot = [], [], [], False

    def close():
        if hot:
            if (w := best_path(MACHINE, symbols)) > 0:
                found.append(w)
            elif (w := best_path(LONE_MACHINE, symbols)) > 0:
                lone.append(w)

    for token in _TOKEN.findall(text.lower()):
        if token in _END:
            close()
            symbols, hot = [], False
        elif token in _QUOTE:
            symbols.append(("Q", 0.0))
        else:
            s = grammar.symbol(token)
            symbols.append(s)
            hot = hot or s[0] in "IHS"
    close()
    return found, lone


def clauses(grammar: Grammar, text: str) -> list[float]:
    """Weights of the clauses of a text that count."""
    found, lone = matches(grammar, text)
    return found + lone if found or len(lone) > 1 else []


def features(grammar: Grammar, text: str) -> tuple[float, float, float]:
    """Log of the summed clause weights, the largest one (it saturates at 4), and the log of the number of matched clauses."""
    words = set(_WORD.findall(text.lower()))
    if not grammar.touches(words):
        return 0.0, 0.0, 0.0
    w = clauses(grammar, text)
    return (float(np.log1p(sum(w))), min(max(w), 4.0), float(np.log1p(len(w)))) if w else (0.0, 0.0, 0.0)


def score(grammar: Grammar, text: str) -> float:
    z = grammar.bias + sum(a * b for a, b in zip(grammar.slopes, features(grammar, text), strict=True))
    return float(1.0 / (1.0 + np.exp(-z)))


def _evidence(batches):
    """Per training text: each candidate token or stem once, with the hash of its first context."""
    for rows in chunks(batches):
        out: Counter = Counter()
        seen = []
        for label, data in rows:
            words = _WORD.findall(data.decode("utf-8", "replace").lower())
            first: dict[str, int] = {}
            for i, w in enumerate(words):
                if w not in first:
                    first[w] = i
            marks: dict[tuple[str, int], int] = {}
            for w, i in first.items():
                context = hash_pair(words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else "")
                marks.setdefault((w, 0), context)
                for n in STEMS:
                    if len(w) > n:
                        marks.setdefault((w[:n], n), context)
            for (w, n), context in marks.items():
                seen.append((w, n, context, label))
        out.update(seen)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.int32()),
                pa.array([k[2] for k in out], pa.int64()), pa.array([v if k[3] else 0 for k, v in out.items()], pa.int64()),
                pa.array([0 if k[3] else v for k, v in out.items()], pa.int64()),
            ],
            names=["unit", "stem", "context", "pos", "neg"],
        )


def hash_pair(a: str, b: str) -> int:
    return zlib.crc32(f"{a}\x00{b}".encode())


def learn(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Grammar:
    """Induce the insult lexicon and fit the score, from at most max_rows labelled, not held-out rows.

    Without labelled rows of both kinds the seed lexicon and default weights are returned.
    """
    sample = written(training_rows(documents, labels, "toxic", max_rows), "toxicsample")
    evidence = (
        sample.select("label", F.col("text").cast("binary").alias("data"))
        .mapInArrow(_evidence, "unit string, stem int, context long, pos long, neg long")
        .groupBy("unit", "stem", "context").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .groupBy("unit", "stem")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count_if(F.col("pos") > 0).alias("contexts"))
    )
    evidence = written(evidence, "evidence")
    tokens = evidence.where((F.col("stem") == 0) & (F.col("pos") > 0) & ~F.col("unit").isin(SEED_INSULTS))
    lengths = F.filter(F.array(*map(F.lit, STEMS)), lambda n: n < F.length("unit"))
    behind = tokens.select("unit", F.explode(lengths).alias("stem")).select(F.expr("left(unit, stem)").alias("unit"), "stem").groupBy("unit", "stem").agg(F.count("*").alias("tokens"))
    units = evidence.where(F.col("pos") + F.col("neg") >= 3).join(behind, ["unit", "stem"], "left").where((F.col("stem") == 0) | (F.col("tokens") >= STEM_TOKENS))
    units = written(units, "units")
    n_units = units.count()
    pos, neg = sample.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if not pos or not neg or not n_units:
        return Grammar({w: SEED_WEIGHT for w in SEED_INSULTS}, {})
    # by chance a unit is in k toxic texts and no other with probability share ** k
    least = max(3, int(np.ceil(np.log(20 * n_units) / np.log((pos + neg) / pos))))
    pure = units.where(
        (F.col("pos") >= least) & (F.col("neg") <= IMPURE * F.col("pos")) & (F.col("contexts") >= 3) & (F.col("contexts") >= 0.3 * F.col("pos"))
    )
    insults, stems = {w: SEED_WEIGHT for w in SEED_INSULTS}, {}
    for r in pure.collect():  # bounded by the sample
        weight = min(2.5, float(np.log((r["pos"] + 0.5) / (r["neg"] + 0.5)) / 2))
        (stems if r["stem"] else insults)[r["unit"]] = weight
    grammar = Grammar(insults, stems)

    def measure(batches):
        for rows in chunks(batches):
            got = [(label, *features(grammar, data.decode("utf-8", "replace"))) for label, data in rows]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*got, strict=True)], names=["y", "a", "b", "c"])

    # equal features are counted together: most texts match nothing
    points = (
        sample.select("label", F.col("text").cast("binary").alias("data"))
        .mapInArrow(measure, "y double, a double, b double, c double")
        .groupBy(F.col("y"), *(F.round(c, 2).alias(c) for c in "abc")).count().orderBy("y", "a", "b", "c").collect()
    )
    data = np.array([[float(v) for v in r] for r in points]).reshape(-1, 5)
    if len(set(data[:, 0])) < 2:
        return grammar
    w = _fit_counted(data[:, 1:4], data[:, 0], data[:, 4])
    return Grammar(insults, stems, float(w[3]), tuple(float(v) for v in w[:3]))


def _fit_counted(x: np.ndarray, y: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Logistic fit over counted points by damped Newton steps, slopes kept at 0 or above."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, pen = np.zeros(4), np.diag([0.05, 0.05, 0.05, 1e-4])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        hess = (x1 * (count * p * (1 - p))[:, None]).T @ x1 + pen + 1e-9 * np.eye(4)
        w = w + np.linalg.solve(hess, x1.T @ (count * (y - p)) - pen @ w) * 0.7
    w[:3] = np.maximum(w[:3], 0)
    return w


def score_toxicity(documents: DataFrame, grammar: Grammar) -> DataFrame:
    """One row per document: doc_id, held_out, score in 0..1, predicted (score >= 0.5), row_key.

    Null and empty texts match nothing and get the score of a clean text; repeated rows are kept,
    a null doc_id stays null and is not held out, and further columns are ignored.
    """

    def run(batches):
        for rows in chunks(batches):
            ids, held, keys, data = zip(*rows, strict=True)
            s = [score(grammar, d.decode("utf-8", "replace")) for d in data]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32()), pa.array(keys, pa.int64())],
                names=["doc_id", "held_out", "score", "predicted", "row_key"],
            )

    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.xxhash64(text).alias("row_key"), text.cast("binary").alias("data")
    ).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, row_key long")


def drop_toxic(documents: DataFrame, grammar: Grammar) -> DataFrame:
    """The documents whose score is below 0.5, with the columns they came with, decided per row; null texts count as empty and stay."""
    names = documents.columns

    def run(batches):
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            yield batch.filter(pa.array([score(grammar, t or "") < 0.5 for t in texts], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
