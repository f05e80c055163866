"""Page and vector operators: exact round trips, planted articles and brute force."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from regolith.llm import html_text, topk, warc

PAGES = "page_id long, url string, html string"
ROWS = [
    (3, "http://a.example/1", "<p>same</p>"), (1, "http://a.example/2", "<p>same</p>"), (7, None, None), (8, "http://b/ x\r\ny", ""),
    (2, "http://c/é", "ünï\r\n\r\ncode " * 3000), (9, "http://d", "WARC/1.1\r\n\r\nfake"), (None, "http://e", "<p>same</p>"), (None, "http://f", "alone"), (1, "http://a.example/2", "<p>same</p>"),
]


def brute_warc(rows):
    data = [(h or "").encode() for _, _, h in rows]
    first = {}
    for (p, _, _), d in zip(rows, data, strict=True):
        if p is not None:
            first[d] = min(p, first.get(d, p))
    return Counter(
        (p, len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), "response" if first.get(d) == p else "revisit", None if first.get(d) == p else first.get(d))
        for (p, _, _), d in zip(rows, data, strict=True)
    )


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(ROWS, PAGES).selectExpr("*", "'x' AS path", "'y' AS offset")
    got = warc.round_trip(pages).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == brute_warc(ROWS)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_payloads_and_ranges(spark):
    rng = random.Random(0)
    rows = [(i, f"http://x/{i}", "z" * rng.randint(0, 3000) + str(i)) for i in range(200)]
    index = warc.write_archives(spark.createDataFrame(rows, PAGES), archive_bytes=2_000)
    assert index.select("path").distinct().count() > 4
    some = warc.read_records(index.where("page_id % 7 = 0")).collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in some} == {i: h for i, _, h in rows if i % 7 == 0}
    small = warc.write_archives(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], PAGES), least_bytes=3)
    assert {r["page_id"]: r["record_type"] for r in warc.read_records(small).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_coalesced_ranges():
    got = list(warc.coalesced([(0, 10), (12, 5), (100, 10), (105, 50)], gap=5, most=60))
    assert got == [(0, 17, [(0, 10), (12, 5)]), (100, 155, [(100, 10), (105, 50)])]
    assert [r for _, _, x in warc.coalesced([(i * 10, 10) for i in range(9)], most=30) for r in x] == [(i * 10, 10) for i in range(9)]


ARTICLE = "<article><h1>Title &amp; more</h1><p>First para with  some\n words and an <a href='/x'>inline link</a> inside.<br>Next line<p><b>Unclosed bold text, long enough to count.<p>Short.</p></article>"
WANT = "Title & more First para with some words and an inline link inside. Next line Unclosed bold text, long enough to count. Short."


def page(body, tail="</body></html>"):
    return "<!DOCTYPE html><html><head><title>T</title><style>p{x:'</p>'}</style><script>var a='<p>no</p>';</script></head><body>" + body + tail


def test_articles_without_boilerplate():
    nav = "<nav><ul>" + "".join(f"<li><a href='/{i}'>menu {i}</a></li>" for i in range(9)) + "</ul></nav>"
    ad = "<!-- ad --><div class='ad'>Buy a thing, a long advert text that goes on and on, so that it is dense. " + "Really. " * 20 + "</div>"
    foot = "<footer>&copy; someone, with a fairly long line of legal text that is dense too.</footer>"
    comments = "<section id='comments'><p>" + "I think this is wrong. " * 20 + "</p></section><form><label>Name</label><input></form>"
    cookie = "<div class='cookie-notice'>We use cookies. " * 3 + "</div>"
    for body, tail in [(nav + ad + ARTICLE + foot, ""), (nav + ARTICLE + comments + cookie + foot, "</body></html>"), ("<aside>" + "side " * 50 + "</aside>" + ARTICLE, "</body>"), (ad + ARTICLE, "</bo")]:
        assert html_text.main_text(page(body, tail)) == WANT
    divs = "<div class='nav2'>" + nav + "</div><div id='main'><div><div class='t'>" + "".join(f"<p>Paragraph {i} of the text.</p>" for i in range(5)) + "</div></div></div>"
    assert html_text.main_text(page(divs)) == " ".join(f"Paragraph {i} of the text." for i in range(5))


def test_articles_in_several_containers():
    words = lambda n, k: "".join("<p>" + f"word{i} " * (n // 6) + "</p>" for i in range(k))
    items = "<ul>" + "".join(f"<li>{'item ' * 16}{i}</li>" for i in range(30)) + "</ul>"
    cells = "<table>" + "<tr><td>some text of a cell</td><td>and of its neighbour</td></tr>" * 10 + "</table>"
    nav = "<nav><ul>" + "<li><a href='/'>menu</a></li>" * 9 + "</ul></nav>"
    for inner in (
        "".join(f"<section><h2>Head {i}</h2>{words(300, 6)}</section>" for i in range(3)), f"<section>{words(200, 8)}</section>" * 2,
        words(250, 3) + items, words(250, 3) + cells, words(250, 3) + f"<blockquote>{words(200, 5)}</blockquote>" + words(100, 2),
    ):
        art = f"<article><h1>A title</h1>{inner}</article>"
        want = " ".join(html_text.blocks(html_text.parse(art)))
        assert html_text.main_text(page(nav + art + "<div><p>Short note</p></div><footer>legal</footer>")) == want


def test_names_that_only_begin_like_boilerplate():
    words = "".join(f"<p class='{c}'>{'Some words of the story. ' * 9}{c}.</p>" for c in ("related-works", "share-story", "side-by-side", "footer-note", "comment-text", "x"))
    nav = "<div class='menu-top'>" + "<a href='/'>menu</a> " * 9 + "</div>"
    art = f"<article><h1>A title</h1>{words}<div class='side-by-side'><p>{'And more of it. ' * 9}</p></div></article>"
    want = " ".join(html_text.blocks(html_text.parse(art)))
    assert want.count("words of the story") == 54 and "And more of it." in want
    assert html_text.main_text(page(nav + art + "<div class='comment-list'><p>" + "I disagree with it. " * 40 + "</p></div>")) == want


ORDINARY = "social-science share-price notice-board side-by-side header-image-story related-works comment-thread-analysis ad-free banner-story promo-article advertising-history sidebarred menu-of-the-day notice social share side".split()


@pytest.mark.parametrize("name", ORDINARY)
def test_content_of_any_name(name):
    paragraphs = [f"Paragraph {i} tells some more of the story, at length." for i in range(6)]
    inner = "".join(f"<p>{p}</p>" for p in paragraphs)
    nav = "<nav><ul>" + "<li><a href='/'>menu</a></li>" * 9 + "</ul></nav>"
    foot = "<footer>&copy; someone, with a fairly long line of legal text that is dense too.</footer>"
    for body in (f"<div class='{name}'>{inner}</div>", f"<div id='{name}'><h1>T</h1>{inner}</div>", f"<article>{inner.replace('<p>', f'<p class={name}>')}</article>", f"<main><div class='{name}'>{inner}</div></main>"):
        want = " ".join((["T"] if "<h1>" in body else []) + paragraphs)
        assert html_text.main_text(page(nav + body + foot)) == want, body


def test_attributes_as_browsers_read_them():
    for tag in ("<p title=\"x>", "<p class=it's>", "<p class=it's title='a > b'>", "<p a=b\"c d='e'>", "<p =x>", "<p/x=1/>", "<p a = 'b>c'>", "<p\n\ta\n=\n\"</p>\">"):
        assert html_text.main_text(f"<body>{tag}Hello there.</body>") == "Hello there.", tag
    assert html_text.main_text("a<!-->b<!--->c<!-- x --!>d</>e</ x>f") == "abcdef"
    assert html_text.main_text("one <p title='x") == "one"


def test_named_boilerplate_in_an_article():
    body = "<article><h1>T</h1><p>" + "Some words of the story. " * 9 + "</p><div class='ad-slot'>Buy a thing.</div><p class='share'><a href=x>Share</a> <a href=y>Post</a></p><div class=comments>" + "No. " * 200 + "</div></article>"
    assert html_text.main_text(page(body)) == "T " + ("Some words of the story. " * 9).strip()


def test_planted_articles_in_any_page():
    """Random pages: the article's text is known before its markup is made."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    for _ in range(60):
        parts, inner = [line(rng.randint(3, 8))], ""
        inner += f"<h1>{parts[0]}</h1>"
        for _ in range(rng.randint(2, 8)):
            text = line(rng.randint(30, 90))
            parts.append(text)
            w = text.split()
            w[3] = rng.choice([f"<b>{w[3]}</b>", f"<a href='/{w[3]}'>{w[3]}</a>", f"<img src=x>{w[3]}", w[3]])
            inner += rng.choice(["<p>{}</p>", "<p>{}", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</ul>", "<div>{}</div>"]).format(rng.choice([" ", "\n  "]).join(w))
        nav = "<nav><ul>" + "".join(f"<li><a href='/{word()}'>{word()}</a>" for _ in range(rng.randint(1, 9))) + "</ul></nav>"
        aside = rng.choice(["<aside>{}</aside>", "<div id=sidebar>{}</div>", "<div class='ad'>{}</div>", "<section class=comments><p>{}</p></section>"]).format(line(rng.randint(5, 60)))
        shell = rng.choice(["<article>{}</article>", "<main><div>{}</div></main>", "<div id=content>{}</div>", f"<div class='{rng.choice(ORDINARY)}'>{{}}</div>"]).format(inner)
        got = html_text.main_text(page(nav + (aside + shell if rng.random() < 0.5 else shell + aside) + f"<footer>{line(9)}</footer>"))
        assert got == " ".join(parts)


def test_parsing_takes_time_in_proportion():
    import time

    def took(n):
        began = time.perf_counter()
        for text in ("<i>" * n + "</b>" * n, "<b><div>" + "<i>" * n + "</b>" * n, "<p>" + "<i>" * n + "<div>" * n, "<ul>" + "<li><i>" * n):
            html_text.parse(text)
        return time.perf_counter() - began

    took(500)
    assert took(16_000) < 60 * max(took(1000), 0.005)


def test_html_edges(spark):
    assert html_text.main_text("") == "" and html_text.main_text("<html><body></body></html>") == ""
    assert html_text.main_text("plain words, a < b") == "plain words, a < b"
    assert html_text.main_text("<p>one<p>two &lt;b&gt; &#233;&nbsp;x") == "one two <b> é x"
    deep = "<div>" * 5000 + "text" + "</div>" * 4000
    assert html_text.main_text(deep) == "text"
    assert html_text.main_text("<body><script>var x = 1;") == ""
    rows = [(1, "u", page(ARTICLE)), (2, None, None), (None, "v", ""), (1, "u", page(ARTICLE))]
    got = html_text.extract(spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS text", "2 AS n_chars")).collect()
    assert Counter(tuple(r) for r in got) == Counter([(1, "u", WANT, len(WANT)), (2, None, "", 0), (None, "v", "", 0), (1, "u", WANT, len(WANT))])
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, 12)], 0) for i in range(700)]
    vectors += [(1000 + i, vectors[5][1], 0) for i in range(40)]  # ties
    vectors += [(2000, None, 0), (2050, [1.0, None], 0), (2100, [float("nan")] * 12, 0), (2150, [float("inf")] * 12, 0), (2200, [0.5], 0), (None, vectors[1][1], 0), (50, vectors[9][1], 0), (2250, [], 0)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS v", "'y' AS score")
    monkeypatch.setattr(topk, "BLOCK", 200)
    monkeypatch.setattr(topk, "BATCH_BYTES", 2000)
    monkeypatch.setattr(topk, "SAMPLE", 60)
    got = {}
    for r in topk.top_k(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ints = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queries = {i for i, _ in ints if i % 50 == 0} - {50}
    for q in queries:
        x = next(v for i, v in ints if i == q)
        best = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in ints if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)], q
    assert set(got) == queries | {50}
    assert topk.top_k(df.where("vec_id = 7")).count() == 0 and topk.top_k(df.where("vec_id = 100")).count() == 0


def searched(q, q_ids, x, ids, p, k=5, block=500):
    state = topk.Search(q_ids, q, topk.distances(q, p), k)
    for at in range(0, len(x), block):
        state.block(ids[at : at + block], x[at : at + block], topk.distances(x[at : at + block], p))
    found = {}
    for i, v, s in state.found():
        found.setdefault(i, []).append((-s, v))
    return found, state.seen


def test_pivots_eliminate():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 200, (20, 16))
    x = np.floor(centres[np.sort(rng.integers(0, 20, 3000))] + rng.normal(0, 8, (3000, 16))).astype(np.int64)
    found, evaluated = searched(x[::150], np.arange(3000)[::150], x, np.arange(3000), topk.spread(x, 32))
    for i in range(0, 3000, 150):
        assert found[i] == sorted((-int(x[i] @ b), j) for j, b in enumerate(x) if j != i)[:5]
    assert evaluated < 20 * 3000 / 4
    big = np.floor(rng.normal(0, 2**40, (50, 4))).astype(np.int64)
    found, _ = searched(big[:1], np.arange(1), big, np.arange(50), topk.spread(big, 3))
    assert found[0] == sorted((-sum(int(a) * int(b) for a, b in zip(big[0], v)), j) for j, v in enumerate(big) if j)[:5]


def test_unclustered_vectors():
    """No clusters: pivots rule out little, yet results hold and the scan ends early where bounds allow."""
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(0, 40, (2000, 24))).astype(np.int64)
    x[::3] //= 9  # short ones are ruled out by their norms
    found, evaluated = searched(x[::100], np.arange(2000)[::100], x, np.arange(2000), topk.spread(x, 32))
    for i in range(0, 2000, 100):
        assert found[i] == sorted((-int(x[i] @ b), j) for j, b in enumerate(x) if j != i)[:5]
    assert evaluated < 20 * 2000
    floors = topk._floors(np.arange(0, 2000, 100), x[::100], np.arange(2000)[::7], x[::7], 5)
    assert all(f <= -found[i][4][0] for f, i in zip(floors, range(0, 2000, 100), strict=True))
