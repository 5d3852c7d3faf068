"""Word runs, whitening and main texts: brute force, SQL and odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from spanwright.llm import htmltext, periodic, queries, whitening

FOLDER = "/root/testdata/sf0.001"


def plain_runs(words, least, exponent):
    """All stretches in which words ``q`` apart agree; the smallest ``q`` of equal ones."""
    found, n = {}, len(words)
    for q in range(1, n // exponent + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i - q, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (5, 3)])
def test_automaton_finds_all_runs(least, exponent):
    rng = random.Random(least)
    for _ in range(1500):
        n, letters = rng.randint(0, 60), rng.randint(1, 4)
        words = [rng.randrange(letters) for _ in range(n)]
        if rng.random() < 0.5:
            p = rng.randint(1, 6)
            words = [words[i % p] if rng.random() < 0.97 else 0 for i in range(n)]
        assert periodic.runs_of(words, least, exponent) == plain_runs(words, least, exponent)


def test_cuts_lose_no_run():
    rng = random.Random(5)
    for _ in range(300):
        texts = [[rng.randrange(rng.choice([2, 5, 30])) for _ in range(rng.randint(0, 80))] for _ in range(4)]
        words = np.array([w for t in texts for w in t], np.int64)
        owner = np.array([i for i, t in enumerate(texts) for _ in t], np.int64)
        base = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        got = sorted((int(owner[a]), a + s - int(base[owner[a]]), n, q) for a, b in periodic.candidates(words, owner, 6, 4)
                     for s, n, q in periodic.runs_of(words[a:b].tolist(), 6, 4))
        assert got == sorted((i, *r) for i, t in enumerate(texts) for r in plain_runs(t, 6, 4))


def test_long_runs_are_fast():
    assert periodic.runs_of([0] * 200000) == [(0, 200000, 1)]
    assert periodic.runs_of([i % 49999 for i in range(200001)]) == [(0, 200001, 49999)]


def plain_answer(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a, k = h // 10 % n, h // 10 % 8
        p = 1 + (n - a) // (3 + k)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, 6, 4)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def planted_ids(n):
    return [i for i in range(100000) if zlib.crc32(str(i).encode()) % 10 == 0][:n]


def test_odd_texts_and_planted_runs(spark, tmp_path):
    ids = planted_ids(60)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab cd é 日本 x".split()) for _ in range(rng.randint(0, 70)))) for i in ids]
    rows += [(ids[0], None), (ids[1], ""), (ids[2], " \t\n\x0b\x0c\r"), (ids[3], "one"), (None, "a " * 9), (1, None), (2, ""),
             (3, "a a a a " * 8), (4, "na " * 50000), (4, "na " * 50000), (5, "\n".join(["x y z"] * 4)), (-7, "b\x1cb " * 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("k0", "runs", "starts", "words", "n_words")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_word_runs(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(
        plain_answer(i, t) if t is None or len(t) < 1000 else long_answer(i, t) for i, t in rows)
    assert periodic.word_runs(docs.limit(0), ["doc_id", "k0"]).count() == 0
    own = periodic.word_runs(docs.where("doc_id = 4"), ["doc_id", "k0", "runs"][:2]).first()
    assert [tuple(r) for r in own["runs"]] == [(0, 50000, 1)] and own["collapsed"] == "na" and own["n_words"] == 50000


def long_answer(doc_id, text):
    assert text == "na " * 50000 and zlib.crc32(str(doc_id).encode()) % 10
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, 1, 0, 50000, 1, 50000000, sha("0,50000,1\n"), sha("na"))


@pytest.mark.parametrize("name", ["op11_word_runs", "op13_html_text"])
def test_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.SQL[name]) is None


def test_eigenvalues_of_hard_matrices():
    rng = np.random.default_rng(3)
    for d in (1, 2, 3, 5, 40):
        b = rng.standard_normal((d, d + 3))
        a = b @ b.T
        tight = np.diag(1 + 1e-9 * np.arange(d))
        for m in (a, np.eye(d), np.diag(rng.integers(1, 3, d).astype(float)), np.full((d, d), 2.0), a * 0,
                  a * 1e200, a * 1e-200, np.kron(np.eye(2), a), tight):
            k = min(8, len(m))
            values, rows = whitening.leading_components(m, k)
            wide = max(np.abs(m).max(), 1e-300)
            assert np.abs(values - np.linalg.eigvalsh(m)[::-1][:k]).max() <= 1e-12 * len(m) * wide
            assert np.abs(rows @ rows.T - np.eye(k)).max() < 1e-12
            assert np.abs(m @ rows.T - rows.T * values).max() <= 1e-11 * wide


def plain_whitening(vectors, k=8):
    x = np.floor(1024 * vectors).astype(np.int64) + 100000
    n, s = len(x), x.sum(axis=0)
    apart = n * x - s
    v = (apart / n).T @ (apart / n) / n
    e, c = np.linalg.eigh(v)
    e, c = e[::-1][:k], c[:, ::-1][:, :k]
    return n, (apart * apart).sum(axis=1), (apart / n) @ c / np.sqrt(e), e / np.trace(v)


def check_whitening(rows, ids, vectors):
    n, deviation, whitened, explained = plain_whitening(vectors)
    k = whitened.shape[1]
    assert len(rows) == n * k
    got = {(r["vec_id"], r["component"]): r for r in rows}
    table = np.array([[got[i, j + 1]["whitened"] for j in range(k)] for i in ids])
    signs = np.sign((table * whitened).sum(axis=0))
    assert np.abs(table * signs - whitened).max() < 1e-9
    assert [got[i, 1]["deviation"] for i in ids] == deviation.tolist()
    assert max(abs(got[ids[0], j + 1]["explained"] / explained[j] - 1) for j in range(k)) < 1e-12
    assert {r["n"] for r in rows} == {n}
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


def test_whitening_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = queries.op12_whitening(spark, FOLDER).collect()
    check_whitening(got, [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float))


VECTORS = "vec_id long, embedding array<float>, component string, n int, whitened double, id string, v string"


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(x) for x in rng.standard_normal(3).astype(np.float32)]) for i in range(40)]
    odd = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [float("nan"), 0.0, 0.0]), (94, [float("inf"), 0.0, 0.0]), (95, [1.0, 2.0])]
    rows = [(*r, "c", 1, 0.5, "x", "y") for r in [*good, *odd]]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    check_whitening(got, [i for i, _ in good], np.array([v for _, v in good]))
    again = whitening.whiten(spark.createDataFrame(rows[::-1], VECTORS).repartition(2)).collect()
    assert {tuple(r)[:-1] for r in got} == {tuple(r)[:-1] for r in again}
    none = whitening.whiten(spark.createDataFrame(rows[40:45], VECTORS))
    assert none.count() == 0 and none.columns == whitening.whiten(spark.createDataFrame(rows, VECTORS)).columns


def test_without_variance_and_huge(spark):
    flat = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0, float(i % 2)]) for i in range(6)], "vec_id long, embedding array<double>")).collect()
    assert len(flat) == 18
    for r in flat:
        first = r["component"] == 1
        assert (r["whitened"] is not None) == first and r["explained"] == (1.0 if first else 0.0)
        assert r["identity_error"] < 1e-12
    one = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [tuple(r) for r in one] == [(None, 1, 1, 0, None, 0.0, None), (None, 2, 1, 0, None, 0.0, None)]
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [5.0, 3.0])], "vec_id long, embedding array<double>")).collect()
    assert len(huge) == 6 and all(r["deviation"] is None for r in huge if r["vec_id"] != 3)
    x = sorted(r["whitened"] for r in huge if r["component"] == 1)
    assert np.allclose(x, [-1.5 ** 0.5, 0, 1.5 ** 0.5], atol=1e-6)


LONG = "Many words make a paragraph that is long enough, so that its density is high. " * 4
TWO = LONG.strip() + "\n\n" + LONG.strip()
PAGES = {
    "classes": (f"<body><div id=header><h1>Site</h1></div><div class='menu'><a href=1>Home</a></div><div class=content><h1>T</h1>"
                f"<p>{LONG}</p><p>{LONG}</p><p>Short.</p></div><div class='sidebar'><p>{LONG}</p></div><div id=footer>c</div>", f"T\n\n{TWO}\n\nShort."),
    "flat": (f"<body><h1>T</h1><p>{LONG}<p>{LONG}</p><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul><footer>f</footer></body>", f"T\n\n{TWO}"),
    "comments": (f"<main><h1>T</h1><p>{LONG}</p></main><section class=comments><p>{LONG * 5}</p></section>", f"T\n\n{LONG.strip()}"),
    "heading of comments": (f"<body><div><h2>A</h2><p>{LONG}</p></div><div><h3>Comments (3)</h3><p>{LONG * 3}</p></div>", f"A\n\n{LONG.strip()}"),
    "inner header": (f"<header>H</header><article><header><h1>T</h1><p>By me</p></header><div><p>{LONG}</p></div><div><p>{LONG}</p></div>"
                     f"<form>f<input></form><aside>s</aside></article><div class=cookie-notice>{LONG * 3}</div>", f"T\n\nBy me\n\n{TWO}"),
    "unmarked menus": (f"<div><a>a</a><a>b</a><a>c</a> | </div><div><div><p>{LONG}</p><p>{LONG}</p></div></div><div>Copyright</div>", TWO),
    "two parts": (f"<body><div><div><p>{LONG}</p><p>{LONG}</p></div><div><p>{LONG}</p><p>{LONG}</p></div></div><div>small</div>", f"{TWO}\n\n{TWO}"),
    "short": ("<nav><a>1</a></nav><article><h1>T</h1><p>x</p></article><footer>a footer that is much longer</footer>", "T\n\nx"),
    "page in a form": (f"<body class=no-sidebar><form id=f><div class='sidebar-left'><p>{LONG}</p></div></form>", LONG.strip()),
    "references": ("<p>a &amp; b &lt;i&gt; &#8364;&#x41;&nbsp;&copy &unknown; <b>c</b><br>d", "a & b <i> €A © &unknown; c d"),
    "no tags": ("just  text\n<3 and 4 < 5", "just text <3 and 4 < 5"),
    "cut off": ("<p>a<p>b</b></p><div>c<!-- d", "a\n\nb\n\nc"), "cut off tag": ("<p>a</p><p title='b", "a"),
    "scripts": ("<p>a</p><script>'</p><p>b'</script><style>p</style><p>c</p><script>d", "a\n\nc"),
    "hidden": ("<p>a</p><p hidden>b</p><div style='display: none'>c</div><div role=alert>d</div>", "a"),
    "cells": ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"), "empty": ("", ""), "null": (None, ""),
    "nothing": ("<html><body><nav>x</nav></body>", ""), "marks": ("<" * 1000, "<" * 1000), "title only": ("<title>t</title>", "")}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert htmltext.main_text(page) == want


def test_hard_pages_take_linear_time():
    for page in ("<div>" * 50000 + "x", "<i>" * 50000 + "</b>" * 50000 + "x", "<b>" * 30000 + "<p>x" * 30000, '<a b="' * 50000, "<p><b>" * 50000):
        htmltext.main_text(page)


def test_page_rows(spark):
    rows = [(1, "u", PAGES["flat"][0]), (1, "u", PAGES["flat"][0]), (2, None, None), (None, "u", ""), (3, "v", "<p>" + LONG * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit(1).alias(c) for c in ("text", "k0", "v0", "n_chars")])
    got = Counter(tuple(r) for r in htmltext.extract(df, ["page_id", "url"]).collect())
    want = Counter((i, u, t, len(t)) for i, u, t in [(i, u, htmltext.main_text(h)) for i, u, h in rows])
    assert got == want and want[(2, None, "", 0)] == 1
    assert htmltext.extract(df.limit(0), ["page_id", "url"]).count() == 0
