import random
import re

import pytest
from pyspark.sql import functions as F

from spanwright.functions import spans as S
from spanwright.functions import texts as T
from spanwright.operators import match as M


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def random_texts(n=60, size=900, alphabet="ab_9 é\n.x", seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(size))) for _ in range(n)] + ["", "a", "\n"]


@pytest.mark.parametrize("pattern", ["a", "ab+", "[_a-zA-Z0-9]+", r"(?<![_a-zA-Z0-9])a(?![_a-zA-Z0-9])", "é.", "\n"])
def test_spans_are_those_of_finditer(spark, pattern):
    rows = frame(spark, random_texts()).select("text", S.spans(F.col("text"), pattern).alias("found")).collect()
    for r in rows:
        expected = [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, r.text)]
        assert [(s["start"], s["end"], s["matched"]) for s in r.found] == expected
        assert all(r.text[s["start"]:s["end"]] == s["matched"] for s in r.found)


def test_spans_beyond_one_block(spark):
    text = "ab " * 1000
    found = frame(spark, [text]).select(S.spans(F.col("text"), "ab").alias("f")).first().f
    assert [s["start"] for s in found] == list(range(0, 3000, 3))


def test_groups_become_columns(spark):
    df = M.matches(frame(spark, ["k1=v1 k2= k3=v3"]), "text", r"(\w+)=(\w*)", ["id"], {"key": 1, "value": 2})
    assert [(r.key, r.value) for r in df.orderBy("start").collect()] == [("k1", "v1"), ("k2", ""), ("k3", "v3")]


def test_first_and_last_match(spark):
    rows = frame(spark, random_texts(seed=2)).select(
        "text", M.first_match(F.col("text"), "ab+").alias("f"), M.last_match(F.col("text"), "ab+").alias("l")).collect()
    for r in rows:
        ms = [(m.start(), m.end()) for m in re.finditer("ab+", r.text)]
        got = [(x["start"], x["end"]) if x else None for x in (r.f, r.l)]
        assert got == ([ms[0], ms[-1]] if ms else [None, None])


def test_consuming_guards_miss_neighbours(spark):
    df = frame(spark, ["x.x x"])
    plain = M.matches(df, "text", M.identifier("x"), ["id"])
    assert [r.start for r in plain.orderBy("start").collect()] == [0, 2, 4]
    assert [r.start for r in M.consuming_matches(df, "text", "x", ["id"]).collect()] == [2]
    texts = random_texts(seed=3)
    got = {(r.id, r.start) for r in M.consuming_matches(frame(spark, texts), "text", "a", ["id"]).collect()}
    expected = {(i, m.start(1)) for i, t in enumerate(texts)
                for m in re.finditer("[^_a-zA-Z0-9](a)[^_a-zA-Z0-9]", t)}
    assert got == expected


def test_dictionary_tokens_are_whole(spark):
    df = frame(spark, ["abc 1abc abc_ abc"])
    names = spark.createDataFrame([("abc",), (None,), ("zzz",)], "name string")
    assert [(r.name, r.n) for r in M.dictionary_counts(df, "text", ["id"], names, "name").collect()] == [("abc", 2)]
    places = M.dictionary_matches(df, "text", ["id"], names, "name").orderBy("start").collect()
    assert [(r.start, r.end) for r in places] == [(0, 3), (14, 17)]


def test_asof_takes_the_last_event_at_or_before(spark):
    rng = random.Random(4)
    rows = [(sorted(rng.sample(range(400), rng.randrange(0, 200))), sorted(rng.sample(range(400), rng.randrange(0, 200))))
            for _ in range(30)]
    df = spark.createDataFrame(rows, "t array<bigint>, e array<bigint>")
    out = df.select("t", "e", S.asof(F.col("t"), lambda x: x, F.col("e"), lambda x: x,
                                     lambda x, e: F.struct(x.alias("x"), e.alias("e"))).alias("r")).collect()
    for r in out:
        assert [(x.x, x.e) for x in r.r] == [(t, max([e for e in r.e if e <= t], default=None)) for t in r.t]


def test_splice_applies_all_edits(spark):
    rng = random.Random(5)
    rows, expected = [], []
    for i in range(40):
        text = "".join(rng.choice("abcé\n") for _ in range(rng.randrange(2500)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randrange(300)) // 2 * 2))
        edits = [(a, b, rng.choice(["", "X", "long"])) for a, b in zip(cuts[::2], cuts[1::2])]
        out, at = "", 0
        for a, b, r in edits:
            out, at = out + text[at:a] + r, b
        expected.append(out + text[at:])
        rows.append((i, text, edits))
    df = spark.createDataFrame(rows, "id int, text string, e array<struct<start:bigint,end:bigint,repl:string>>")
    got = df.orderBy("id").select(S.splice(F.col("text"), F.col("e")).alias("o")).collect()
    assert [r.o for r in got] == expected


def test_no_edits_is_identity(spark):
    df = frame(spark, random_texts(5)).withColumn(
        "e", F.array().cast("array<struct<start:bigint,end:bigint,repl:string>>"))
    assert df.where(S.splice(F.col("text"), F.col("e")) != F.col("text")).count() == 0


def test_lines(spark):
    rows = frame(spark, random_texts(seed=6)).select("text", S.line_spans(F.col("text")).alias("l")).collect()
    for r in rows:
        assert [x.line for x in r.l] == r.text.split("\n")
        assert all(r.text[x["start"]:x["end"]] == x.line for x in r.l)


def test_tabs(spark):
    rng = random.Random(7)
    lines = ["".join(rng.choice("\t ab") for _ in range(rng.randrange(30))) for _ in range(200)]
    out = frame(spark, lines).select("text", T.tabs_to_spaces(F.col("text")).alias("o"),
                                     T.spaces_to_tabs(F.col("text")).alias("t")).collect()
    for r in out:
        assert r.o == r.text.expandtabs(8)
        if "\t" in r.text:
            assert r.t is None
        else:
            indent = len(r.text) - len(r.text.lstrip(" "))
            assert r.t == "\t" * (indent // 8) + " " * (indent % 8) + r.text.lstrip(" ")


def test_urls(spark):
    from urllib.parse import urljoin
    bases = ["https://h.org/a/b/c.html?q=1#f", "http://h.org", "http://h.org/x/"]
    links = ["/r", "n.html", "https://o.net/z", "//c.net/y", "#t", "?p=2", "d/e"]
    rows = spark.createDataFrame([(b, l) for b in bases for l in links], "b string, l string").select(
        "b", "l", T.absolute_url(F.col("b"), F.col("l")).alias("u")).collect()
    for r in rows:
        assert r.u == urljoin(r.b, r.l), (r.b, r.l)
