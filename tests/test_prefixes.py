"""Prefix matches by one sort against plain comparison."""

import random

import pytest

from spanwright.operators import patches as P
from spanwright.operators import prefixes


def recorded(monkeypatch):
    """Tables that a match stores, and the plans that make them."""
    stored, made = [], prefixes.checkpointed

    def keep(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        stored.append((made(df), plan))
        return stored[-1][0]
    monkeypatch.setattr(prefixes, "checkpointed", keep)
    return stored


def plain(asked, given):
    out = []
    for name, text in asked:
        hits = [(at, t, extra) for at, t, extra in given if None not in (at, t, text) and t.startswith(text)]
        out.append((name, min(hits)[2] if hits else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_random_texts(spark, parts):
    rng = random.Random(parts)
    word = lambda: "".join(rng.choice("aébz🙂") for _ in range(rng.randint(0, 6)))
    asked = [(i, rng.choice([word(), "a", None, "é" * rng.randint(0, 9)])) for i in range(400)]
    given = [(i, rng.choice([word(), "aaaé", None, "é" * rng.randint(0, 9)]), f"m{i}") for i in rng.sample(range(1000), 400)]
    given.append((None, "a", "no order"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = prefixes.first_below(spark.createDataFrame(asked, "name int, text string"),
                                   spark.createDataFrame(given, "at int, text string, extra string"), "text", "at")
        assert got.columns == ["name", "text", "found"]
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(((r.name, r.found and r.found.extra) for r in rows), key=str) == plain(asked, given)
    texts = {at: t for at, t, _ in given}
    assert all(r.found is None or texts[r.found["at"]] == r.found.text for r in rows)


def test_a_thousand_lengths_without_fan_out(spark, monkeypatch):
    stored = recorded(monkeypatch)
    long = "".join(chr(97 + i * 7 % 26) for i in range(1000))
    patches = spark.createDataFrame([(i, long[:i]) for i in range(1, 1001)] + [(0, "zz")], "path int, summary string")
    mails = spark.createDataFrame([(1000 - i, f"[PATCH {i}/89] {long[:i]}") for i in range(1, 1001)]
                                  + [(5000, f"[PATCH 1/89] {long}!")], "ord int, subject string")
    found = P.match_mails(patches, mails, "path", "summary", "subject", "ord", 89)
    assert {r.path: r.mail and r.mail.ord for r in found.collect()} == {0: None, **{i: 0 for i in range(1, 1001)}}
    assert found.where("path = 7").first().mail.subject == f"[PATCH 1000/89] {long}"
    (walked, plan), (entries, more) = stored
    assert walked.where("kind = 1").count() == 1001 and walked.where("kind = 2").count() <= 8
    plans = [plan, more, found._jdf.queryExecution().executedPlan().toString()]
    # The sort, and the edges of the partitions.
    assert [p.count("Exchange hashpartitioning") + p.count("Exchange rangepartitioning") + p.count("Exchange SinglePartition")
            + p.count("Exchange RoundRobin") for p in plans] == [1, 1, 0]
    assert plan.count("Generate") == 0


def test_hot_text_is_dealt_out(spark):
    asked = spark.createDataFrame([(i, "hot") for i in range(3000)] + [(-1, "h"), (-2, "hotter")], "name int, text string")
    given = spark.createDataFrame([(i, "hot" if i % 3 else "hot and cold", "x" * 10) for i in range(3000, 100, -1)],
                                  "at int, text string, extra string")
    got = {r.name: r.found and r.found["at"] for r in prefixes.first_below(asked, given, "text", "at").collect()}
    assert got == {-1: 101, -2: None, **{i: 101 for i in range(3000)}}


def test_empty_tables_and_subjects_without_text(spark):
    none = spark.createDataFrame([], "at int, text string")
    asked = spark.createDataFrame([(1, ""), (2, None)], "name int, text string")
    assert [r.found for r in prefixes.first_below(asked, none, "text", "at").collect()] == [None, None]
    assert prefixes.first_below(asked.limit(0), none, "text", "at").count() == 0
    mails = spark.createDataFrame([(1, "Re: [PATCH 1/9] "), (2, "[PATCH 1/9] "), (3, None)], "ord int, subject string")
    patches = spark.createDataFrame([("p", ""), ("q", "a")], "path string, summary string")
    got = P.match_mails(patches, mails, "path", "summary", "subject", "ord")
    assert {(r.path, r.mail and r.mail.ord, r.problem) for r in got.collect()} == {("p", 2, None), ("q", None, "no mail for this patch")}
