import random

import pytest
from pyspark.sql import functions as F

from spanwright.operators import ordered, sizing
from spanwright.operators import changelog as L


@pytest.fixture(scope="module")
def events(spark):
    """One key holds most rows; keys and values may be null."""
    rng = random.Random(21)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), n, rng.choice(["x", "y", None])) for n in range(600)]
    return spark.createDataFrame(rows, "k string, n bigint, v string"), rows


def by_key(rows):
    keys = {}
    for k, n, v in rows:
        keys.setdefault(k, []).append((n, v))
    return keys


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_carry_lag_and_sum(events, chunk):
    df, rows = events
    out = ordered.carry_forward(df, ["k"], "n", {"seen": F.col("v"), "nth": F.when(F.col("v") == "x", F.col("n"))}, chunk)
    out = ordered.lag(out, ["k"], "n", F.col("v"), "before", chunk)
    out = ordered.running_sum(out, ["k"], "n", (F.coalesce("v", F.lit("")) == "x").cast("int"), "total", chunk)
    got = {r.n: (r.seen, r.nth, r.before, r.total) for r in out.collect()}
    assert len(got) == len(rows)
    for k, items in by_key(rows).items():
        seen = nth = before = None
        total, first = 0, True
        for n, v in items:
            seen = v if v is not None else seen
            nth = n if v == "x" else nth
            total += v == "x"
            expected_before = None if first else (before,)
            assert (got[n][0], got[n][1], got[n][3]) == (seen, nth, total)
            assert (None if got[n][2] is None else (got[n][2].v,)) == expected_before
            before, first = v, False


def test_lag_without_key(events):
    df, rows = events
    out = {r.n: r.b for r in ordered.lag(df, [], "n", F.col("n"), "b", 50).collect()}
    assert out[0] is None and all(out[n].v == n - 1 for n in range(1, 600))


def test_likewise_restarts_in_each_folder(spark):
    rows = [("d1", 1, "A."), ("d1", 2, "A."), ("d2", 3, "A."), ("d1", 4, "B."), ("d1", 5, "A."), ("d2", 6, "A.")]
    df = spark.createDataFrame(rows, "dir string, n bigint, text string")
    for chunk in (2, 1 << 20):
        out = {r.n: r.short for r in L.likewise(df, ["dir"], "n", "text", chunk_rows=chunk).collect()}
        assert out == {1: "A.", 2: "Likewise.", 3: "A.", 4: "B.", 5: "A.", 6: "Likewise."}


def test_parts_put_together_are_the_whole(events):
    df, rows = events
    parts = ordered.ordered_parts(df, ["k"], "n", F.col("n").cast("string"), ",", 10).collect()
    for k, items in by_key(rows).items():
        mine = sorted((r.part, r.text) for r in parts if r.k == k)
        assert ",".join(t for _, t in mine) == ",".join(str(n) for n, _ in items)


def test_dense_order_follows_the_sort(events):
    df, rows = events
    out = ordered.dense_order(df, ["v", "n"]).orderBy("ord").collect()
    assert [r.n for r in out] == [n for _, n, v in sorted(rows, key=lambda r: (r[2] is not None, r[2] or "", r[1]))]


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
@pytest.mark.parametrize("share", [0, 64])
def test_salted_join_equals_broadcast_join(events, monkeypatch, how, share):
    """Whatever the sample calls hot; a share of 0 rows makes no key hot."""
    monkeypatch.setattr(sizing, "SAMPLE_FRACTION", 1.0)
    monkeypatch.setattr(sizing, "HOT_SHARE", share)
    monkeypatch.setattr(sizing, "SALTS", 7)
    df, _ = events
    table = df.sparkSession.createDataFrame([("x", 1), ("z", 2)], "v string, w int")
    plain = sizing.lookup_join(df, table, ["v"], how)
    salted = sizing.lookup_join(df, table, ["v"], how, ["n"], max_bytes=0)
    assert sorted(map(str, plain.collect())) == sorted(map(str, salted.select(*plain.columns).collect()))


def test_hot_keys(events, monkeypatch):
    df, _ = events
    monkeypatch.setattr(sizing, "HOT_SHARE", 2)
    assert [r.k for r in sizing.hot_keys(df, ["k"])] == ["hot"]


def test_measured_bytes_counts_values(spark):
    df = spark.createDataFrame([("abcd",), (None,)], "v string")
    assert sizing.measured_bytes(df) == 4 + 2 * 16


class Session:
    """Stands for a session with a master and perhaps a checkpoint folder."""

    def __init__(self, master, folder=None):
        self.sparkContext = type("Context", (), {"master": master})()
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default: folder or default)})()


def test_checkpoint_folder_comes_from_the_session(spark):
    assert sizing.shared_folder(Session("spark://h:1", "hdfs:///c")) == "hdfs:///c"
    assert sizing.shared_folder(Session("local[4]", "/given")) == "/given"
    with pytest.raises(ValueError):
        sizing.shared_folder(Session("spark://h:1"))
    assert sizing.checkpointed(spark.range(5)).count() == 5


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_several_values_in_one_pass(events, chunk):
    df, rows = events
    upto = {"seen": F.col("v"), "nth": F.when(F.col("v") == "x", F.col("n"))}
    before = {"last_y": F.when(F.col("v") == "y", F.struct(F.col("n").alias("at"))), "ago": F.col("v")}
    got = {r.n: r for r in ordered.carry_once(df, ["k"], "n", upto, before, chunk).collect()}
    assert len(got) == len(rows)
    for k, items in by_key(rows).items():
        seen = nth = last_y = ago = None
        for n, v in items:
            assert (got[n].last_y and got[n].last_y.at, got[n].ago) == (last_y, ago)
            seen = ago = v if v is not None else seen
            nth, last_y = (n if v == "x" else nth), (n if v == "y" else last_y)
            assert (got[n].seen, got[n].nth, got[n].k, got[n].v) == (seen, nth, k, v)
    assert ordered.carry_once(df.limit(0), ["k"], "n", upto, before, chunk).count() == 0
