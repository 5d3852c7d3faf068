"""Interval labels of class forests against walks and the closure."""

import random

import pytest

from spanwright.operators import hierarchy as H
from spanwright.operators import inventory as A


def table(spark, edges):
    return spark.createDataFrame(edges, "child string, parent string")


def pairs(df):
    rows = [(r.node, r.ancestor, r.depth) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def walked(edges):
    parent = {c: p for c, p in edges if p is not None and c != p and c is not None}
    found = set()
    for n in {x for e in edges for x in e if x is not None}:
        a, d = n, 0
        while a is not None:
            found.add((n, a, d))
            a, d = parent.get(a), d + 1
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests(spark, monkeypatch, seed):
    monkeypatch.setattr(H, "GROUPS", 3)
    rng = random.Random(seed)
    edges = [(f"n{i}", None if rng.random() < 0.1 else f"n{rng.randrange(max(0, i - 9) if seed == 1 else 0, i)}") for i in range(1, 150)]
    edges += [("hot", None), ("alone", None), ("self", "self"), (None, "n3"), (None, None)] + [(f"h{i}", "hot") for i in range(40)] + edges[:20]
    labelled = H.labels(table(spark, edges))
    rows = {r.node: r for r in labelled.collect()}
    want = walked(edges)
    for a in [r for r in rows.values() if r.inner]:
        assert {n for n, r in rows.items() if r.inner and a.pre <= r.pre < a.stop} == {n for n, x, _ in want if x == a.node and rows[n].inner}
    assert pairs(H.related(table(spark, edges))) == want
    some = spark.createDataFrame([("hot",), ("n3",), ("self",), ("h1",), ("h1",), ("none",)], "node string")
    assert {(r.descendant, r.node, r.depth) for r in H.below(labelled, some).collect()} == {p for p in want if p[1] in ("hot", "n3", "self", "h1")}


def test_a_chain_of_a_hundred_thousand(spark):
    n = 100000
    chain = spark.range(n).selectExpr("concat('c', id + 1) AS child", "concat('c', id) AS parent")
    labelled = H.labels(chain)
    deep = {r.node: r for r in labelled.where("node in ('c0', 'c7', 'c99999', 'c100000')").collect()}
    assert [(deep[c].pre, deep[c].stop, deep[c].depth) for c in ("c0", "c7", "c99999", "c100000")] == [
        (0, n, 0), (7, n, 7), (99999, n, 99999), (99999, 99999, n)]
    wanted = spark.createDataFrame([("c99990",)], "node string")
    assert {(r.descendant, r.depth) for r in H.below(labelled, wanted).collect()} == {(f"c{99990 + i}", i) for i in range(11)}


def test_several_parents_and_cycles_take_the_closure(spark):
    for edges in ([("a", "b"), ("b", "a"), ("c", "a"), ("c", "c")], [("a", "x"), ("a", "y"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "a")]):
        df = table(spark, edges)
        assert H.labels(df) is None
        assert pairs(H.related(df)) == pairs(A.closure(df))
    assert H.related(table(spark, [])).count() == 0
    assert pairs(H.related(table(spark, [("r", None)]))) == {("r", "r", 0)}


def test_castable(spark):
    edges = table(spark, [("one", "base"), ("two", "one"), ("three", "one"), ("base", None)])
    codes = spark.createDataFrame([(2, "three"), (1, "two"), (0, "base"), (5, "gone"), (3, None), (4, "one")], "ord int, struct string")
    rows = H.castable(codes, edges, "struct", "ord").collect()
    assert [(r.ancestor, r.ord) for r in rows] == [("base", 0), ("base", 1), ("base", 2), ("base", 4), ("one", 1), ("one", 2), ("one", 4),
                                                   ("three", 2), ("two", 1)]
    both = H.castable(codes, edges.union(table(spark, [("two", "base")])), "struct", "ord")
    assert {(r.ancestor, r.ord) for r in both.collect()} == {(r.ancestor, r.ord) for r in rows}
