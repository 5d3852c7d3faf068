"""Interval labels of a class forest: below means between two numbers.

Each inner node gets the interval ``[pre, stop)`` that holds the ``pre`` of all
inner nodes below it; a leaf stands at the ``pre`` of its parent.  A node is
below another, or is it, if its ``pre`` is in the other's interval.  So nothing
of the size of all pairs is stored, however deep the forest is.

Sizes and places come from doubling over the parents: after ``k`` rounds a node
knows its ancestor ``2^k`` above, and what is within ``2^k`` below it, as what
its ancestors' table said a round before.  A forest of depth ``d`` takes about
``2 log d`` rounds over the table of its inner nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import inventory
from .sizing import stored

# The children of a parent are counted in so many groups, so a hot parent is
# not in one task.
GROUPS = 1024


def labels(edges: DataFrame) -> DataFrame | None:
    """``node, pre, stop, depth, inner`` of ``child, parent`` edges; a null
    parent marks a root, and an edge to the node itself says nothing.  Nodes
    without a parent have depth 0.  None if a node has several parents or the
    edges have a cycle."""
    parent = F.when(F.col("child") != F.col("parent"), F.col("parent"))
    none = F.lit(None).cast(dict(edges.dtypes)["child"])
    leads = F.coalesce(F.col("child") != F.col("parent"), F.lit(False))
    ends = F.array(F.struct(F.col("child").alias("node"), parent.alias("parent"), F.lit(False).alias("inner")),
                   F.struct(F.col("parent").alias("node"), none.alias("parent"), leads.alias("inner")))
    seen = edges.select(F.explode(ends).alias("e")).where("e.node is not null").groupBy("e.node").agg(
        F.min("e.parent").alias("parent"), (F.min("e.parent") != F.max("e.parent")).alias("several"), F.max("e.inner").alias("inner"))
    known, facts = _counted(seen, several="several", inner="inner", left="inner and parent is not null")
    if facts["several"]:
        return None
    one = F.lit(1).cast("bigint")
    rows = known.where("inner").select("node", "parent", F.col("parent").alias("jump"), one.alias("size"),
                                       F.col("parent").isNotNull().cast("bigint").alias("depth"))
    rounds, left = 0, facts["left"]
    while left:
        # A cycle never ends; a way up has fewer steps than there are nodes.
        if 1 << rounds > facts["inner"]:
            return None
        rows, found = _counted(_doubled(rows, up="depth", down="size"), left="jump is not null")
        rounds, left = rounds + 1, found["left"]
    rows = stored(_first_places(rows))
    for _ in range(rounds):
        rows = stored(_doubled(rows, up="pre"))
    inside = rows.select("node", (F.col("pre") - 1).alias("pre"), (F.col("pre") - 1 + F.col("size")).alias("stop"), "depth")
    above = inside.select(F.col("node").alias("parent"), "pre", "depth")
    outside = F.lit(-1).cast("bigint")
    leaves = known.where("not inner").select("node", "parent").join(above, "parent", "left").select(
        "node", F.coalesce("pre", outside).alias("pre"), F.coalesce("pre", outside).alias("stop"),
        F.coalesce(F.col("depth") + 1, F.lit(0)).alias("depth"))
    return inside.withColumn("inner", F.lit(True)).unionByName(leaves.withColumn("inner", F.lit(False)))


def _counted(df: DataFrame, **conditions: str) -> tuple[DataFrame, dict[str, int]]:
    """The table stored, and for how many rows each condition holds,
    counted as they are stored."""
    counts = Observation()
    kept = stored(df.observe(counts, *[F.count_if(F.coalesce(F.expr(c), F.lit(False))).alias(n) for n, c in conditions.items()]))
    return kept, counts.get


def _doubled(rows: DataFrame, up: str, down: str | None = None) -> DataFrame:
    """One round: ``up`` also of the ``2^k`` nodes above those it sums,
    ``down`` also of those below; ``jump`` is twice as far up."""
    others = [c for c in rows.columns if c not in ("node", "jump", up, down)]
    above = rows.select(F.col("node").alias("jump"), F.col("jump").alias("__jump"), F.col(up).alias("__up"))
    higher = rows.join(above, "jump", "left")
    values = {up: F.col(up) + F.coalesce("__up", F.lit(0))}
    if down:
        below = rows.where("jump is not null").groupBy(F.col("jump").alias("node")).agg(F.sum(down).alias("__down"))
        higher = higher.join(below, "node", "left")
        values[down] = F.col(down) + F.coalesce("__down", F.lit(0))
    return higher.select("node", F.col("__jump").alias("jump"), *others, *[v.alias(n) for n, v in values.items()])


def _first_places(sized: DataFrame) -> DataFrame:
    """``pre`` as the place after the parent: one more than the sizes of the
    siblings before, which are in any fixed order."""
    rows = sized.select("*", F.pmod(F.xxhash64("node"), F.lit(GROUPS)).alias("__group"), F.struct("parent").alias("__of"))
    inside = Window.partitionBy("__of", "__group").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("__of").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("__of", "__group").agg(F.sum("size").alias("__n")).select(
        "__of", "__group", F.sum("__n").over(before).alias("__base"))
    return rows.withColumn("__in", F.sum("size").over(inside)).join(base, ["__of", "__group"]).select(
        "node", F.col("parent").alias("jump"), "size", "depth",
        (F.lit(1) + F.coalesce("__in", F.lit(0)) + F.coalesce("__base", F.lit(0))).alias("pre"))


def is_below(pre: Column, of_pre: Column, of_stop: Column) -> Column:
    """The node at ``pre`` is below an inner node, or is it."""
    return (pre >= of_pre) & (pre < of_stop)


def over(points: DataFrame, labelled: DataFrame) -> DataFrame:
    """Rows with a ``pre``, each with every inner node whose interval holds it:
    adds ``ancestor`` and ``ancestor_depth``.

    A range comparison as an equi-join: an interval whose size has ``l`` binary
    digits meets at most three blocks of ``2^(l-1)`` places, and a place is in
    one block for each number of digits that occurs.
    """
    width = lambda digits: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(digits) - 1)
    block = lambda place, digits: F.call_function("div", place, width(digits))
    inner = labelled.where("inner").select(
        F.col("node").alias("ancestor"), F.col("pre").alias("__pre"), F.col("stop").alias("__stop"),
        F.col("depth").alias("ancestor_depth"), F.length(F.bin(F.col("stop") - F.col("pre"))).alias("__digits"))
    cut = inner.select("*", F.explode(F.sequence(block(F.col("__pre"), "__digits"), block(F.col("__stop") - 1, "__digits"))).alias("__block"))
    # At most as many as a number has binary digits.
    lengths = inner.agg(F.sort_array(F.collect_set("__digits")).alias("lengths"))
    placed = points.select("*", F.explode(F.coalesce(lengths.scalar(), F.array().cast("array<int>"))).alias("__digits")).where("pre >= 0")
    placed = placed.withColumn("__block", block(F.col("pre"), "__digits"))
    held = placed.join(cut, ["__digits", "__block"]).where(is_below(F.col("pre"), F.col("__pre"), F.col("__stop")))
    return held.select(*points.columns, "ancestor", "ancestor_depth")


def related(edges: DataFrame) -> DataFrame:
    """All ``(node, ancestor, depth)``, with the node itself at depth 0, as
    :func:`inventory.closure` gives them.  In a forest no pair is stored; a
    node with several parents or a cycle takes the closure."""
    labelled = labels(edges)
    if labelled is None:
        return inventory.closure(edges)
    depth = (F.col("depth") - F.col("ancestor_depth")).cast("int").alias("depth")
    itself = labelled.where(~F.col("inner")).select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))
    return over(labelled.select("node", "pre", "depth"), labelled).select("node", "ancestor", depth).union(itself)


def below(labelled: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, descendant, depth`` for the nodes of ``wanted(node)``, each with
    itself: their intervals only are looked at."""
    asked = labelled.join(wanted.select("node").distinct(), "node", "left_semi")
    found = over(labelled.select(F.col("node").alias("descendant"), "pre", "depth"), asked)
    itself = asked.where(~F.col("inner")).select("node", F.col("node").alias("descendant"), F.lit(0).alias("depth"))
    return found.select(F.col("ancestor").alias("node"), "descendant", (F.col("depth") - F.col("ancestor_depth")).cast("int").alias("depth")).union(itself)


def castable(codes: DataFrame, edges: DataFrame, struct: str, order: str) -> DataFrame:
    """Codes whose struct is an ancestor or below it: adds ``ancestor``, sorted
    in catalogue order.  A code is placed once and compared with intervals."""
    labelled = labels(edges)
    if labelled is None:
        return inventory.castable(codes, inventory.closure(edges), struct, order)
    places = labelled.select(F.col("node").alias(struct), "pre", F.when(~F.col("inner"), F.col("node")).alias("__leaf"))
    placed = codes.join(places, struct)
    found = over(placed, labelled).select(*codes.columns, "ancestor")
    itself = placed.where("__leaf is not null").select(*codes.columns, F.col("__leaf").alias("ancestor"))
    return found.union(itself).orderBy("ancestor", order)
