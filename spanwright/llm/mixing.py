"""Mixing sources to target weights over a training run.

DataFrame operations only: sizes, targets, running sums and positions are
column expressions; nothing runs in Python workers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

# Fixed values of the contract: weights in turn, share of all sizes, most passes.
TURNS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_PASSES = 2.0
WORD = r"[^\x20\x09-\x0D]+"
# Weight of a source at the knots 0, 1/2 and 1 of the run, by the turn of the
# source: rising, flat, falling.  Only the shape counts; the area is the target.
SHAPES = ((0.5, 1.0, 1.5), (1.0, 1.0, 1.0), (1.5, 1.0, 0.5))


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """``source, source_size, weight`` with a ``target`` for each source.

    All targets together are ``share`` of all sizes, in proportion to the
    weights, but none is above ``most`` times its source's size: what a capped
    source leaves is shared by weight again until none is above.  Sources
    sorted by cap per weight are capped from the start of that order, so the
    level of the others comes from running sums: no loop.  Works on one row
    per source.  If even all caps are too little, all are capped.
    """
    cap = F.col("source_size") * F.lit(most)
    order = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The level that would hold if this source and all after it were not capped.
    left = F.sum("source_size").over(all_rows) * F.lit(share) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    levels = sources.select("*", (left / F.sum("weight").over(rest)).alias("__level"), cap.alias("__cap"))
    fits = F.col("__level") * F.col("weight") <= F.col("__cap")
    # The first source that fits sets the level of all after it.
    level = F.first(F.when(fits, F.col("__level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.select("*", level.alias("__fit")).select(
        *sources.columns,
        F.least(F.col("__cap"), F.coalesce(F.col("__fit") * F.col("weight"), F.col("__cap"))).alias("target"))


def _ordered(rows: DataFrame) -> DataFrame:
    """With the place in a pass: ``order``, a hash of the id, and ``part``, its
    first digits in the source.  A struct is never null, so a null source joins."""
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return rows.select("*", order.alias("order"),
                       F.struct("source", F.substring(order, 1, 3).alias("digits")).alias("part"))


def _running(rows: DataFrame, sizes: DataFrame, carry: list[str]) -> DataFrame:
    """``offset``: words before the row in its source, in the order of a hash
    of the id.  One window per source and leading hex digits of the hash, one
    over the sums of these: a hot source is spread over thousands of tasks.
    ``sizes`` has the same rows, narrow and cheap to read again."""
    over = Window.partitionBy("part.source").orderBy("part.digits").rowsBetween(Window.unboundedPreceding, -1)
    sums = (_ordered(sizes).groupBy("part").agg(F.sum("size").alias("part_size"))
            .select(F.col("part").alias("p"), F.coalesce(F.sum("part_size").over(over), F.lit(0)).alias("base")))
    inside = (Window.partitionBy("part").orderBy("order", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = _ordered(rows).select("*", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("within"))
    return placed.join(sums, F.col("part") == F.col("p")).select(
        "doc_id", "source", "size", *carry, (F.col("base") + F.col("within")).alias("offset"))


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, size`` of each row."""
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"),
                       words(F.col(f"`{text}`")).alias("size"))


def source_table(rows: DataFrame, turns: tuple = TURNS) -> DataFrame:
    """``source, source_size, turn, weight``: sources by code point, null last,
    with the weights in turn.  ``turn``, which picks the shape, counts sources
    with words only, so that it is the same in the mixed table."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(turns)))
    weights = F.array(*[F.lit(float(w)) for w in turns])
    return totals.select("*", _shape_turn().alias("turn"), F.element_at(weights, place.cast("int") + 1).alias("weight"))


def _shape_turn(shapes: tuple = SHAPES) -> Column:
    worded = F.sum(F.when(F.col("source_size") > 0, 1).otherwise(0)).over(
        Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return F.pmod(worded - 1, F.lit(len(shapes))).cast("int")


def taken(rows: DataFrame, sizes: DataFrame, sources: DataFrame, carry: list[str] = ()) -> DataFrame:
    """``doc_id, source, size, turn, source_size, target, offset, copies, cut``.

    A source is read pass after pass, its documents in the order of a hash of
    their id, until its target is reached.  A document has ``copies`` whole
    copies and, if the target ends inside it, ``cut`` words of one more; so
    the words of a source are its target, rounded to a whole number.  A
    document without words has the whole passes of its source as copies.
    ``carry`` columns of ``rows`` come along; ``sizes`` is :func:`sized` of the
    same rows, written.
    """
    placed = _running(rows, sizes, list(carry))
    s = sources.select(F.struct("source").alias("s"), "turn", "source_size", "target")
    joined = placed.select("*", F.struct("source").alias("k")).join(s, F.col("k") == F.col("s"))
    goal = F.round(F.col("target")).cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rest = goal - passes * F.col("source_size") - F.col("offset")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), rest)).cast("bigint")
    whole = (F.col("size") > 0) & (extra == F.col("size"))
    return joined.select(
        "doc_id", "source", "size", *carry, "turn", "source_size", "target", "offset",
        (passes + whole.cast("bigint")).alias("copies"),
        F.when(whole, F.lit(0)).otherwise(extra).cast("bigint").alias("cut"))


def position(share: Column, turn: Column, shapes: tuple = SHAPES) -> Column:
    """The time (0 to 1) at which a source has given ``share`` of its target.

    The weight of a source is linear between its knots; its integral is a
    quadratic in each piece, inverted in closed form."""
    def inverse(shape):
        steps = len(shape) - 1
        areas = [(shape[i] + shape[i + 1]) / 2 / steps for i in range(steps)]
        total, before, out = sum(areas), 0.0, None
        for i in range(steps):
            y = share * F.lit(total) - F.lit(before)
            w, slope = shape[i], (shape[i + 1] - shape[i]) * steps
            # w t + slope t^2 / 2 = y, in the form that holds for slope 0 too.
            t = F.lit(2.0) * y / (F.lit(w) + F.sqrt(F.greatest(F.lit(0.0), F.lit(w * w) + F.lit(2.0 * slope) * y)))
            here = F.lit(i / steps) + F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0 / steps))
            out = here if out is None else F.when(share * F.lit(total) >= F.lit(before), here).otherwise(out)
            before += areas[i]
        return out
    found = inverse(shapes[0])
    for i, shape in enumerate(shapes[1:], 1):
        found = F.when(turn == i, inverse(shape)).otherwise(found)
    return found


def curriculum(rows: DataFrame, sizes: DataFrame, sources: DataFrame, carry: list[str] = (), shapes: tuple = SHAPES) -> DataFrame:
    """``doc_id, source, copy, words, position`` and ``carry``: copies in training order, one row each.

    ``words`` is the size of the document, or the ``cut`` words of its last
    copy if the target ends inside it.  Copy ``c`` of a document starts ``c``
    passes plus its offset into its source's demand; the inverse of the
    integrated weight schedule gives the time.  The sort is a range
    partitioning by time, so each part of the run is a run of partitions.
    """
    return _in_order(taken(rows, sizes, sources, carry), F.col("target"), carry, shapes)


def _in_order(mixed: DataFrame, demand: Column, carry: list[str], shapes: tuple = SHAPES) -> DataFrame:
    last = F.col("copies") - F.when(F.col("cut") > 0, F.lit(0)).otherwise(F.lit(1))
    each = mixed.where((F.col("copies") > 0) | (F.col("cut") > 0)).select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("copy"))
    share = F.least(F.lit(1.0), (F.col("copy") * F.col("source_size") + F.col("offset")) / F.greatest(demand, F.lit(1.0)))
    words_of = F.when(F.col("copy") < F.col("copies"), F.col("size")).otherwise(F.col("cut"))
    return (each.select("doc_id", "source", "copy", words_of.alias("words"),
                        position(share, F.col("turn"), shapes).alias("position"), *carry)
            .orderBy("position", "doc_id", "copy"))


def _whole(mixed: DataFrame) -> DataFrame:
    """Whole copies only.  The copy in which a target ends is whole if that
    brings its source nearer to the target, or else gone; a source with a
    target has its first document at least."""
    first = (F.col("size") > 0) & (F.col("target") > 0) & (F.col("copies") == 0) & (F.col("offset") == 0)
    up = first | ((F.col("cut") > 0) & (F.col("cut") * 2 >= F.col("size")))
    return mixed.withColumn("copies", F.col("copies") + up.cast("bigint")).withColumn("cut", F.lit(0).cast("bigint"))


def _packed(docs: DataFrame, doc_id: str, text: str, source: str, *more: Column) -> DataFrame:
    """``doc_id, source, size, row``: the sizes with the whole row beside them."""
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"),
                       words(F.col(f"`{text}`")).alias("size"), *more, whole.alias("row"))


def trained_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                  turns: tuple = TURNS, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """The columns of ``docs``: each document as often as the mix takes it,
    rounded to whole copies, in training order.  Names of other columns don't
    matter.  A written table does not keep the order; :func:`placed` finds it again."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = scratch.keep(sized(docs, doc_id, text, source), "sizes")
    # Tables of one row per source are written, so that their size is known and
    # the texts don't move to meet them.
    sources = scratch.keep(targets(source_table(sizes, turns), share, most), "sources")
    # Time runs by the words that are really taken.
    given = scratch.keep(_whole(taken(sizes, sizes, sources)).groupBy(F.struct("source").alias("g")).agg(
        F.sum(F.col("copies") * F.col("size")).alias("given")), "given")
    mixed = _whole(taken(_packed(docs, doc_id, text, source), sizes, sources, ["row"])).where(F.col("copies") > 0)
    ordered = _in_order(mixed.join(given, F.struct("source") == F.col("g")), F.col("given"), ["row"])
    return ordered.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def placed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of a mixed table as ``row`` (columns ``c0, c1, ...``) with
    ``copy`` and ``position``, in the order of :func:`trained_order`, whatever
    the order they are read in.

    Equal rows are copies 0, 1, ...; rows that were repeated before the mix
    count as copies too.  A source gives all its copies 0 by the hash of the
    id, then its copies 1, and so on; the words before a row are its share.
    Sums run per (source, copy, leading digits), as in a mix.  The words before
    each of these groups are a row at its head, so that texts move twice only:
    to their part, and to their place."""
    texts = F.xxhash64(F.col(f"`{text}`"))
    full = _packed(docs, doc_id, text, source, texts.alias("same"))
    scratch = Scratch(docs.sparkSession, "placed")
    narrow = scratch.keep(full.drop("row"), "sizes")
    # All windows are inside a part, so rows move once.
    equal = Window.partitionBy("part", "order", "doc_id", "size", "same").orderBy("order")
    copy = (F.row_number().over(equal) - 1).cast("bigint")
    before = (Window.partitionBy("part.source").orderBy("copy", "part.digits").rowsBetween(Window.unboundedPreceding, -1))
    heads = (_ordered(narrow).repartition("part").withColumn("copy", copy)
             .groupBy("part", "copy").agg(F.sum("size").alias("part_size"))
             .select("part", "copy", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("size")))
    totals = scratch.keep(narrow.groupBy("source").agg(F.sum("size").alias("source_size")).select(
        F.struct("source").alias("s"), "source_size", _shape_turn().alias("turn")), "totals")
    # Only heads have no order, so they come first.
    inside = (Window.partitionBy("part", "copy").orderBy(F.col("order").asc_nulls_first(), "doc_id", "size", "same")
              .rowsBetween(Window.unboundedPreceding, -1))
    at = (_ordered(full).unionByName(heads, allowMissingColumns=True).repartition("part")
          .withColumn("copy", F.coalesce("copy", copy))
          .withColumn("words_before", F.sum("size").over(inside)).where(F.col("order").isNotNull())
          .join(totals, F.struct("source") == F.col("s")))
    share = F.least(F.lit(1.0), F.col("words_before") / F.greatest(F.col("source_size"), F.lit(1)))
    return (at.select("row", "doc_id", "copy", position(share, F.col("turn")).alias("position"))
            .orderBy("position", "doc_id", "copy").select("row", "copy", "position"))


def _run(docs: DataFrame, doc_id: str, text: str, source: str, turns: tuple, share: float, most: float
         ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbered sizes, sources with targets, and the training run, written in order."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = scratch.keep(sized(docs, doc_id, text, source).withColumn("row", F.monotonically_increasing_id()), "sizes")
    sources = targets(source_table(sizes, turns), share, most)
    return sizes, sources, scratch.keep(curriculum(sizes, sizes, sources, ["row"]), "run")


def training_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                   turns: tuple = TURNS, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """``doc_id, source, copy, words, position``: what the run reads, in order of ``position``.

    One row for each copy of a document; the copy in which the target of its
    source ends has the words up to there."""
    return _run(docs, doc_id, text, source, turns, share, most)[2].drop("row").orderBy("position", "doc_id", "copy")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        turns: tuple = TURNS, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per row of ``docs``.

    Null and empty texts have size 0 and nothing is taken of them; a null
    source is a source, last in order.  Repeated rows count as often as they
    occur.  The order of a pass is a hash of the id, so reruns agree.  What is
    taken of a row is the sum of its words in the written training run.
    """
    sizes, sources, run = _run(docs, doc_id, text, source, turns, share, most)
    read = run.groupBy(F.col("row").alias("r")).agg(F.sum("words").alias("words"))
    s = sources.select(F.struct("source").alias("s"), "source_size", "target")
    return (sizes.join(read, F.col("row") == F.col("r"), "left").join(s, F.struct("source") == F.col("s"))
            .select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("bigint").alias("taken")))
