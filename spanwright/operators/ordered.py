"""Ordered computations within a key, safe when one key holds most rows.

A plain window sends all rows of a key to one task.  Here the rows of a key
are cut into chunks of the order column, each chunk is a window of its own,
and only one summary row per chunk goes through a window over the key.  With
an order column that is a dense number (id, turn, line number) a chunk holds at most
``CHUNK_ROWS`` rows, whatever the skew; use :func:`dense_order` for any other
order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizing import checkpointed, lookup_join

CHUNK_ROWS = 1 << 20
# Bytes of text from which on a key takes another row: a value of Spark has less than 2 GB.
ROW_BYTES = 1 << 30


def chunk_of(order: Column, rows: int | None = None) -> Column:
    """Number of the chunk, rounded down; exact for all BIGINT values."""
    whole, size = order.cast("bigint"), F.lit(CHUNK_ROWS if rows is None else rows)
    return F.call_function("div", whole - F.pmod(whole, size), size)


def _chunked(df: DataFrame, keys: list[str], order: str, chunk_rows: int | None) -> DataFrame:
    """Adds ``__key`` and ``__chunk``.  The key is one struct: it is never
    null, so rows with null keys join by plain equality and the join keeps the
    partitioning of the windows."""
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    return df.select("*", key.alias("__key"), chunk_of(F.col(order), chunk_rows).alias("__chunk"))


_IN_CHUNK = ("__key", "__chunk")


def _windows(order: str, inclusive: bool):
    local = Window.partitionBy(*_IN_CHUNK).orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    over_chunks = Window.partitionBy("__key").orderBy("__chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    return local, over_chunks


def _carry(df: DataFrame, keys: list[str], order: str, values: dict[str, Column],
           chunk_rows: int | None, inclusive: bool) -> DataFrame:
    names = list(values)
    span = range(len(names))
    rows = _chunked(df.select("*", *[values[n].alias(f"__v{i}") for i, n in enumerate(names)]),
                    keys, order, chunk_rows)
    local, over_chunks = _windows(order, inclusive)
    lasts = rows.groupBy(*_IN_CHUNK).agg(*[
        F.max_by(f"__v{i}", F.when(F.col(f"__v{i}").isNotNull(), F.col(order))).alias(f"__l{i}")
        for i in span])
    summary = lasts.select(*_IN_CHUNK, *[
        F.last(f"__l{i}", ignorenulls=True).over(over_chunks).alias(f"__c{i}") for i in span])
    inside = rows.select("*", *[
        F.last(f"__v{i}", ignorenulls=True).over(local).alias(f"__w{i}") for i in span])
    return inside.join(summary, list(_IN_CHUNK), "left").select(
        *[F.col(c) for c in df.columns if c not in names],
        *[F.coalesce(f"__w{i}", f"__c{i}").alias(n) for i, n in enumerate(names)])


def previous(df: DataFrame, keys: list[str], order: str, values: dict[str, Column],
             chunk_rows: int | None = None) -> DataFrame:
    """For each named value its last non-null one before this row in the key.

    ``order`` must be unique within the key.
    """
    return _carry(df, keys, order, values, chunk_rows, inclusive=False)


def carry_forward(df: DataFrame, keys: list[str], order: str, values: dict[str, Column],
                  chunk_rows: int | None = None) -> DataFrame:
    """For each named value its last non-null one up to and including this row."""
    return _carry(df, keys, order, values, chunk_rows, inclusive=True)


def carry_once(df: DataFrame, keys: list[str], order: str, upto: dict[str, Column],
               before: dict[str, Column], chunk_rows: int | None = None) -> DataFrame:
    """Several carried values in one pass that reads its input once.

    ``upto`` are last non-null values up to and including the row, ``before``
    those before it; ``order`` must be unique within the key.  All come from
    one sort of the chunks.  The pass is stored with what it carried inside its
    chunks; the edges, what stands at the last row of each chunk, are taken
    from there and added to the rows of later chunks of the key.
    """
    values = {**upto, **before}
    names = list(values)
    taken = [f"__v{i}" for i in range(len(names))]
    rows = _chunked(df.select("*", *[values[n].alias(v) for n, v in zip(names, taken)]), keys, order, chunk_rows)
    inclusive, _ = _windows(order, inclusive=True)
    exclusive, over_chunks = _windows(order, inclusive=False)
    carried = [F.last(v, ignorenulls=True).over(inclusive if n in upto else exclusive) for n, v in zip(names, taken)]
    end = F.lead(F.lit(True)).over(Window.partitionBy(*_IN_CHUNK).orderBy(order)).isNull()
    stored = checkpointed(rows.select(
        *df.columns, *_IN_CHUNK, end.alias("__end"), *[c.alias(f"__w{i}") for i, c in enumerate(carried)],
        *[v for n, v in zip(names, taken) if n in before]))
    at_end = [F.coalesce(v, f"__w{i}") if n in before else F.col(f"__w{i}") for i, (n, v) in enumerate(zip(names, taken))]
    edges = stored.where("__end").select(*_IN_CHUNK, *[c.alias(f"__l{i}") for i, c in enumerate(at_end)])
    held = [F.last(f"__l{i}", ignorenulls=True).over(over_chunks).alias(f"__c{i}") for i in range(len(names))]
    # Only chunks that something is carried into are looked up.
    nothing = F.lit(True)
    for i in range(len(names)):
        nothing = nothing & F.col(f"__c{i}").isNull()
    into = checkpointed(edges.select(*_IN_CHUNK, *held).where(~nothing))
    return lookup_join(stored, into, list(_IN_CHUNK), "left", [order]).select(
        *[c for c in df.columns if c not in names], *[F.coalesce(f"__w{i}", f"__c{i}").alias(n) for i, n in enumerate(names)])


def lag(df: DataFrame, keys: list[str], order: str, value: Column, out: str,
        chunk_rows: int | None = None) -> DataFrame:
    """``out`` is ``struct<v>`` of the previous row, null on the first row."""
    return previous(df, keys, order, {out: F.struct(value.alias("v"))}, chunk_rows)


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, out: str,
                chunk_rows: int | None = None) -> DataFrame:
    """Sum of ``value`` up to and including this row."""
    rows = _chunked(df.withColumn("__v", value.cast("bigint")), keys, order, chunk_rows)
    local, over_chunks = _windows(order, inclusive=True)
    summary = rows.groupBy(*_IN_CHUNK).agg(F.sum("__v").alias("__total")).select(
        *_IN_CHUNK, F.sum("__total").over(over_chunks).alias("__c"))
    inside = rows.select("*", F.sum("__v").over(local).alias("__w"))
    return inside.join(summary, list(_IN_CHUNK), "left").select(
        *df.columns, (F.col("__w") + F.coalesce("__c", F.lit(0))).alias(out))


def first_in_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the smallest ``order`` of each key, by partial aggregation."""
    others = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(order)).alias("__row"))
            .select(*keys, *[F.col("__row")[c].alias(c) for c in others])
            .select(*df.columns))


def dense_order(df: DataFrame, by: list[str], out: str = "ord") -> DataFrame:
    """Number the rows in the order of ``by``, which must be a total order.

    The sort is a range partitioning; the number grows along it and any
    ``CHUNK_ROWS`` consecutive values hold at most that many rows.  The result
    is checkpointed, so every use of it sees the same numbers.
    """
    return checkpointed(df.orderBy(*by).withColumn(out, F.monotonically_increasing_id()))


def ordered_parts(df: DataFrame, keys: list[str], order: str, text: Column, separator: str,
                  part_rows: int = 4096) -> DataFrame:
    """Texts of a key joined in order, as ``(keys, part, first, text)``;
    ``first`` is the order of the first text of the part.

    ``part`` is a storage format: a part joins ``part_rows`` rows of the key,
    counted in order, so no key is ever collected whole; the text of a key is
    its parts in order, whatever their size (:func:`whole_texts`).
    """
    numbered = running_sum(df.select(*keys, order, text.alias("__text")), keys, order, F.lit(1), "__n")
    return (
        numbered.select(*keys, chunk_of(F.col("__n") - 1, part_rows).alias("part"),
                  F.struct(F.col(order).alias("at"), F.col("__text").alias("text")).alias("__item"))
        .groupBy(*keys, "part")
        .agg(F.sort_array(F.collect_list("__item")).alias("__items"))
        .select(*keys, "part", F.element_at("__items", 1)["at"].alias("first"),
                F.array_join(F.transform("__items", lambda x: x["text"]), separator).alias("text")))


def whole_texts(parts: DataFrame, keys: list[str], text: str, separator: str) -> DataFrame:
    """``keys, text``: the parts of each key joined in order, for texts that
    are to stand in one row."""
    return (parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("part", F.col(text).alias("text")))).alias("__p"))
            .select(*keys, F.array_join(F.transform("__p", lambda p: p["text"]), separator).alias(text)))


def filled_rows(parts: DataFrame, keys: list[str], text: str, separator: str,
                row_bytes: int | None = None) -> DataFrame:
    """``keys, part, text``: the parts of each key joined in order, in one row
    with ``part`` 0.

    Nothing is cut for its number of rows.  Only because a value of Spark ends
    at 2 GB, a text goes on in a next row, ``part`` 1 and so on, at the first of
    its parts that begins beyond ``row_bytes`` (``ROW_BYTES``) of it.
    """
    sized = parts.withColumn("__size", F.octet_length(text).cast("bigint") + len(separator.encode()))
    began = F.sum("__size").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = sized.withColumn("__row", chunk_of(F.coalesce(began, F.lit(0)), ROW_BYTES if row_bytes is None else row_bytes))
    return (placed.groupBy(*keys, "__row")
            .agg(F.sort_array(F.collect_list(F.struct("part", F.col(text).alias("text")))).alias("__p"))
            .select(*keys, F.col("__row").alias("part"), F.array_join(F.transform("__p", lambda p: p["text"]), separator).alias(text)))
