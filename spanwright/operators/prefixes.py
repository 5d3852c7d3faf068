"""Prefix matches by one sort: texts and the beginnings asked for, together.

Sorted falling, all texts that start with ``s`` stand right before ``s``.  One
walk over a sorted partition carries a stack of steps: for the text it is at,
how many of its first characters the rows behind it share, and the first of
these rows.  The next text shares some characters with this one, so steps that
share more sink to that many.  At an asked text the top step is the answer.
The stack has at most as many steps as the text has characters, and each row is
read once, whatever the number of lengths.

A partition starts with an empty stack.  What stood open before it comes from a
table of one row a partition, its first and last text and the stack at its end,
which one walk over the partitions adds up; an asked text at the start of a
partition also looks at the stack that was open there.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sizing import checkpointed, lookup_join

# The walks run in Python workers, which need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GIVEN, ASKED, EDGE = 0, 1, 2
# A step: shared characters, and the order, text and other columns of a row.
Step = tuple[int, object, str, dict]


def shared(a: str, b: str) -> int:
    """How many characters two texts have in common at their start."""
    if a.startswith(b):
        return len(b)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _sooner(a: Step | None, b: Step | None) -> Step | None:
    if a is None or b is None:
        return a or b
    return a if (a[1], a[2]) <= (b[1], b[2]) else b


def sink(steps: list[Step], most: int) -> None:
    """Steps that share more than ``most`` characters share that many."""
    first = None
    while steps and steps[-1][0] >= most:
        first = _sooner(first, steps.pop())
    if first:
        steps.append((most, *first[1:]))


def climb(steps: list[Step], step: Step) -> None:
    """A step that shares at least as much as all others goes on top."""
    if steps and steps[-1][0] == step[0]:
        step = _sooner(steps.pop(), step)
    steps.append(step)


def _as_row(step: Step | None) -> dict | None:
    return step and {"shared": step[0], "at": step[1], "text": step[2], "row": step[3]}


def _as_step(row: dict) -> Step:
    return row["shared"], row["at"], row["text"], row["row"]


def _walk(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Asked rows with the answer of their partition, then the partition's edge."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps: list[Step] = []
        first = last = part = None
        for batch in batches:
            texts, kinds = batch.column("text").to_pylist(), batch.column("kind").to_pylist()
            ats, rows = batch.column("at").to_pylist(), batch.column("given")
            picked, answers = [], []
            for i, (text, kind) in enumerate(zip(texts, kinds)):
                if text is not None:
                    if last is None:
                        first, part = text, batch.column("part")[i].as_py()
                    else:
                        sink(steps, shared(last, text))
                    last = text
                if kind == GIVEN:
                    climb(steps, (len(text), ats[i], text, rows[i].as_py()))
                else:
                    picked.append(i)
                    answers.append(_as_row(steps[-1] if text is not None and steps and steps[-1][0] == len(text) else None))
            if picked:
                found = batch.take(pa.array(picked, pa.int64()))
                none = pa.nulls(len(picked))
                yield _made(schema, part=found.column("part"), kind=found.column("kind"), text=found.column("text"),
                            asked=found.column("asked"), found=answers, first=none, last=none, steps=none)
        if last is not None:
            yield _made(schema, part=[part], kind=[EDGE], text=[None], asked=[None], found=[None], first=[first],
                        last=[last], steps=[[_as_row(s) for s in steps]])
    return run


def _made(schema: pa.Schema, **columns) -> pa.RecordBatch:
    arrays = [c.cast(f.type) if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _open_at(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per partition the stack that stands open at its start, from the sorted edges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps: list[Step] = []
        last = ""
        for batch in batches:
            for edge in batch.to_pylist():
                if steps:
                    yield _made(schema, part=[edge["part"]], before=[last[:steps[-1][0]]], open=[[_as_row(s) for s in steps]])
                sink(steps, shared(last, edge["first"]))
                sink(steps, shared(edge["first"], edge["last"]))
                merged: list[Step] = []
                for step in sorted([*steps, *map(_as_step, edge["steps"])], key=lambda s: s[0]):
                    climb(merged, step)
                steps, last = merged, edge["last"]
    return run


def first_below(asked: DataFrame, given: DataFrame, text: str, order: str) -> DataFrame:
    """Adds to ``asked`` the row of ``given``, as the struct ``found``, that is
    the first by ``order`` among those whose text starts with the asked text.

    Both tables have the column ``text``.  Null texts and null orders match
    nothing; the empty text matches every text.  Of rows with equal order the
    one with the smallest text counts.  ``found`` is null where there is none.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    others = [c for c in given.columns if c != text]
    mine = [c for c in asked.columns if c != text]
    row, mark = F.struct(F.lit(0).alias("__one"), *[F.col(f"`{c}`") for c in others]), F.struct(F.lit(0).alias("__one"), *[F.col(f"`{c}`") for c in mine])
    have = given.select(F.col(f"`{text}`").alias("text"), F.lit(GIVEN).alias("kind"), F.col(f"`{order}`").alias("at"), row.alias("given"))
    want = asked.select(F.col(f"`{text}`").alias("text"), F.lit(ASKED).alias("kind"), mark.alias("asked"))
    both = have.where("text is not null and at is not null").unionByName(want, allowMissingColumns=True)
    # Rows of one text are dealt out by a hash, as any text may be a hot one.
    tie = F.when(F.col("kind") == GIVEN, F.xxhash64("at")).otherwise(
        F.xxhash64(*[F.col("asked")[c] for c, kind in asked.dtypes if c != text and "map<" not in kind]))
    keys = [F.col("text").desc_nulls_last(), F.col("kind"), F.col("tie")]
    placed = (both.withColumn("tie", tie).repartitionByRange(*keys).sortWithinPartitions(*keys)
              .select("text", "kind", "at", "given", "asked", F.spark_partition_id().alias("part")))
    kinds = {f.name: f.dataType for f in both.schema.fields}
    step = T.StructType([T.StructField("shared", T.IntegerType()), T.StructField("at", kinds["at"]),
                         T.StructField("text", T.StringType()), T.StructField("row", kinds["given"])])
    fields = [("part", T.IntegerType()), ("kind", T.IntegerType()), ("text", T.StringType()), ("asked", kinds["asked"]),
              ("found", step), ("first", T.StringType()), ("last", T.StringType()), ("steps", T.ArrayType(step))]
    shape = T.StructType([T.StructField(n, k) for n, k in fields])
    walked = checkpointed(placed.mapInArrow(_walk(to_arrow_schema(shape)), shape))
    # One row a partition, so one task adds them up.
    edges = walked.where(F.col("kind") == EDGE).select("part", "first", "last", "steps").repartition(1).sortWithinPartitions("part")
    opened = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("before", T.StringType()),
                           T.StructField("open", T.ArrayType(step))])
    entries = edges.mapInArrow(_open_at(to_arrow_schema(opened)), opened)
    rows = walked.where(F.col("kind") == ASKED).select("part", "text", "asked", "found")
    known = lookup_join(rows, checkpointed(entries), ["part"], "left", ["text"])
    reached = F.when(F.col("before").startswith(F.col("text")), F.filter("open", lambda s: s["shared"] >= F.length("text")))
    sooner = lambda a, b: F.when(a.isNull() | (F.struct(b["at"], b["text"]) < F.struct(a["at"], a["text"])), b).otherwise(a)
    best = F.aggregate(F.coalesce(reached, F.array()), F.col("found"), sooner)
    back = {**{c: F.col("best.row")[c] for c in others}, text: F.col("best.text")}
    return known.withColumn("best", best).select(
        *[(F.col("text") if c == text else F.col("asked")[c]).alias(c) for c in asked.columns],
        F.when(F.col("best").isNotNull(), F.struct(*[back[c].alias(c) for c in given.columns])).alias("found"))
