"""Written tables that cut lineage, and walks over sorted Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sizing import remove_folder, shared_folder

# Texts are worked on in slices of about this many bytes.
SLICE_BYTES = 1 << 20
# Rows that a Python worker gets at once, where rows are texts.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 1000


_made: ContextVar[list | None] = ContextVar("made", default=None)


@contextmanager
def released(spark: SparkSession):
    """Tables that operators keep inside are removed at the end, when the
    caller has written what was made of them."""
    folders: list[str] = []
    token = _made.set(folders)
    try:
        yield
    finally:
        _made.reset(token)
        for folder in folders:
            remove_folder(spark, folder)


class Scratch:
    """Tables of one run in the shared folder of the cluster."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        folders = _made.get()
        if folders is not None:
            folders.append(self.folder)

    def keep(self, df: DataFrame, name: str, texts: bool = False) -> DataFrame:
        """The table written and read again: every use sees the same rows, and
        a lost executor costs only the tasks of later steps.  With ``texts``
        a Python worker gets few rows at once, since texts can be long."""
        path, conf = f"{self.folder}/{name}", self.spark.conf
        usual = conf.get(BATCH)
        if texts:
            conf.set(BATCH, str(TEXT_ROWS))
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(BATCH, usual)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self, df: DataFrame, name: str) -> None:
        """Remove a kept table that is no longer read."""
        remove_folder(self.spark, f"{self.folder}/{name}")


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose texts go to Python workers a few megabytes at a time even
    if the caller runs it.  The setting is the session's from here on, and only
    ever lowered."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH)) <= TEXT_ROWS:
        conf.set(BATCH, str(TEXT_ROWS))
    return df


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes of text, one row at least."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def map_texts(df: DataFrame, keep: list[str], text: str, schema: str,
              make: Callable[[], Callable[[list[str | None]], dict[str, list]]]) -> DataFrame:
    """``keep`` and the columns that a function gives for slices of texts.

    ``make`` runs once per task and returns the function; ``schema`` names the
    new columns.  Columns of the same name in ``df`` don't clash: only ``keep``
    and the text are read, and a text that is kept is sent once.
    """
    kept = len(keep)
    at = keep.index(text) if text in keep and dict(df.dtypes)[text] == "string" else kept
    read = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
                     *([F.col(f"`{text}`").cast("string").alias("text")] if at == kept else []))
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    out = ", ".join([f"k{i} {dict(df.dtypes)[c]}" for i, c in enumerate(keep)]
                    + [f"v{i} {kind}" for i, (_, kind) in enumerate(fields)])

    def run(batches):
        work = make()
        for batch in batches:
            for a, b in text_slices(batch.column(at)):
                part = batch.slice(a, b - a)
                got = work(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:kept], *[pa.array(got[name], type=_arrow(kind)) for name, kind in fields]],
                    names=[*[f"k{i}" for i in range(kept)], *[f"v{i}" for i in range(len(fields))]])

    done = read.mapInArrow(run, out)
    return done.toDF(*keep, *[name for name, _ in fields])


def _arrow(kind: str) -> pa.DataType:
    simple = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
              "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
              "array<long>": pa.list_(pa.int64())}
    return simple[kind]


def group_runs(batches: Iterator[pa.RecordBatch], keys: list[str], most_bytes: int = 8 << 20
               ) -> Iterator[pa.Table]:
    """Sorted batches joined into tables that end between groups of equal keys.

    A group is never cut, so a table is as large as ``most_bytes`` or as its
    largest group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < most_bytes:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = last_group_start(table, keys)
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
        held = rest.to_batches()
        size = rest.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def last_group_start(table: pa.Table, keys: list[str]) -> int:
    starts = group_starts(table, keys)
    return int(starts[-1]) if len(starts) else 0


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows at which a group of equal (non-null) keys starts."""
    if not table.num_rows:
        return np.zeros(0, np.int64)
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def numbered(df: DataFrame, key: list[str], chunk: Column, order: list[Column], out: str) -> DataFrame:
    """Rows of a key numbered from 0 in ``order``, which must begin with what
    ``chunk`` (a BIGINT that doesn't fall in that order; null first) is made of.

    The rows are numbered inside a chunk of the key, then the counts of the
    chunks are summed, so the rows of a hot key are not all in one task."""
    columns = df.columns
    whole = F.struct(*key, F.coalesce(chunk, F.lit(-(1 << 62))).alias("chunk"))
    rows = df.select("*", whole.alias("__part"))
    inside = Window.partitionBy("__part").orderBy(*order)
    before = (Window.partitionBy(*[f"__p.{k}" for k in key]).orderBy("__p.chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    base = rows.groupBy("__part").agg(F.count("*").alias("__n")).withColumnRenamed("__part", "__p").select(
        "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    placed = rows.select("*", F.row_number().over(inside).alias("__i"))
    return placed.join(base, F.col("__part") == F.col("__p")).select(
        *columns, (F.col("__base") + F.col("__i") - 1).cast("bigint").alias(out))


def usable(v: Column) -> Column:
    """Of a vector: not null, not empty, not zero, all components finite numbers."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, number)
                      & F.exists(v, lambda x: x != 0), F.lit(False))
