"""Logs that grow at their head: generations of parts and a manifest.

New text stands before the old.  An append writes only its own parts, as one
more generation, and then a row of the manifest; nothing that is there is read
for its text, copied or changed.  A log is its parts from the newest generation
to the oldest, each in the order of ``part``.  Generations that the manifest
doesn't name, as an append that was cut off leaves, are not part of any log.
One append at a time may run on a store.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "generation bigint, folder string"


@dataclass(frozen=True)
class LogStore:
    """Logs of ``key`` below a folder that all executors share."""
    spark: SparkSession
    folder: str
    key: str

    def generations(self) -> list[tuple[int, str]]:
        """What the manifest names, oldest first: one row an append."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        return sorted((r.generation, r.folder) for r in rows)

    def append(self, parts: DataFrame, notice: str | None = None) -> None:
        """Adds ``key, part, text`` before what is there.  With ``notice``, logs
        that have no text yet end with it."""
        known = self.generations()
        parts = parts.select(self.key, F.col("part").cast("bigint").alias("part"), "text")
        if notice is not None:
            ends = parts.groupBy(self.key).agg((F.max("part") + 1).alias("part"))
            # Only the keys of older generations are read.
            for _, folder in known:
                ends = ends.join(self.spark.read.parquet(f"{self.folder}/{folder}").select(self.key), self.key, "left_anti")
            parts = parts.unionByName(ends.withColumn("text", F.lit(notice)))
        folder = f"parts-{uuid.uuid4().hex}"
        parts.write.option("compression", "zstd").parquet(f"{self.folder}/{folder}")
        number = known[-1][0] + 1 if known else 0
        self.spark.createDataFrame([(number, folder)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def read(self) -> DataFrame | None:
        """``key, generation, part, text``; None for a store without an append."""
        tables = [self.spark.read.parquet(f"{self.folder}/{folder}").withColumn("generation", F.lit(n).cast("bigint"))
                  for n, folder in self.generations()]
        columns = [self.key, "generation", "part", "text"]
        return reduce(DataFrame.unionByName, tables).select(*columns) if tables else None

    def in_order(self) -> DataFrame | None:
        """The parts of all logs, each log's in its order."""
        found = self.read()
        return found and found.orderBy(self.key, F.desc("generation"), "part")


def section_parts(sections: DataFrame, key: str, header: Column, summary: Column, text: Column) -> DataFrame:
    """What a patch adds to a log: ``key, part, text`` of sections ``key, part``
    (0 where there is no such column).  The first part opens with header and
    summary; the last is trimmed on the right, and a blank line follows."""
    numbered = sections if "part" in sections.columns else sections.withColumn("part", F.lit(0))
    rows = numbered.select(F.col(key), F.col("part").cast("bigint").alias("part"), text.alias("__text"),
                           F.concat(header, F.lit("\n\n\t"), summary, F.lit("\n\n")).alias("__head"))
    ends = rows.groupBy(key).agg(F.min("part").alias("__first"), F.max("part").alias("__last"))
    known = rows.join(ends, key) if "part" in sections.columns else rows.withColumn("__first", F.lit(0)).withColumn("__last", F.lit(0))
    opened = F.when(F.col("part") == F.col("__first"), F.col("__head")).otherwise("")
    closed = F.when(F.col("part") == F.col("__last"), F.concat(F.regexp_replace("__text", r"\s+\z", ""), F.lit("\n\n"))).otherwise(
        F.concat("__text", F.lit("\n")))
    return known.select(key, "part", F.concat(opened, closed).alias("text"))
