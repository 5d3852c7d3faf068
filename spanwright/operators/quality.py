"""Rows that break a rule say so in a ``problem`` column; none is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def problem(*rules: tuple[Column, str]) -> Column:
    """First reason that applies, null for a sound row."""
    return F.coalesce(*[F.when(broken, F.lit(reason)) for broken, reason in rules])


def checked(df: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    """The table with ``problem``, null for sound rows: one table, read once."""
    return df.withColumn("problem", problem(*rules))


def sound(df: DataFrame) -> DataFrame:
    """Rows without a problem."""
    return df.where(F.col("problem").isNull()).drop("problem")
