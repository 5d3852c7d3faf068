"""Whole run over declarations: what is converted and what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..operators import inventory as A
from ..operators import quality


def accessors(headers: DataFrame, prefix: str = "gimple_") -> DataFrame:
    """Distinct declarations of ``line_no, line``, with the report's predicates."""
    found = A.distinct_by(A.declarations(headers, "line", prefix), "symbol", "line_no")
    symbol, first = F.col("symbol"), F.get("paramtypes", F.lit(0))
    return (found.withColumn("is_builder", A.has_prefix(symbol, f"{prefix}build_"))
            .withColumn("is_accessor", A.has_prefix(symbol, prefix, f"{prefix}seq", f"{prefix}build_", f"{prefix}alloc_"))
            .withColumn("exempt", symbol.isin(rules.EXEMPT_ACCESSORS))
            .withColumn("first_type", first).withColumn("plain_type", A.without_const(first)))


def counters(found: DataFrame, base: str = "gimple") -> DataFrame:
    """The five lines of the report: ``title, n``."""
    returns, first = F.col("returntype"), F.col("first_type")
    is_base = F.coalesce(returns == base, F.lit(False))
    return A.report(
        found,
        builders_todo=F.col("is_builder") & is_base,
        accessors_todo=first.isin(base, f"const_{base}") & F.col("is_accessor") & ~F.col("exempt"),
        builders_done=F.col("is_builder") & ~is_base,
        accessors_done=(first.startswith(f"{base}_") | first.startswith(f"const_{base}_")) & F.col("is_accessor"),
        accessors_exempt=F.col("exempt"))


def progress(found: DataFrame, codes: DataFrame, base: str = "gimple",
             fallback: str = "gimple_omp_") -> tuple[DataFrame, DataFrame]:
    """Progress per accessor prefix, and accessors without a prefix.

    ``codes(printable_name)`` is the catalogue the prefixes come from.
    """
    prefixes = codes.select(A.accessor_prefix(F.col("printable_name")).alias("prefix")).distinct()
    counted = found.where(F.col("is_accessor") & ~F.col("exempt"))
    placed = A.classify(counted, "symbol", prefixes, "prefix", [fallback])
    return A.progress(quality.sound(placed), ["prefix"], F.col("plain_type") != base), placed.where("problem IS NOT NULL")
