"""Option-definition records: segmentation, properties and typed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts as T
from . import ordered
from .quality import checked
from .sizing import checkpointed


def record_lines(lines: DataFrame, keys: list[str], order: str, line: str,
                 strict_eof: bool = False) -> DataFrame:
    """Non-blank lines with ``record``, the place of the blank line before
    their record (-1 for the first record).

    Lines are right-stripped and cut at the first ``;``; a line of comment only
    vanishes and does not end the record.  The last record is kept unless
    ``strict_eof`` asks for the blank line that ends it.
    """
    stripped = T.trimmed_right(F.col(line))
    cleaned = (lines.withColumn("__has_comment", stripped.contains(";"))
               .withColumn(line, F.substring_index(stripped, ";", 1))
               .where(~(F.col("__has_comment") & (F.col(line) == ""))).drop("__has_comment"))
    blank = F.when(F.col(line) == "", F.col(order))
    numbered = ordered.carry_forward(cleaned, keys, order, {"record": blank})
    if strict_eof:
        numbered = checkpointed(numbered)
        # Seen from the end, the blank line that ends a record comes before it.
        numbered = ordered.previous(numbered.withColumn("__back", -F.col(order)), keys, "__back", {
            "__end": blank}).where(F.col("__end").isNotNull() | (F.col(line) == "")).drop("__back", "__end")
    return (numbered.where(F.col(line) != "")
            .withColumn("record", F.coalesce("record", F.lit(-1)).cast("bigint")))


def records(lines: DataFrame, keys: list[str], order: str, line: str,
            strict_eof: bool = False, part_rows: int = 1 << 16) -> DataFrame:
    """Records as arrays of lines: ``keys, record, part, lines``.

    A record is the stretch between two blank lines of one file; a longer one
    comes in parts of at most ``part_rows`` lines (lines of the file are
    counted), which :func:`whole_records` joins.
    """
    found = checkpointed(record_lines(lines, keys, order, line, strict_eof))
    numbered = ordered.running_sum(found, keys, order, F.lit(1), "__n")
    return (numbered.groupBy(*keys, "record", ordered.chunk_of(F.col("__n"), part_rows).alias("part"))
            .agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col(line).alias("l")))).alias("__l"))
            .select(*keys, "record", "part", F.transform("__l", lambda x: x["l"]).alias("lines")))


def whole_records(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, record, lines``: the parts of each record joined in order."""
    return (parts.groupBy(*keys, "record").agg(F.sort_array(F.collect_list(F.struct("part", "lines"))).alias("__p"))
            .select(*keys, "record", F.flatten(F.transform("__p", lambda p: p["lines"])).alias("lines")))


PROPERTY = r"[^\s(]*\([^)]*\)?\S*|\S+"


def properties(line: Column) -> Column:
    """Words of a line; one with ``(`` runs on until ``)``.  White space inside
    becomes one blank."""
    found = F.regexp_extract_all(line, F.lit(PROPERTY), F.lit(0))
    return F.transform(found, lambda p: T.trimmed_right(F.regexp_replace(p, r"\s+", " ")))


def argument(props: Column, name: str) -> Column:
    """Argument of the last property ``Name(argument)``, null without one."""
    wanted = F.try_element_at(F.filter(props, lambda p: p.startswith(f"{name}(")), F.lit(-1))
    return F.when(wanted.rlike(r"^\S+\(.*\)"), F.regexp_extract(wanted, r"^\S+?\((.*)\)", 1))


def options(table: DataFrame, lines: str = "lines") -> DataFrame:
    """Option records as typed columns; one with two kinds has a ``problem``."""
    df = table.withColumn("__props", F.coalesce(
        properties(F.try_element_at(lines, F.lit(2))), F.array().cast("array<string>")))
    first_of = lambda *names: F.try_element_at(
        F.filter("__props", lambda p: p.isin(*names)), F.lit(1))
    name = F.regexp_replace(F.regexp_replace(F.element_at(lines, 1), r"^-", ""), r"=$", "")
    var = argument(F.col("__props"), "Var")
    typed = (df.withColumn("name", name)
             .withColumn("availability", first_of("Common", "Target"))
             .withColumn("kind", first_of("Warning", "Optimization"))
             .withColumn("driver", F.array_contains("__props", "Driver"))
             .withColumn("report", F.array_contains("__props", "Report"))
             .withColumn("var", F.trim(F.substring_index(var, ",", 1)))
             .withColumn("init", argument(F.col("__props"), "Init"))
             .withColumn("helptext", F.array_join(F.slice(lines, F.lit(3), F.size(lines)), "\n")))
    kinds = F.size(F.filter("__props", lambda p: p.isin("Warning", "Optimization")))
    return checked(typed, (kinds > 1, "more than one kind")).drop("__props")


def with_declaration(df: DataFrame, line: str) -> DataFrame:
    """Adds ``type_`` and ``name`` of a variable declaration: what follows
    ``=`` or ``[`` is cut, the last word is the name, its ``*`` goes to the
    type; both null below two words."""
    cut = F.substring_index(F.substring_index(F.col(line), "=", 1), "[", 1)
    df = df.withColumn("__words", T.words(cut))
    last = F.try_element_at("__words", F.lit(-1))
    kind = F.array_join(F.slice("__words", F.lit(1), F.greatest(F.size("__words") - 1, F.lit(0))), " ")
    enough = F.size("__words") >= 2
    star = last.startswith("*")
    return (df.withColumn("type_", F.when(enough, F.when(star, F.concat(kind, F.lit(" *"))).otherwise(kind)))
            .withColumn("name", F.when(enough, F.when(star, F.substring(last, F.lit(2), F.length(last)))
                                       .otherwise(last)))
            .drop("__words"))


def with_tag(table: DataFrame, lines: str = "lines") -> DataFrame:
    """Adds ``tag``: ``variable``, ``dropped`` or ``option``, and ``problem``
    for a variable that does not have exactly two lines."""
    first = F.element_at(lines, 1)
    variable = first.isin("Variable", "TargetVariable")
    dropped = (F.size(lines) == 2) & (first == "###") & (F.try_element_at(lines, F.lit(2)) == "Driver")
    return (table.withColumn("tag", F.when(variable, "variable").when(dropped, "dropped").otherwise("option"))
            .withColumn("problem", F.when(variable & (F.size(lines) != 2),
                                          "a variable record needs two lines")))


def names(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Distinct non-null names of both tables."""
    return left.select(name).union(right.select(name)).where(F.col(name).isNotNull()).distinct()
