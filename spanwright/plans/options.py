"""Whole run over option files: typed options, variables and their names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality
from ..operators import records as O
from ..sources import scan


@dataclass(frozen=True)
class OptionCatalogue:
    options: DataFrame
    variables: DataFrame
    names: DataFrame
    problems: DataFrame


def catalogue(files: DataFrame, strict_eof: bool = False, part_rows: int = 1 << 16) -> OptionCatalogue:
    """Option files ``path, text`` as tables."""
    lines = scan.lines(files, ["path"], "text")
    parts = O.records(lines, ["path"], "line_no", "line", strict_eof, part_rows)
    tagged = O.with_tag(O.whole_records(parts, ["path"]))
    sound = quality.sound(tagged)
    checked = O.options(sound.where("tag = 'option'").drop("tag"))
    options = quality.sound(checked)
    declared = O.with_declaration(sound.where("tag = 'variable'").withColumn(
        "line", F.element_at("lines", 2)), "line")
    variables = declared.where("name IS NOT NULL").select("path", "record", "type_", "name")
    columns = ["path", "record", "problem"]
    problems = (tagged.where("problem IS NOT NULL").select(*columns)
                .union(checked.where("problem IS NOT NULL").select(*columns))
                .union(declared.where("name IS NULL").withColumn(
                    "problem", F.lit("a declaration needs a type and a name")).select(*columns)))
    names = O.names(options.select(F.col("var").alias("name")), variables, "name")
    return OptionCatalogue(options.drop("lines"), variables, names, problems)
