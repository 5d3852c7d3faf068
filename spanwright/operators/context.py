"""Where a match stands: line, comment, string literal and scope.

Each function returns a step for ``df.transform``: it takes a table with a text
column and a column ``found``, an array of matches (structs with ``start``),
and returns the table with a field more in the matches.  A step holds its
expressions ready and can be used on many tables.  Events (line starts, comment marks, quotes, definitions)
are merged with the matches by offset inside the row, so none of this shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import texts as T
from .quality import checked
from .sizing import lookup_join


Step = Callable[[DataFrame], DataFrame]


def chain(*steps: Step) -> Step:
    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = step(df)
        return df
    return run


def attach(found: str, events: list[Column], combine: Callable[..., Column]) -> Step:
    """``combine(match, event, ...)`` for each match and, from each list of
    events, the last at or before its start; events are
    ``array<struct<at, ...>>`` in order.

    The lists do not depend on each other, so one projection looks up all.
    """
    names = [f"__e{i}" for i in range(len(events))]
    lookups = [
        S.asof(F.transform(found, lambda m: m["start"]), lambda at: at, e, lambda e_: e_["at"],
               lambda _, event: event).alias(n) for n, e in zip(names, events)]
    zipped = F.arrays_zip(F.col(found).alias("m"), *names)
    combined = F.transform(zipped, lambda z: combine(z["m"], *[z[n] for n in names]))
    return lambda df: df.select("*", *lookups).withColumn(found, combined).drop(*names)


def with_line(text: str, found: str = "found") -> Step:
    """Adds ``line_no``, ``line_start`` and ``line``; an offset on a newline
    belongs to the line it ends."""
    starts = F.transform(S.line_spans(F.col(text)), lambda l: F.struct(
        l["start"].alias("at"), l["line_no"].alias("line_no"), l["line"].alias("line")))
    return attach(found, [starts], lambda m, e: m.withField("line_no", e["line_no"])
                  .withField("line_start", e["at"]).withField("line", e["line"]))


def with_comment(text: str, found: str = "found", opening: str = r"/\*", closing: str = r"\*/",
                 line_mark: str | None = "//", line_prefix: str | None = ";") -> Step:
    """Adds ``in_comment``; matches must carry ``line`` when line marks are used."""
    def ends(pattern: str) -> Column:
        return F.transform(S.spans(F.col(text), pattern), lambda s: F.struct(
            s["end"].alias("at"), s["start"].alias("start")))

    def flag(m: Column, opened: Column, closed: Column) -> Column:
        inside = F.coalesce(opened["start"] > F.coalesce(closed["start"], F.lit(-1)), F.lit(False))
        if line_mark:
            inside = inside | m["line"].contains(line_mark)
        if line_prefix:
            inside = inside | m["line"].startswith(line_prefix)
        return m.withField("in_comment", inside)

    return attach(found, [ends(opening), ends(closing)], flag)


def _quotes(text: Column) -> Column:
    """Quote marks with the character before each."""
    segs = S.segments(text, '"')
    before = F.transform(segs, lambda s, i: F.when(F.length(s["gap"]) > 0, F.right(s["gap"], F.lit(1)))
                         .when(i > 0, F.lit('"')).otherwise(F.lit("")))
    return F.zip_with(S.spans(text, '"'), before, lambda s, b: s.withField("before", b))


def with_string(text: str, found: str = "found", comments: bool = True) -> Step:
    """Adds ``in_string``: quotes in comments and after a backslash do not
    count, a quote after an apostrophe only counts inside a string, and a quote
    at offset 0 always counts.  ``comments=False`` is for text without them."""
    def toggle(inside: Column, q: Column) -> Column:
        skipped = (q["start"] > 0) & (
            q["in_comment"] | (q["before"] == "\\") | ((q["before"] == "'") & ~inside))
        return F.when(skipped, inside).otherwise(~inside)

    quotes = _quotes(F.col(text))
    states = S.scan(F.col("__quotes"), F.lit(False), toggle)
    events = F.zip_with("__quotes", F.slice("__states", F.lit(2), F.size("__states")),
                        lambda q, s: F.struct(q["end"].alias("at"), s.alias("inside")))
    plain = F.transform("__quotes", lambda q: q.withField("in_comment", F.lit(False)))
    return chain(
        lambda df: df.withColumn("__quotes", quotes),
        chain(with_line(text, "__quotes"), with_comment(text, "__quotes")) if comments
        else lambda df: df.withColumn("__quotes", plain),
        lambda df: df.withColumn("__states", states),
        attach(found, [events], lambda m, e: m.withField("in_string", F.coalesce(e["inside"], F.lit(False)))),
        lambda df: df.drop("__quotes", "__states"))


@dataclass(frozen=True)
class ScopeRule:
    """A definition: ``pattern`` with groups, how they name the scope, and
    plain texts without which the pattern cannot match."""
    pattern: str
    template: str = "{1}"
    groups: int = 1
    needs: tuple[str, ...] = ()

    def possible(self, text: Column) -> Column:
        """Cheap test that spares most texts a slow pattern."""
        test = F.lit(True)
        for part in self.needs:
            test = test & text.contains(part)
        return test

    def events(self, text: Column) -> Column:
        """Where each definition is complete, and its name."""
        # An empty text has no match; it stands for one that cannot have any.
        wanted = F.when(self.possible(text), text).otherwise("")
        return F.transform(S.spans(wanted, self.pattern, self.groups), lambda m: F.struct(
            m["end"].alias("at"),
            T.fill(self.template, lambda i: m[f"g{i}"], self.groups).alias("name")))

    def last_in(self, line: Column) -> Column:
        """Name of the last definition in one line."""
        last = lambda i: F.try_element_at(
            F.regexp_extract_all(line, F.lit(self.pattern), F.lit(i)), F.lit(-1))
        return F.when(self.possible(line), T.fill(self.template, last, self.groups))


def removed(text: Column, pattern: str) -> Column:
    """Text without the markers that match."""
    return F.regexp_replace(text, pattern, "")


def blanked(text: Column, pattern: str) -> Column:
    """Markers overwritten with blanks, so the offsets of the rest stay."""
    return S.replaced(text, pattern, lambda s: F.repeat(F.lit(" "), F.length(s["matched"])))


# Fixed value: the annotation marker of the declarations.
ANNOTATION = r"GTY\(\(.*?\)\)(?=\s)"


def with_scope(text: str, rules: list[ScopeRule], line_rules: list[ScopeRule] = (),
               found: str = "found", use_lines: Column | None = None) -> Step:
    """Adds ``scope``: the first rule with any definition that ends at or
    before the match names it, by its last definition; line rules look at the
    line of the match when no other rule applies, in rows where ``use_lines``."""
    def choose(m: Column, *definitions: Column) -> Column:
        names = [d["name"] for d in definitions]
        by_line = [rule.last_in(m["line"]) for rule in line_rules]
        if by_line:
            names.append(F.when(F.lit(True) if use_lines is None else use_lines, F.coalesce(*by_line)))
        return m.withField("scope", F.coalesce(*names))

    return attach(found, [rule.events(F.col(text)) for rule in rules], choose)


def fixed_scopes(df: DataFrame, scope: str, path: str, fixes: DataFrame,
                 denied: list[str]) -> DataFrame:
    """Replace known wrong scopes by ``fixes(scope, path, fixed)``; a scope in
    ``denied`` that no fix covers is set apart.  A fix may set the scope to null."""
    keyed = fixes.select(F.col("scope").alias(scope), F.col("path").alias(path),
                         F.struct(F.col("fixed")).alias("__fix"))
    fixed = (lookup_join(df, keyed, [scope, path], "left")
             .withColumn(scope, F.when(F.col("__fix").isNotNull(), F.col("__fix.fixed"))
                         .otherwise(F.col(scope)))
             .drop("__fix").select(*df.columns))
    return checked(fixed, (F.coalesce(F.col(scope).isin(denied), F.lit(False)),
                              "scope is not a definition"))
