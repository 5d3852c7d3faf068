"""Matches with offsets, whole identifiers, dictionary matches and guards."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import texts as T
from .sizing import SAMPLE_FRACTION, fits_broadcast, lookup_join

TOKEN = f"[{S.IDENTIFIER_CHARS}]+"


def multiline(pattern: str) -> str:
    """``^``/``$`` at each newline and ``.`` over newlines."""
    return "(?dms)" + pattern


def identifier(names: str | Iterable[str], mode: str = "guarded") -> str:
    """Pattern for whole identifiers; group 1 is the name.

    ``consuming`` takes one character on either side into the match, so it
    misses names at the ends of a text and the second of two names that share
    one delimiter.
    """
    names = [names] if isinstance(names, str) else list(names)
    # Longest first: an alternation takes the first branch that fits.
    group = "(" + "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n))) + ")"
    chars = S.IDENTIFIER_CHARS
    if mode == "consuming":
        # Any character that is no identifier character; a negated class of
        # these ranges is far slower in Java.
        return f"(?s:.)(?<![{chars}]){group}(?![{chars}])(?s:.)"
    return f"(?<![{chars}]){group}(?![{chars}])"


def matches(df: DataFrame, text: str, pattern: str, keep: list[str],
            groups: dict[str, int] | None = None) -> DataFrame:
    """One row per match: ``keep``, ``nth``, ``start``, ``end``, ``matched``
    and the named groups."""
    groups = groups or {}
    found = S.spans(F.col(text), pattern, max(groups.values(), default=0))
    return (S.unnest(df, keep, found)
            .select(*keep, "nth", "m.start", "m.end", "m.matched",
                    *[F.col(f"m.g{i}").alias(name) for name, i in groups.items()]))


def consuming_matches(df: DataFrame, text: str, names: str | Iterable[str],
                      keep: list[str]) -> DataFrame:
    """Identifiers found with consumed guards; offsets are those of the name."""
    return (matches(df, text, identifier(names, "consuming"), keep, {"name": 1})
            .select(*keep, "nth", (F.col("start") + 1).alias("start"),
                    (F.col("end") - 1).alias("end"), F.col("name").alias("matched")))


def first_match(text: Column, pattern: str) -> Column:
    """``struct<start, end, matched>`` of the first match, null without one.
    Only the text up to it is measured."""
    matched = F.regexp_extract(text, pattern, 0)
    gap = F.element_at(F.split(text, pattern, 2), 1)
    start = F.length(gap).cast("bigint")
    return F.when(matched != "", F.struct(
        start.alias("start"), (start + F.length(matched)).alias("end"), matched.alias("matched")))


def last_match(text: Column, pattern: str) -> Column:
    """``struct<start, end, matched>`` of the last match, null without one."""
    matched = F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(-1))
    end = (F.length(text) - F.length(S.tail(text, pattern))).cast("bigint")
    return F.when(matched.isNotNull(), F.struct(
        (end - F.length(matched)).alias("start"), end.alias("end"), matched.alias("matched")))


def dictionary_counts(df: DataFrame, text: str, keep: list[str], dictionary: DataFrame,
                      name: str) -> DataFrame:
    """Occurrences of each dictionary name in each text: ``keep, name, n``.
    ``keep`` must identify a text.

    With a dictionary that can be broadcast, only its own tokens are counted
    and shuffled.  With a larger one, texts are counted first, so the join sees
    each token of a text once.
    """
    tokens = _tokens(df, text, keep, name)
    names = dictionary.select(name).where(F.col(name).isNotNull()).distinct()
    count = lambda rows: rows.groupBy(*keep, name).agg(F.count("*").alias("n"))
    if fits_broadcast(names):
        return count(tokens.join(F.broadcast(names), name))
    sampled = _tokens(df.sample(SAMPLE_FRACTION, seed=1), text, keep, name)
    return lookup_join(count(tokens), names, [name], "inner", spread_by=keep, max_bytes=-1,
                       sampled=sampled.distinct())


def _tokens(df: DataFrame, text: str, keep: list[str], name: str) -> DataFrame:
    return S.unnest(df, keep, F.regexp_extract_all(
        F.col(text), F.lit(TOKEN), F.lit(0)), name).drop("nth")


def dictionary_matches(df: DataFrame, text: str, keep: list[str], dictionary: DataFrame,
                       name: str) -> DataFrame:
    """Each place of a dictionary name: ``keep, name, start, end``."""
    tokens = matches(df, text, TOKEN, keep).select(
        *keep, "start", "end", F.col("matched").alias(name))
    names = dictionary.select(name).where(F.col(name).isNotNull()).distinct()
    return lookup_join(tokens, names, [name], "inner", spread_by=keep + ["start"],
                       sampled=_tokens(df.sample(SAMPLE_FRACTION, seed=1), text, keep, name))


# -- guards: predicates on one located match (line and matched are columns) --

def not_preceded_by(prefix: str, pattern: str) -> str:
    """Pattern that skips matches right after ``prefix``."""
    return f"(?<!{re.escape(prefix)}){pattern}"


def line_starts(m: Column, prefix: str) -> Column:
    return m["line"].startswith(prefix)


def line_has(m: Column, part: str) -> Column:
    return m["line"].contains(part)


def line_ends(m: Column, suffix: str) -> Column:
    return m["line"].endswith(suffix)


def line_is(m: Column, whole: str) -> Column:
    return m["line"] == whole


def line_defines(m: Column) -> Column:
    return m["line"].startswith(F.concat(F.lit("#define "), m["matched"]))


def drop_excluded_lines(found: DataFrame, excluded: DataFrame) -> DataFrame:
    """Drop matches whose stripped ``line`` is in the table ``excluded(line)``."""
    listed = excluded.select(T.stripped(F.col("line")).alias("__line")).distinct()
    keyed = found.withColumn("__line", T.stripped(F.col("line")))
    return lookup_join(keyed, listed, ["__line"], "left_anti").drop("__line")


def only_under(path: Column, matched: Column, places: dict[str, str]) -> Column:
    """A name in ``places`` counts only in paths that contain its folder."""
    allowed = F.lit(True)
    for name, folder in places.items():
        allowed = allowed & ((matched != name) | path.contains(folder))
    return allowed


def filtered(found: Column, *reject: Callable[[Column], Column]) -> Column:
    """Array of matches without those a guard rejects."""
    def sound(m: Column) -> Column:
        keep = F.lit(True)
        for guard in reject:
            keep = keep & ~F.coalesce(guard(m), F.lit(False))
        return keep
    return F.filter(found, sound)
