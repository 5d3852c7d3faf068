"""Rewrites of texts: renames, templates, wraps, span edits and their reports."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import texts as T
from .match import TOKEN, filtered, identifier
from .quality import checked, problem
from .sizing import SAMPLE_FRACTION, checkpointed, fits_broadcast, lookup_join

NO_IDENTIFIER = "the old name is not an identifier"
# A longer rule list is not spelled out in the pattern; each identifier is looked up.
MAX_LITERAL_RULES = 200
# Passes of templates are nested in blocks of this many, so that settled texts skip the rest.
PASSES = 16

Guard = Callable[[Column], Column]
Step = Callable[[DataFrame], DataFrame]


def rename_identifiers(text: Column, names: dict[str, str], swallow_blank: bool = True) -> Column:
    """Whole identifiers old -> new, all rules at once, for a rule list that
    fits into the expression; :func:`rename_by_table` takes a table.

    After a new name that ends in `` *`` one following blank is swallowed.  An
    old name that is not an identifier is an error, however many rules there
    are; the number of rules decides about speed only.
    """
    if not names:
        return text
    if odd := [n for n in names if not re.fullmatch(TOKEN, n)]:
        raise ValueError(f"{NO_IDENTIFIER}: {', '.join(map(repr, odd[:9]))}")
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    pattern = (identifier(names) if len(names) <= MAX_LITERAL_RULES else f"({TOKEN})") + "( ?)"

    def renamed(s: Column) -> Column:
        found = F.try_element_at(table, s["g1"])
        return S.let(found, lambda new: F.when(new.isNull(), s["matched"]).otherwise(F.concat(
            new, F.when(F.lit(swallow_blank) & new.endswith(" *"), F.lit("")).otherwise(s["g2"]))))

    return S.replaced(text, pattern, renamed, 2)


# A rule table below this size is carried by the expression; above, it is joined.
INLINE_BYTES = 8 << 20
_BUCKETS = 1024


def _rule_maps(rules: DataFrame) -> Column:
    """Bounded rules as one value, an array of maps by hash of ``old``."""
    maps = rules.groupBy(_bucket(F.col("old")).alias("b")).agg(
        F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("m"))
    return (maps.agg(F.map_from_entries(F.collect_list(F.struct("b", "m"))).alias("all"))
            .select(F.transform(F.sequence(F.lit(0), F.lit(_BUCKETS - 1)),
                                lambda i: F.try_element_at("all", i)))).scalar()


def _bucket(name: Column) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(_BUCKETS)).cast("int")


def with_rules(df: DataFrame, key: str, text: str, rules: DataFrame,
               inline_bytes: int = INLINE_BYTES) -> tuple[DataFrame, Callable[[Column], Column]]:
    """The table with a helper column ``__rules``, and the lookup of an
    identifier in ``rules(old, new)``.  Rules without an old or a new name don't
    apply; of rules with the same old name the smallest new one does.

    Small rules travel with the expression and the texts do not move.  Above
    the bound the distinct identifiers of a text are joined with the rules, and
    what applies comes back as one small map per text.
    """
    rules = rules.where(F.col("old").isNotNull() & F.col("new").isNotNull()).groupBy("old").agg(F.min("new").alias("new"))
    if fits_broadcast(rules, inline_bytes):
        return (df.withColumn("__rules", _rule_maps(rules)),
                lambda name: F.try_element_at(F.get("__rules", _bucket(name)), name))
    def names(texts: DataFrame) -> DataFrame:
        return S.unnest(texts, [key], F.array_distinct(
            F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))), "old").drop("nth")

    hits = (lookup_join(names(df), rules.select("old", "new"), ["old"], "inner", spread_by=[key],
                        sampled=names(df.sample(SAMPLE_FRACTION, seed=1)))
            .groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("__rules")))
    return df.join(hits, key, "left"), lambda name: F.try_element_at("__rules", name)


def unfit_rules(rules: DataFrame) -> DataFrame:
    """The rules ``old, new`` of a table that rename nothing, with their ``problem``."""
    old = F.col("old")
    found = problem((old.isNull() | F.col("new").isNull(), "a rule needs an old and a new name"),
                    (~old.rlike(f"^{TOKEN}\\z"), NO_IDENTIFIER))
    return rules.withColumn("problem", found).where("problem is not null")


def rename_by_table(df: DataFrame, key: str, text: str, rules: DataFrame, out: str = "renamed",
                    inline_bytes: int = INLINE_BYTES) -> DataFrame:
    """Whole identifiers renamed by a table ``rules(old, new)`` of any size.
    Rules that :func:`unfit_rules` lists don't apply."""
    ready, find = with_rules(df, key, text, rules, inline_bytes)
    return ready.withColumn(out, S.replaced(F.col(text), TOKEN, lambda m: F.coalesce(
        find(m["matched"]), m["matched"]))).drop("__rules")


def with_name_edits(df: DataFrame, key: str, text: str, rules: DataFrame, unless_after: str = "",
                    found: str = "found", inline_bytes: int = INLINE_BYTES) -> DataFrame:
    """Adds the edits ``old`` to ``new`` of a rule table as an array of
    matches, without identifiers right after the text ``unless_after``."""
    guard = f"(?<!{re.escape(unless_after)})(?<![{S.IDENTIFIER_CHARS}])" if unless_after else ""
    ready, find = with_rules(df, key, text, rules, inline_bytes)
    edits = F.transform(S.spans(F.col(text), guard + TOKEN), lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), m["matched"].alias("matched"),
        m["matched"].alias("rule"), find(m["matched"]).alias("repl")))
    return ready.withColumn(found, F.filter(edits, lambda m: m["repl"].isNotNull())).drop("__rules")


@dataclass(frozen=True)
class Template:
    """A rewrite rule: ``pattern`` with groups, and a replacement with
    ``{1}``, ``{2}``... or a function of the match."""
    name: str
    pattern: str
    replacement: str | Callable[[Column], Column]
    groups: int = 0

    def fill(self, m: Column) -> Column:
        if callable(self.replacement):
            return self.replacement(m)
        return T.fill(self.replacement, lambda i: m[f"g{i}"], self.groups)

    def edit(self, m: Column) -> Column:
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["matched"].alias("matched"),
                        F.lit(self.name).alias("rule"), self.fill(m).alias("repl"))

    def apply(self, text: Column) -> Column:
        return S.replaced(text, self.pattern, self.fill, self.groups)


def expand_once(text: Column, rules: list[Template]) -> Column:
    """One pass of all rules, in order."""
    for rule in rules:
        text = S.let(text, rule.apply)
    return text


def expand_templates(df: DataFrame, text: str, rules: list[Template], out: str = "expanded",
                     max_passes: int | None = None) -> DataFrame:
    """Passes until nothing changes, since an argument can hide another use.

    The loop is a fold inside the row that stops working once a pass changes
    nothing.  A pass undoes a level of nesting, of which a text has fewer than
    characters: that ends texts whose rules never settle, unless ``max_passes``
    does earlier.  ``passes`` counts the passes that changed the text;
    ``settled`` is false where they were not enough.
    """
    def step(state: Column, _: Column) -> Column:
        again = S.let(expand_once(state["text"], rules), lambda t: F.struct(
            t.alias("text"),
            (state["passes"] + F.when(t == state["text"], 0).otherwise(1)).alias("passes"),
            (t == state["text"]).alias("settled")))
        return F.when(state["settled"], state).otherwise(again)

    def block(state: Column, passes: Column) -> Column:
        return F.when(state["settled"], state).otherwise(F.aggregate(F.sequence(F.lit(1), passes), state, step))

    start = F.struct(F.col(text).alias("text"), F.lit(0).alias("passes"), F.lit(False).alias("settled"))
    if max_passes is None:
        blocks = F.array_repeat(F.lit(PASSES), (F.floor(F.length(text) / PASSES) + 1).cast("int"))
    else:
        blocks = F.array(F.lit(max_passes + 1))
    return (df.withColumn("__state", F.aggregate(F.coalesce(blocks, F.array(F.lit(1))), start, block))
        .withColumn(out, F.col("__state.text")).withColumn("passes", F.col("__state.passes"))
        .withColumn("settled", F.col("__state.settled")).drop("__state"))


def without_overlaps(edits: Column) -> Column:
    """Edits in order of place, without those that start inside an earlier one."""
    def kept(ordered: Column) -> Column:
        ends = S.scan(ordered, F.lit(0).cast("bigint"),
                      lambda last, e: F.when(e["start"] >= last, e["end"]).otherwise(last))
        return F.filter(F.zip_with(ordered, F.slice(ends, F.lit(1), F.size(ordered)), lambda e, last: F.when(
            e["start"] >= last, e)), lambda e: e.isNotNull())
    return S.let(F.sort_array(edits), kept)


def with_rule_edits(text: str, rules: list[Template], found: str = "found") -> Step:
    """Adds the edits of all rules as one array of matches."""
    edits = without_overlaps(F.concat(*[
        F.transform(S.spans(F.col(text), r.pattern, r.groups), r.edit) for r in rules]))
    return lambda df: df.withColumn(found, edits)


def rewrite_guarded(df: DataFrame, key: str, text: str, rules: list[Template],
                    locate: Step, reject: list[Guard] = (), once: bool = False,
                    max_passes: int | None = None) -> DataFrame:
    """Rules applied until no match is left that the guards allow.

    ``locate`` adds to the matches what the guards look at (line, comment,
    string, scope).  A pass is row-local.  Texts that settle leave the loop;
    the others are checkpointed, so a pass works on what the last one changed.
    The result has ``edited`` and ``hits``, the matches that were replaced.
    With ``once`` the first pass is the only one and what it writes is not
    matched again.  Rules that keep making matches of their own need
    ``max_passes``; texts that it leaves unsettled have a ``problem``.
    """
    blank = "array<struct<scope:string,rule:string>>"
    pending = df.withColumn("edited", F.col(text)).withColumn("hits", F.array().cast(blank))
    columns, settled = pending.columns, None
    match = with_rule_edits("edited", rules)
    allowed = filtered(F.col("found"), *reject) if reject else F.col("found")
    edited = S.splice(F.col("edited"), F.col("found"))
    hits = F.concat("hits", F.transform("found", lambda m: F.struct(
        m["scope"].alias("scope"), m["rule"].alias("rule"))))
    for done_passes in itertools.count():
        # A filter on computed matches would be pushed below every step and
        # repeat them all, so the pass is stored before it is split.
        placed = checkpointed(
            locate(match(pending)).withColumn("found", allowed).select(*columns, "found"))
        done = placed.where(F.size("found") == 0).select(*columns)
        settled = done if settled is None else settled.unionByName(done)
        rest = placed.where(F.size("found") > 0)
        pending = rest.withColumn("edited", edited).withColumn("hits", hits).select(*columns)
        if once or done_passes == max_passes or rest.isEmpty():
            break
    late = F.lit(None if once else "rules do not settle").cast("string")
    return settled.withColumn("problem", F.lit(None).cast("string")).unionByName(pending.withColumn("problem", late))


def strip_prefix(text: Column, before: str, prefix: str, after: str = r"(?=\S)") -> Column:
    """Drop ``prefix`` between two contexts, as in ``->symbol.x`` to ``->x``."""
    return F.regexp_replace(text, f"({before})(?:{prefix}){after}", "$1")


def wrap_identifiers(text: Column, names: list[str], macro: str) -> Column:
    """``x`` to ``MACRO (x)``, leaving names that are wrapped already."""
    opening = f"{macro} ("
    pattern = f"(?<!\\Q{opening}\\E)" + identifier(names)
    return S.replaced(text, pattern, lambda s: F.concat(F.lit(opening), s["g1"], F.lit(")")), 1)


def apply_edits(texts: DataFrame, key: str, text: str, edits: DataFrame,
                out: str = "edited") -> DataFrame:
    """Apply ``edits(key, start, end, repl)`` to texts.

    Texts whose edits overlap or leave the text stay unchanged and have a
    ``problem``.  The
    edits of a text come together in its row; a text is bounded, and so are
    edits that do not overlap, so duplicates are removed before the shuffle.
    """
    grouped = (edits.select(key, "start", "end", "repl").distinct().groupBy(key)
               .agg(F.sort_array(F.collect_list(F.struct("start", "end", "repl"))).alias("__edits")))
    joined = texts.join(grouped, key, "left").withColumn(
        "__edits", F.coalesce("__edits", F.array().cast(
            "array<struct<start:bigint,end:bigint,repl:string>>")))
    ends = F.transform(F.col("__edits"), lambda e: e["end"])
    shifted = F.slice(F.concat(F.array(F.lit(0).cast("bigint")), ends), F.lit(1), F.size("__edits"))
    broken = F.exists(
        F.zip_with("__edits", shifted, lambda e, before: (e["start"] < before) | (e["end"] < e["start"])
                   | (e["end"] > F.length(text))), lambda bad: bad)
    marked = checked(joined, (broken, "edits overlap or leave the text"))
    return marked.withColumn(out, F.when(F.col("problem").isNull(), S.splice(F.col(text), F.col("__edits")))
                             .otherwise(F.col(text))).drop("__edits")


def indented(df: DataFrame, line: str, out: str) -> DataFrame:
    """Adds the line with its leading blanks as tabs, and ``problem`` for a line
    that holds a tab already (its ``out`` is null)."""
    return checked(df.withColumn(out, T.spaces_to_tabs(F.col(line))), (F.col(line).contains("\t"), "line holds a tab"))


def touched_lines(df: DataFrame, edited: str, edits: str) -> DataFrame:
    """Adds ``lines``: the lines of the new text with ``touched``.

    A line is touched where a replacement put characters; an empty replacement
    and the newline itself touch nothing.
    """
    deltas = F.transform(edits, lambda e: (
        F.length(e["repl"]) - (e["end"] - e["start"])).cast("bigint"))
    placed = F.zip_with(edits, S.let(S.prefix_sums(deltas), lambda p: F.slice(p, F.lit(1), F.size(p) - 1)),
                        lambda e, shift: F.struct(
                            (e["start"] + shift).alias("at"),
                            (e["start"] + shift + F.length(e["repl"])).alias("end")))

    def mark(line: Column, edit: Column) -> Column:
        return F.struct(
            line["line_no"].alias("line_no"), line["line"].alias("line"),
            (F.coalesce(edit["end"] > line["start"], F.lit(False))
             & (line["end"] > line["start"])).alias("touched"))

    return df.withColumn("lines", S.asof(
        S.line_spans(F.col(edited)), lambda l: l["end"] - 1,
        F.filter(placed, lambda e: e["end"] > e["at"]), lambda e: e["at"], mark))


def line_changes(df: DataFrame, key: list[str], before: str, after: str) -> DataFrame:
    """Lines removed and added per text, counted: ``key, line, change, n``.

    Both versions are in the row, so their lines are sorted together and runs
    of equal lines are summed there; only differences leave the row.
    """
    def side(c: str, sign: int) -> Column:
        return F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "\n", -1),
                           lambda l: F.struct(l.alias("line"), F.lit(sign).alias("net")))

    def add(run: Column, x: Column) -> Column:
        return F.when(run["line"] == x["line"], F.struct(
            x["line"].alias("line"), (run["net"] + x["net"]).alias("net"))).otherwise(x)

    def differences(both: Column) -> Column:
        start = F.struct(F.lit(None).cast("string").alias("line"), F.lit(0).alias("net"))
        runs = S.let(S.scan(both, start, add), lambda r: F.slice(r, F.lit(2), F.size(r)))
        following = F.concat(F.transform(F.slice(both, F.lit(2), F.size(both)), lambda x: x["line"]),
                             F.array(F.lit(None).cast("string")))
        ends = F.zip_with(runs, following, lambda run, line: F.when(~run["line"].eqNullSafe(line), run))
        return F.filter(ends, lambda run: run.isNotNull() & (run["net"] != 0))

    changed = df.where(~F.col(before).eqNullSafe(F.col(after)))
    both = F.sort_array(F.concat(side(before, -1), side(after, 1)))
    return (S.unnest_fields(changed, key, S.let(both, differences))
            .select(*key, "line", F.when(F.col("net") > 0, "added").otherwise("removed").alias("change"),
                    F.abs("net").cast("bigint").alias("n")))


def long_lines(df: DataFrame, key: list[str], text: str, limit: int = 80) -> DataFrame:
    """Lines above ``limit`` columns after tab expansion, counted per text."""
    lengths = F.transform(F.split(F.col(text), "\n", -1), lambda l: F.length(
        F.when(l.contains("\t"), T.tabs_to_spaces(l)).otherwise(l)))
    return (df.select(*key, F.filter(lengths, lambda n: n > limit).alias("long"))
            .where(F.size("long") > 0)
            .select(*key, F.size("long").cast("bigint").alias("n_long"),
                    F.array_max("long").alias("longest")))
