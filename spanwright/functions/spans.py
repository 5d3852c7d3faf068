"""Span arithmetic inside one text, as Column expressions.

Everything here stays in the row: a text is matched, measured and edited by
built-in array functions, so no operator that looks at one text at a time
needs a shuffle.  Offsets are 0-based code points, ends are exclusive.

Two rules keep the expressions linear in the length of the text:

* an expression used inside a lambda is evaluated for each element, so values
  from outside are bound once with :func:`let` or zipped in;
* folds that grow an array copy it on each append, so :func:`scan` works in
  blocks and copies short arrays only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 128

IDENTIFIER_CHARS = "_a-zA-Z0-9"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unnest(df: DataFrame, keep: list, items: Column | str, item: str = "m",
           nth: str = "nth") -> DataFrame:
    """One row per element of an array: ``keep, nth, item``.

    An inner explode would make the optimizer test the size of the array in a
    filter below, and so compute an expensive array twice.
    """
    return df.select(*keep, F.posexplode_outer(items).alias(nth, item)).where(F.col(nth).isNotNull())


def unnest_fields(df: DataFrame, keep: list, items: Column | str) -> DataFrame:
    """One row per struct of an array, its fields as columns."""
    rows = unnest(df, keep, items)
    return rows.select(*[c for c in rows.columns if c not in ("nth", "m")], "m.*")


def blocks(items: Column, size: int = _BLOCK) -> Column:
    """Cut an array into arrays of at most ``size`` elements."""
    return let(
        items,
        lambda a: F.when(F.size(a) > 0, F.transform(
            F.sequence(F.lit(0), ((F.size(a) - 1) / size).cast("int")),
            lambda b: F.slice(a, b * size + 1, F.lit(size)),
        )).otherwise(F.array()),
    )


def scan(items: Column, initial: Column, step: Callable[[Column, Column], Column]) -> Column:
    """All states of a left fold: ``[initial, step(initial, x0), ...]``.

    The result has one element more than ``items``.
    """
    def run_block(done: Column, block: Column) -> Column:
        start = F.slice(F.element_at(done, -1), -1, 1)
        states = F.aggregate(
            block, start, lambda acc, x: F.array_append(acc, step(F.element_at(acc, -1), x)))
        return F.array_append(done, states)

    def flat(done: Column) -> Column:
        # Each block repeats the last state of the block before it.
        return F.flatten(F.transform(
            done, lambda part, i: F.when(i == 0, part).otherwise(
                F.slice(part, F.lit(2), F.lit(_BLOCK)))))

    return F.aggregate(blocks(items), F.array(F.array(initial)), run_block, flat)


def prefix_sums(lengths: Column) -> Column:
    """Running totals of an array of BIGINT, starting with 0."""
    return scan(lengths, F.lit(0).cast("bigint"), lambda total, x: total + x)


def _pieces(text: Column, pattern: str, groups: int) -> Column:
    """``array<struct<gap, matched, g1..gn>>``: each match with the text
    between the previous one and it, then the rest of the text with a null
    match."""
    parts = [F.split(text, pattern, -1).alias("gap")]
    names = ["matched"] + [f"g{i}" for i in range(1, groups + 1)]
    for i, name in enumerate(names):
        parts.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(name))
    return F.arrays_zip(*parts)


def segments(text: Column, pattern: str, groups: int = 0) -> Column:
    """Non-overlapping leftmost matches with the gap before each.

    The pattern must not match the empty string.
    """
    return F.filter(_pieces(text, pattern, groups), lambda p: p["matched"].isNotNull())


def replaced(text: Column, pattern: str, replacement: Callable[[Column], Column],
             groups: int = 0) -> Column:
    """Text with each match replaced; ``replacement`` gets the match."""
    return F.array_join(F.transform(
        _pieces(text, pattern, groups),
        lambda p: F.when(p["matched"].isNull(), p["gap"]).otherwise(
            F.concat(p["gap"], replacement(p)))), "")


def tail(text: Column, pattern: str) -> Column:
    """Text after the last match of ``pattern``."""
    return F.element_at(F.split(text, pattern, -1), -1)


def spans(text: Column, pattern: str, groups: int = 0) -> Column:
    """Matches with offsets: ``array<struct<start, end, matched, g1..gn>>``."""
    extra = [f"g{i}" for i in range(1, groups + 1)]

    def place(segs: Column) -> Column:
        totals = prefix_sums(F.transform(
            segs, lambda s: (F.length(s["gap"]) + F.length(s["matched"])).cast("bigint")))
        return F.zip_with(segs, let(totals, lambda t: F.slice(t, F.lit(1), F.size(t) - 1)),
                          lambda s, base: F.struct(
                              (base + F.length(s["gap"])).alias("start"),
                              (base + F.length(s["gap"]) + F.length(s["matched"])).alias("end"),
                              s["matched"].alias("matched"),
                              *[s[g].alias(g) for g in extra]))

    return let(segments(text, pattern, groups), place)


def line_spans(text: Column) -> Column:
    """Lines as ``array<struct<line_no, start, end, line>>``; ``line_no``
    starts at 1 and ``end`` is the offset of the newline."""
    def place(lines: Column) -> Column:
        totals = prefix_sums(F.transform(lines, lambda s: (F.length(s) + 1).cast("bigint")))
        return F.transform(
            F.arrays_zip(lines.alias("line"),
                         let(totals, lambda t: F.slice(t, F.lit(1), F.size(t) - 1)).alias("start")),
            lambda z, i: F.struct(
                (i + 1).alias("line_no"), z["start"].alias("start"),
                (z["start"] + F.length(z["line"])).alias("end"), z["line"].alias("line")))

    return let(F.split(text, "\n", -1), place)


def counts_before(targets: Column, events: Column) -> Column:
    """For each target the number of events at or before it.

    Both are ``array<bigint>``; targets are sorted, and so is the result.  The
    places are merged by one sort of numbers (events even, targets odd), and a
    target's rank among all less its rank among targets is the count.
    """
    merged = F.sort_array(F.concat(F.transform(events, lambda e: e * 2),
                                   F.transform(targets, lambda t: t * 2 + 1)))
    ranks = F.filter(F.transform(merged, lambda x, i: F.when(x % 2 != 0, i)), lambda i: i.isNotNull())
    return F.transform(ranks, lambda i, k: i - k)


def asof(targets: Column, target_at: Callable[[Column], Column], events: Column,
         event_at: Callable[[Column], Column], add: Callable[[Column, Column], Column]) -> Column:
    """``add(target, event)`` with the last event at or before each target,
    or with null where no event precedes it.  Targets are sorted by place, events too."""
    def pick(ts: Column, es: Column) -> Column:
        counts = counts_before(F.transform(ts, lambda t: target_at(t).cast("bigint")),
                               F.transform(es, lambda e: event_at(e).cast("bigint")))
        return F.zip_with(ts, counts, lambda t, n: add(t, F.get(es, n - 1)))

    return let(targets, lambda ts: let(events, lambda es: pick(ts, es)))


def splice(text: Column, edits: Column) -> Column:
    """Apply ``array<struct<start, end, repl>>``, sorted and not overlapping.

    The text is cut once per block of edits, so a text with many edits is not
    walked from its start for each of them.
    """
    def with_previous(es: Column) -> Column:
        previous = F.concat(F.array(F.lit(0).cast("bigint")),
                            F.transform(es, lambda e: e["end"].cast("bigint")))
        return F.zip_with(es, F.slice(previous, F.lit(1), F.size(es)),
                          lambda e, prev: F.struct(
                              prev.alias("prev"), e["start"].cast("bigint").alias("start"),
                              e["end"].cast("bigint").alias("end"), e["repl"].alias("repl")))

    def cut(piece: Column, start: Column, size: Column) -> Column:
        return F.substring(piece, (start + 1).cast("int"), size.cast("int"))

    def write(block: Column) -> Column:
        base = F.element_at(block, 1)["prev"]
        last = F.element_at(block, -1)["start"]
        return let(cut(text, base, last - base), lambda piece: F.array_join(F.transform(
            block, lambda e: F.concat(cut(piece, e["prev"] - base, e["start"] - e["prev"]),
                                      e["repl"])), ""))

    rest = F.when(F.size(edits) > 0, F.substring(
        text, (F.element_at(edits, -1)["end"] + 1).cast("int"), F.length(text))).otherwise(text)
    return F.concat(F.array_join(
        F.transform(blocks(let(edits, with_previous)), write), ""), rest)
