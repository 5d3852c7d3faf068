"""Runs of repeated word sequences inside a text.

A run is a stretch of consecutive words with smallest period ``q`` that is at
least ``least_length`` words and ``least_exponent`` periods long and that no
neighbouring word extends.  Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.

A suffix automaton takes the words one by one.  Its tree of suffix links is held
as a link-cut tree whose preferred paths are the states with the same last
occurrence.  After word ``i`` the path of the whole prefix is accessed: each
piece of it was last seen at an end ``e`` and holds strings of up to ``L`` words.
If the distance ``i - e`` is at most ``L``, the piece ends in a square of that
period, which goes ``L`` words back from ``e`` and no further; the distance is
its smallest period.  The same stretch is met again at each later word until
the run ends, so its last ``i`` is the end of the run.  The work is
O(n log n) steps for n words, however long the runs are.

Before that, words that can't be in a run are cut out: a word of a run occurs
at least ``least_exponent`` times between two cuts.  This is a count over a
whole slice of texts at once, drops no run, and leaves the automaton the
stretches that may hold one.

Nulls and texts without a word have no runs; null texts have a null rest.
Repeated rows each give a row; an empty table gives an empty one.  Columns that
are not kept are not read, so their names don't clash.  A text is worked on
whole in one task, in memory proportional to its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import text_slices

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
# Cuts stop after so many rounds; what is left goes to the automaton.
ROUNDS = 8


def runs_of(words: list[int], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT
            ) -> list[tuple[int, int, int]]:
    """``start, length, period`` of each run of a sequence, by start and period.
    The exponent is at least 2."""
    following: list[dict[int, int]] = [{}]
    link, size = [0], [0]
    # The link-cut tree; 0 is no node, as the empty string is not looked at.
    left, right, up, seen = [0], [0], [0], [0]

    def splay(x: int) -> None:
        p = up[x]
        while p and (left[p] == x or right[p] == x):
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            top = up[g] if inner else g
            seen[x] = seen[g] if inner else seen[p]
            if inner:
                if left[g] == p:
                    if left[p] == x:
                        b = left[g] = right[p]
                        if b:
                            up[b] = g
                        right[p], up[g] = g, p
                        b = left[p] = right[x]
                        if b:
                            up[b] = p
                        right[x], up[p] = p, x
                    else:
                        b = right[p] = left[x]
                        if b:
                            up[b] = p
                        b = left[g] = right[x]
                        if b:
                            up[b] = g
                        left[x], right[x] = p, g
                        up[p] = up[g] = x
                elif right[p] == x:
                    b = right[g] = left[p]
                    if b:
                        up[b] = g
                    left[p], up[g] = g, p
                    b = right[p] = left[x]
                    if b:
                        up[b] = p
                    left[x], up[p] = p, x
                else:
                    b = left[p] = right[x]
                    if b:
                        up[b] = p
                    b = right[g] = left[x]
                    if b:
                        up[b] = g
                    right[x], left[x] = p, g
                    up[p] = up[g] = x
                if top:
                    if left[top] == g:
                        left[top] = x
                    elif right[top] == g:
                        right[top] = x
            else:
                if left[p] == x:
                    b = left[p] = right[x]
                    right[x] = p
                else:
                    b = right[p] = left[x]
                    left[x] = p
                if b:
                    up[b] = p
                up[p] = x
            up[x] = top
            p = top

    ends: dict[tuple[int, int], int] = {}
    times = least_exponent - 1
    last = 0
    for i, w in enumerate(words):
        new = len(link)
        following.append({})
        link.append(0)
        size.append(size[last] + 1)
        for column in (left, right, up, seen):
            column.append(0)
        p, at_root = last, False
        while w not in following[p]:
            following[p][w] = new
            if not p:
                at_root = True
                break
            p = link[p]
        if not at_root:
            q = following[p][w]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                # The copy stands right above q, on the same preferred path.
                copy = len(link)
                following.append(following[q].copy())
                link.append(link[q])
                size.append(size[p] + 1)
                splay(q)
                above = left[q]
                left.append(above)
                right.append(0)
                up.append(q)
                seen.append(0)
                if above:
                    up[above] = copy
                left[q] = copy
                link[q] = link[new] = copy
                while following[p].get(w) == q:
                    following[p][w] = copy
                    if not p:
                        break
                    p = link[p]
        up[new] = x = link[new]
        below = new
        while x:
            splay(x)
            gap, most = i - seen[x], size[x]
            if most >= gap * times and most + gap >= least_length:
                ends[i - most - gap + 1, gap] = i
            cut = right[x]
            if cut:
                seen[cut] = seen[x]
            right[x] = below
            below = x
            x = up[x]
        seen[below] = i
        splay(new)
        last = new
    return sorted((start, end - start + 1, period) for (start, period), end in ends.items())


def candidates(words: np.ndarray, text: np.ndarray, least_length: int, least_exponent: int
               ) -> list[tuple[int, int]]:
    """Stretches ``[from, to)`` of the words of many texts that may hold runs.

    Words that are rarer than a run's in their stretch are cut out until none
    is left or the rounds are over; every run is inside one stretch."""
    at = np.arange(len(words))
    n_words = int(words.max()) + 1 if len(words) else 1
    for _ in range(ROUNDS):
        if not len(at):
            return []
        stretch = np.cumsum(_starts(at, text)) - 1
        _, which, count = np.unique(stretch * n_words + words[at], return_inverse=True, return_counts=True)
        keep = (count[which] >= least_exponent) & (np.bincount(stretch)[stretch] >= least_length)
        if keep.all():
            break
        at = at[keep]
    if not len(at):
        return []
    begin = np.flatnonzero(_starts(at, text))
    end = np.append(begin[1:], len(at))
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(begin, end) if b - a >= least_length]


def _starts(at: np.ndarray, text: np.ndarray) -> np.ndarray:
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (text[at[1:]] != text[at[:-1]])
    return new


def word_runs(df: DataFrame, keep: list[str], text: str = "text", least_length: int = LEAST_LENGTH,
              least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """``keep, n_words, runs, collapsed``: the runs of each text as an array of
    ``start, length, period``, and its words joined by one space without those
    that a run holds after its first period."""
    read = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
                     F.col(f"`{text}`").cast("string").alias("text"))
    kept = len(keep)
    lists = ["starts", "lengths", "periods"]
    out = ", ".join([f"k{i} {dict(df.dtypes)[c]}" for i, c in enumerate(keep)] + ["n_words bigint"]
                    + [f"{c} array<bigint>" for c in lists] + ["collapsed string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(kept)):
                part = batch.slice(a, b - a)
                found = _of_slice(part.column(kept), least_length, least_exponent)
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], *found],
                                                 names=[*[f"k{i}" for i in range(kept)], "n_words", *lists, "collapsed"])

    done = read.mapInArrow(run, out)
    runs = F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length"), F.col("periods").alias("period"))
    shape = "array<struct<start:bigint,length:bigint,period:bigint>>"
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words",
                       runs.cast(shape).alias("runs"), "collapsed")


def _of_slice(texts: pa.Array, least_length: int, least_exponent: int) -> list[pa.Array]:
    split = pc.ascii_split_whitespace(texts)
    owner, words = pc.list_parent_indices(split), pc.list_flatten(split)
    some = pc.greater(pc.binary_length(words), 0)
    owner = np.asarray(owner.filter(some)).astype(np.int64)
    words = words.filter(some)
    ids = np.asarray(words.dictionary_encode().indices).astype(np.int64)
    n = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(n)])
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    dropped = np.zeros(len(ids) + 1, np.int64)
    for a, b in candidates(ids, owner, least_length, least_exponent):
        doc = int(owner[a])
        for start, length, period in runs_of(ids[a:b].tolist(), least_length, least_exponent):
            runs[doc].append((a + start - int(base[doc]), length, period))
            dropped[a + start + period] += 1
            dropped[a + start + length] -= 1
    left = np.cumsum(dropped[:-1]) == 0
    rest = words if left.all() else words.filter(pa.array(left))
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner[left], minlength=len(texts)))]).astype(np.int32)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), rest), " ")
    joined = pc.if_else(pc.is_valid(texts), joined, pa.scalar(None, joined.type))
    columns = [[[r[i] for r in found] for found in runs] for i in range(3)]
    return [pa.array(n), *[pa.array(c, pa.list_(pa.int64())) for c in columns], joined]


def best(runs: Column) -> Column:
    """The run with the greatest exact exponent; of ties the smallest start,
    then period; null without a run."""
    greater = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda held, r: F.when(held.isNull() | greater(r, held), r).otherwise(held))
