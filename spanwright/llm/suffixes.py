"""Suffix-array dedup: byte strings of a fixed length that occur more than once.

The index is a logarithmic family of sampled suffix arrays.  Of the suffixes of
all texts those are kept that start at the minimizer of a window of ``LENGTH``
bytes, so two equal windows, wherever they are, have the same suffix in the
index.  A suffix array is a table sorted by the first bytes of the suffix, then
by a fingerprint of its first ``prefix`` bytes, then by one of its surroundings;
equal strings are neighbours.  A new batch of texts is sorted, merge-scanned
with the levels that are there, and merged with levels of its size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

# Length of the strings, in bytes.
LENGTH = 200
# Bytes of a sampled suffix that are compared, round by round.  The first round
# runs on the texts; a later one on the surroundings of suffixes that equal
# another so far but not in all windows around them.  The last compares windows.
PREFIXES = (64, 160, LENGTH)
# Batches of one call; each is an addition to the index.
BATCHES = 2
# Bytes that are hashed at a time, and bits of a place in them.
SEGMENT = 1 << 18
PLACE = np.uint64((1 << 24) - 1)
# Where in a text a window starts, how many windows share a suffix, and a check
# on the text are one number: 22, 31 and 10 bits.
CHECK_BITS, LENGTH_BITS = 22, 10
CHECK_AT = 63 - CHECK_BITS


class Hasher:
    """Hashes of all substrings of a length, from prefix sums modulo 2^64."""

    def __init__(self, most: int = SEGMENT + 4 * LENGTH + 8):
        rng = np.random.default_rng(20)
        base = 0x9E3779B97F4A7C15
        self.byte = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.up = self._powers(base, most)
        self.down = self._powers(pow(base, -1, 1 << 64), most)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.byte[data] * self.up[:len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((sums[ends] - sums[starts]) * self.down[starts])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n - width + 1], before[width - 1:n])


def sample(data: np.ndarray, windows: np.ndarray, prefix: int, hasher: Hasher, length: int = LENGTH):
    """The sampled suffixes of a piece: ``key, context, first, count``.

    ``windows`` marks where a window of ``length`` bytes starts that counts.
    Windows that follow one another and have the same minimizer (the least hash
    of ``prefix`` bytes in them, the first of equal ones) share one suffix:
    ``count`` windows from ``first`` on.  ``key`` sorts by the first four
    bytes of the suffix, then by half the hash of its prefix; ``context`` is a
    hash of all bytes of these windows and of where the suffix is in them.
    """
    starts = np.flatnonzero(windows)
    sums = hasher.sums(data)
    at = np.arange(len(data) - prefix + 1)
    hashes = hasher.spans(sums, at, at + prefix)
    places = at.astype(np.uint64)
    picked = (_least((hashes & ~PLACE) | places, length - prefix + 1) & PLACE).astype(np.int64)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (picked[1:] != picked[:-1]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(new)
    count = np.diff(np.append(heads, len(starts)))
    first, suffix = starts[heads], picked[heads]
    context = hasher.spans(sums, first, first + count - 1 + length)
    context ^= _mixed(((suffix - first) << 12 | count).astype(np.uint64) + np.uint64(1))
    letters = np.zeros(len(suffix), np.uint64)
    for i in range(4):
        letters = letters << np.uint64(8) | data[suffix + i].astype(np.uint64)
    key = letters << np.uint64(32) | hashes[suffix] >> np.uint64(32)
    return (key ^ np.uint64(1 << 63)).view(np.int64), context.view(np.int64), first, count


def _pieces(texts: list[bytes], length: int):
    """``data, windows, owners, offsets``: texts joined, or cut, into pieces.

    A piece is some whole short texts or a segment of a long one; ``windows``
    marks starts of windows inside one text, ``owners`` has the text of each
    byte and ``offsets`` where in it the byte is."""
    held, size = [], 0

    def joined(parts):
        data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        sizes = np.array([len(p[2]) for p in parts])
        ends = np.cumsum(sizes)
        owners = np.repeat([p[0] for p in parts], sizes)
        offsets = np.arange(len(data)) - np.repeat(ends - sizes - np.array([p[1] for p in parts]), sizes)
        windows = np.arange(len(data)) + length <= np.repeat(ends, sizes)
        return data, windows, owners, offsets

    for i, text in enumerate(texts):
        for start in range(0, max(len(text) - length + 1, 0), SEGMENT):
            part = text[start:start + SEGMENT + length - 1]
            if held and size + len(part) > SEGMENT:
                yield joined(held)
                held, size = [], 0
            held.append((i, start, part))
            size += len(part)
    if held:
        yield joined(held)


SUFFIXES = "key long, context long, doc long, at long, base long"


def _suffixes(rows: DataFrame, prefix: int, length: int) -> DataFrame:
    """Sampled suffixes of ``doc, at, data``: a text, or the surroundings of the
    windows that ``at`` names.  ``base`` is the ``at`` of the row they are from."""
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            docs, ats = batch.column("doc").to_numpy(), batch.column("at").to_numpy()
            column, start = batch.column("data"), 0
            while start < len(docs):
                stop, held = start, []
                size = 0
                while stop < len(docs) and (stop == start or size < SEGMENT):
                    text = column[stop].as_py() or b""
                    held.append(text)
                    size += len(text)
                    stop += 1
                for data, windows, owners, offsets in _pieces(held, length):
                    key, context, first, count = sample(data, windows, prefix, hasher, length)
                    owner = owners[first] + start
                    base = ats[owner] >> LENGTH_BITS << LENGTH_BITS
                    at = base + (offsets[first] << LENGTH_BITS) + count - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(context), pa.array(docs[owner]), pa.array(at), pa.array(ats[owner])],
                        names=["key", "context", "doc", "at", "base"])
                start = stop

    return rows.select("doc", "at", F.col("data").cast("binary").alias("data")).mapInArrow(run, SUFFIXES)


ORDER = ["key", "context", "doc", "at"]


def _scan(rows: DataFrame, extra: tuple = ()) -> DataFrame:
    """Sort suffixes (``new``: of the batch, ``member``: to be kept whole) and
    compare neighbours of which one is new.

    ``whole``: a neighbour has the same windows around the same suffix, so all
    of them repeat.  ``part``: a neighbour has the same suffix, as far as it
    is compared, in other windows.  Some row of each set of equal windows gets
    it, which is enough to compare the sets.  The sort is a range partitioning by
    all columns: a string that occurs in a third of all texts fills many
    partitions.  ``edge`` marks the ends of partitions, whose neighbours are
    elsewhere.  ``extra`` numbers are carried along."""
    names = [*ORDER, "new", "member", *extra]
    ordered = rows.select(*names).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)

    def flagged(cells, whole, part, is_first, is_last):
        edge = np.zeros(len(whole), bool)
        edge[0] |= is_first
        edge[-1] |= is_last
        keep = cells[5] | whole | part | edge
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (*cells, whole, part, edge)],
                                          names=[*names, "whole", "part", "edge"])

    def run(batches):
        # The last row is held back until its next neighbour is seen.
        held, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            whole = part = np.zeros(batch.num_rows, bool)
            if held is not None:
                cells = [np.concatenate([h, c]) for h, c in zip(held, cells)]
                whole, part = (np.concatenate([h, whole]) for h in held[-2:])
            whole, part = _compared(cells[0], cells[1], cells[4], whole, part)
            last = len(whole) - 1
            if last:
                yield flagged([c[:last] for c in cells], whole[:last], part[:last], first, False)
                first = False
            held = [c[last:] for c in (*cells, whole, part)]
        if held is not None:
            yield flagged(held[:-2], *held[-2:], first, True)

    kinds = ", ".join([f"{c} long" for c in ORDER] + ["new boolean, member boolean"] + [f"{c} long" for c in extra])
    return ordered.mapInArrow(run, kinds + ", whole boolean, part boolean, edge boolean")


def _compared(key, context, new, whole, part):
    same = (key[1:] == key[:-1]) & (new[1:] | new[:-1])
    equal = same & (context[1:] == context[:-1])
    other = same & ~equal
    whole, part = whole.copy(), part.copy()
    for flags, found in ((whole, equal), (part, other)):
        flags[1:] |= found
        flags[:-1] |= found
    return whole, part


def _hits(scanned: DataFrame, extra: tuple = ()) -> DataFrame:
    """``doc, at, whole, part`` of a kept scan, with the edges compared too: two
    rows per partition, in one small window."""
    order = Window.orderBy(*ORDER)
    edges = scanned.where("edge").select("*", *[
        F.struct(*[move(c).over(order).alias(c) for c in ("key", "context", "new")]).alias(n)
        for n, move in (("prev", F.lag), ("next", F.lead))])

    def near(other: str, equal: bool) -> Column:
        same = (F.col(f"{other}.key") == F.col("key")) & (F.col("new") | F.col(f"{other}.new"))
        context = F.col(f"{other}.context") == F.col("context")
        return F.coalesce(same & (context if equal else ~context), F.lit(False))

    edges = edges.select("doc", "at", *extra, *[
        (F.col(n) | near("prev", equal) | near("next", equal)).alias(n) for n, equal in (("whole", True), ("part", False))])
    inner = scanned.where(~F.col("edge")).select("doc", "at", *extra, "whole", "part")
    return inner.unionByName(edges).where(F.col("whole") | F.col("part"))


class SuffixIndex:
    """Levels of sampled suffix arrays whose sizes, in batches, are distinct
    powers of two."""

    def __init__(self, scratch: Scratch):
        self.scratch = scratch
        self.levels: list[tuple[int, DataFrame, str]] = []
        self.added = 0

    def add(self, batch: DataFrame) -> DataFrame:
        """Put the suffixes of new texts in; their hits with each other and with
        all levels, on either side, as ``doc, at, whole, part``.

        The levels that the batch completes to a larger one go into the new
        table; of the others only hits are written.  The old tables are freed.
        """
        weight, merged = 1, []
        by_size = {size: (df, name) for size, df, name in self.levels}
        while weight in by_size:
            merged.append((weight, *by_size[weight]))
            weight *= 2
        kept = [level for level in self.levels if level[0] >= weight]
        true, false = F.lit(True), F.lit(False)
        rows = batch.select(*ORDER, true.alias("new"), true.alias("member"))
        for _, df, _ in merged:
            rows = rows.unionByName(df.select(*ORDER, false.alias("new"), true.alias("member")))
        for _, df, _ in kept:
            rows = rows.unionByName(df.select(*ORDER, false.alias("new"), false.alias("member")))
        self.added += 1
        name = f"level-{self.added}"
        table = self.scratch.keep(_scan(rows), name)
        hits = self.scratch.keep(_hits(table), f"hits-{self.added}")
        for _, df, old in merged:
            self.scratch.free(df, old)
        self.levels = [*kept, (weight, table.where("member").select(*ORDER), name)]
        return hits

    def close(self) -> None:
        """Free all levels."""
        for _, df, name in self.levels:
            self.scratch.free(df, name)
        self.levels = []


def _named(docs: DataFrame, doc_id: str, text: str, keep: list[str]) -> DataFrame:
    """``doc, check, data`` and the columns to keep as ``c0, c1, ...``.

    A text is named by its id (a hash of it, if there is none) and a check on
    the text, so rows that share an id are told apart."""
    data = F.coalesce(F.col(f"`{text}`").cast("string").cast("binary"), F.lit(b""))
    return docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.xxhash64(data)).alias("doc"),
                       F.hash(data).bitwiseAND(F.lit((1 << CHECK_BITS) - 1)).cast("long").alias("check"),
                       data.alias("data"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])


def _packed(named: DataFrame) -> DataFrame:
    """``data`` compressed, for the way through a shuffle."""
    kinds = ", ".join(f"{c} {kind}" for c, kind in named.dtypes)

    def run(batches):
        import zstandard
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            at = batch.schema.get_field_index("data")
            data = pa.array([packer.compress(x.as_py()) for x in batch.column(at)], pa.binary())
            yield batch.set_column(at, "data", data)

    return named.mapInArrow(run, kinds)


def _joined(packed: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    return packed.join(lists.select(F.col("doc").alias("d"), F.col("check").alias("k"), "found"),
                       (F.col("doc") == F.col("d")) & (F.col("check") == F.col("k")), how).drop("d", "k")


def _lists(hits: DataFrame) -> DataFrame:
    """``doc, check, found``: the places of each text, no more than it has bytes."""
    check = F.shiftrightunsigned("at", CHECK_AT)
    return hits.select("doc", check.alias("check"), "at").groupBy("doc", "check").agg(
        F.collect_set("at").alias("found"))


def _surroundings(rows: DataFrame, length: int) -> DataFrame:
    """``doc, at, data``: the bytes of the windows of each place in ``found``, cut
    from a text or surroundings that start at ``at``."""
    def run(batches):
        import zstandard
        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            docs, ats, out, size = [], [], [], 0
            for doc, base, packed, data, found in zip(*[batch.column(c) for c in ("doc", "at", "packed", "data", "found")]):
                data = reader.decompress(data.as_py()) if packed.as_py() else data.as_py()
                base, doc = base.as_py() >> LENGTH_BITS, doc.as_py()
                for at in found.as_py():
                    start = (at >> LENGTH_BITS) - base
                    docs.append(doc)
                    ats.append(at)
                    out.append(data[start:start + (at & ((1 << LENGTH_BITS) - 1)) + length])
                    size += len(out[-1])
                if size > SEGMENT:
                    yield rows_of(docs, ats, out)
                    docs, ats, out, size = [], [], [], 0
            yield rows_of(docs, ats, out)

    def rows_of(docs, ats, out):
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ats, pa.int64()), pa.array(out, pa.binary())],
                                          names=["doc", "at", "data"])

    return rows.select("doc", "at", "packed", "data", "found").mapInArrow(run, "doc long, at long, data binary")


def repeated_windows(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text",
                     length: int = LENGTH, prefixes: tuple = PREFIXES, batches: int = BATCHES) -> DataFrame:
    """``doc, check, at``: runs of windows that start a string of ``length``
    bytes which starts anywhere else too.

    A run whose surroundings all repeat is found in the first round.  Runs of
    which only a part repeats, at the ends of a repeat, go on with their
    surroundings (``length`` and some dozens of bytes each) to a round with a
    longer prefix, and last to a comparison of whole windows, so the answer
    is exact up to 96-bit hashes.
    """
    named = _named(docs, doc_id, text, [])
    check = F.shiftleft("check", CHECK_AT)
    first = named.where(F.octet_length("data") >= length).select("doc", check.alias("at"), "data")
    suffixes = scratch.keep(
        _suffixes(first, prefixes[0], length).withColumn("batch", F.pmod(F.xxhash64(F.lit(5), "doc"), F.lit(batches))),
        "suffixes", texts=True)
    index, hits = SuffixIndex(scratch), None
    for i in range(batches):
        found = index.add(suffixes.where(F.col("batch") == i))
        hits = found if hits is None else hits.unionByName(found)
    index.close()
    scratch.free(suffixes, "suffixes")
    whole = hits.where("whole").select("doc", "at")
    partial = hits.where("part")
    # Texts are needed only around what is left open.
    source = _joined(_packed(named), _lists(partial), "inner").select(
        "doc", check.alias("at"), F.lit(True).alias("packed"), "data", "found")
    around = None
    for n, prefix in enumerate(prefixes[1:], 1):
        before, around = around, scratch.keep(_surroundings(source, length), f"around-{n}", texts=True)
        if before is not None:
            scratch.free(before, f"around-{n - 1}")
        rows = _suffixes(around, prefix, length).select("*", F.lit(True).alias("new"), F.lit(False).alias("member"))
        scanned = scratch.keep(_scan(rows, ("base",)), f"scan-{n}")
        found = scratch.keep(_hits(scanned, ("base",)), f"refined-{n}")
        scratch.free(scanned, f"scan-{n}")
        whole = whole.unionByName(found.where("whole").select("doc", "at"))
        open_ = (found.where("part").groupBy("doc", "base").agg(F.collect_set("at").alias("found"))
                 .withColumnRenamed("doc", "d"))
        source = around.join(open_, (F.col("doc") == F.col("d")) & (F.col("at") == F.col("base"))).select(
            "doc", "at", F.lit(False).alias("packed"), "data", "found")
    return whole


def _cut(found: list[int] | None, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges that the runs of windows cover."""
    mask = (1 << LENGTH_BITS) - 1
    place = (1 << (CHECK_AT - LENGTH_BITS)) - 1
    out: list[tuple[int, int]] = []
    for a, b in sorted((at >> LENGTH_BITS & place, (at >> LENGTH_BITS & place) + (at & mask) + length) for at in found or ()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return [(a, min(b, size)) for a, b in out]


def without_repeats(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text",
                    with_text: bool = False, length: int = LENGTH, **options) -> DataFrame:
    """``keep`` and, per row: ``n_bytes``, ``n_removed``, ``n_spans`` (maximal
    removed runs), ``kept_sha256`` (lower-case hex) and, if asked for, ``kept``:
    the text that is left, without the rest of characters that were cut in two.

    Removed is each byte covered by a string of ``length`` bytes that also
    starts anywhere else, in the same text or another; strings overlap and are
    those of the input.  No string crosses texts.  A null text is empty; texts
    shorter than ``length`` lose nothing.  Repeated rows repeat all their
    strings and so lose them all.  Rows without an id are texts like others.
    An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    whole = repeated_windows(docs, scratch, doc_id, text, length, **options)
    named = _named(docs, doc_id, text, keep)
    rows = _joined(_packed(named), _lists(whole), "left").drop("doc", "check")
    kinds = dict(named.dtypes)
    names = [f"c{i}" for i in range(len(keep))]

    def run(batches):
        import zstandard
        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            out, size, start = [], 0, 0
            for i, (data, found) in enumerate(zip(batch.column("data"), batch.column("found"))):
                data = reader.decompress(data.as_py())
                ranges = _cut(found.as_py(), len(data), length)
                at, kept = 0, []
                for a, b in ranges:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest(),
                            kept.decode("utf-8", "ignore") if with_text else None))
                size += len(kept)
                if with_text and size > SEGMENT:
                    yield answer(batch.slice(start, i + 1 - start), out)
                    out, size, start = [], 0, i + 1
            if out:
                yield answer(batch.slice(start), out)

    def answer(batch, out):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][:5 if with_text else 4]
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in names], *[pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]],
            names=[*names, *answers])

    answers = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    schema = ", ".join([f"{c} {kinds[c]}" for c in names] + ["n_bytes long, n_removed long, n_spans long, kept_sha256 string"]
                       + (["kept string"] if with_text else []))
    return rows.select("data", "found", *names).mapInArrow(run, schema).toDF(*keep, *answers)
