"""SimHash near-duplicates: fingerprints, pigeonhole blocks, components."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import Scratch, group_runs, group_starts, map_texts

# Fixed values of the contract: words a shingle, seed of the hash, bits that may differ.
SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
# A fingerprint is cut into this many blocks.  Two that differ in MAX_BITS bits
# agree in BLOCKS - MAX_BITS blocks, so each choice of so many is a join key
# (of about 32 bits here; more blocks make longer keys and more of them).
BLOCKS = 6
# Fingerprints that share a key are compared in tiles of this many.
TILE = 512


def fingerprint(data: bytes, words: int = SHINGLE_WORDS) -> int:
    """SimHash of a lower-cased text, as a signed 64-bit number.

    ``bytes.lower`` and ``bytes.split`` work on ASCII only, which is A-Z and
    the characters 0x20 and 0x09-0x0D."""
    import xxhash
    tokens = data.lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = iter([b" ".join(tokens)])
    else:
        shingles = map(b" ".join, zip(*[tokens[i:] for i in range(words)]))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``keep`` and ``fp`` of each whole text.  A text without words, or null, has 0."""
    def make():
        return lambda texts: {"fp": [fingerprint(t.encode(), words) if t else 0 for t in texts]}
    return map_texts(docs, keep, text, "fp long", make)


def block_masks(max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> list[int]:
    """Masks of all choices of ``blocks - max_bits`` blocks, as signed numbers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(c) for c in combinations(block, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(classes: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS, blocks: int = BLOCKS,
          tile: int = TILE) -> DataFrame:
    """``a, b``: enough verified links between distinct fingerprints ``fp`` to
    connect whatever differs in ``max_bits`` bits or fewer.

    Each fingerprint goes to one row per mask.  Keys of one row are dropped;
    keys with more than ``tile`` rows are cut into parts, and every pair of
    parts is a tile of its own, so that no key has to fit into a task.  A tile
    compares all its fingerprints but gives at most one link for each of them.
    """
    masks = F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("key"))
                      for i, m in enumerate(block_masks(max_bits, blocks))])
    rows = classes.select("fp", F.explode(masks).alias("x")).select("fp", "x.m", "x.key")
    sizes = rows.groupBy("m", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    shared = rows.join(sizes, ["m", "key"])
    parts = F.ceil(F.col("n") / tile).cast("int")
    part = F.pmod(F.xxhash64(F.lit(11), F.col("fp")), parts).cast("int")
    spread = shared.select("m", "key", "fp", part.alias("p"), parts.alias("parts")).select(
        "m", "key", "fp", "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o")).select(
        F.xxhash64("m", "key", F.least("p", "o"), F.greatest("p", "o")).alias("t"), "m", "key",
        F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "fp")
    keys = ["t", "m", "key", "i", "j"]
    tiles = spread.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)

    def compare(batches):
        for table in group_runs(batches, keys):
            a, b = _forest(table.column("fp").to_numpy(), group_starts(table, keys), max_bits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return scratch.keep(tiles.mapInArrow(compare, "a long, b long").distinct(), "links")


def _forest(fp: np.ndarray, starts: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """One link to the least reachable member for each member of each group."""
    u = fp.astype(np.int64).view(np.uint64)
    ends = np.append(starts[1:], len(fp))
    sizes = ends - starts
    two = starts[sizes == 2]
    near = np.bitwise_count(u[two] ^ u[two + 1]) <= max_bits
    out_a, out_b = [fp[two][near]], [fp[two + 1][near]]
    for s, e in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist()):
        g = u[s:e]
        label = np.arange(e - s)
        linked = [np.flatnonzero(np.bitwise_count(g ^ x) <= max_bits) for x in g]
        changed = True
        while changed:
            changed = False
            for i, others in enumerate(linked):
                low = label[others].min()
                if (label[others] > low).any():
                    label[others] = np.minimum(label[others], low)
                    changed = True
        moved = np.flatnonzero(label != np.arange(e - s))
        out_a.append(fp[s:e][moved])
        out_b.append(fp[s:e][label[moved]])
    return np.concatenate(out_a), np.concatenate(out_b)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """``doc_id, fp, component_id`` per row of ``docs``.

    Rows of equal fingerprint are one class before any comparison, so copies
    cost nothing.  ``component_id`` is the smallest id of the rows that links
    of ``max_bits`` bits or fewer reach, the row itself included; null ids count
    for links but not as the smallest (a component without any id has null).
    Texts that are null or without words have fingerprint 0 and link as any
    other.  Repeated rows come back as often as they came; no row, no result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    # Internal names can't clash: only the id and the text are read.
    rows = scratch.keep(fingerprints(docs, [doc_id], text, words).toDF("id", "fp"), "fingerprints", texts=True)
    classes = scratch.keep(rows.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    joined = components(links(classes.select("fp"), scratch, max_bits, blocks), scratch)
    linked = classes.join(joined, F.col("fp") == F.col("node"))
    least = linked.groupBy("component").agg(F.min("rep").alias("least")).withColumnRenamed("component", "c")
    moved = linked.join(least, F.col("component") == F.col("c")).select(F.col("fp").alias("f"), "least")
    moved = scratch.keep(moved, "moved")
    smallest = classes.join(moved, F.col("fp") == F.col("f"), "left").select(
        F.col("fp").alias("f"), F.when(F.col("f").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"))
    return (rows.join(smallest, F.col("fp") == F.col("f"))
            .select(F.col("id").alias(doc_id), "fp", "component_id"))


def hexadecimal(fp: str = "fp"):
    """The 16 lower-case hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without all but one of each component: the one with the
    smallest id stays.  Rows without an id can't be named and all stay; of
    repeated rows with the kept id one stays."""
    found = near_duplicates(docs, doc_id, text, **options)
    keep = (found.where(F.col(doc_id) == F.col("component_id"))
            .select(F.col(doc_id).alias("__kept")).distinct())
    named = docs.where(F.col(f"`{doc_id}`").isNotNull())
    stay = named.join(keep, F.col(f"`{doc_id}`") == F.col("__kept"), "left_semi").dropDuplicates([doc_id])
    return stay.unionByName(docs.where(F.col(f"`{doc_id}`").isNull()))
