"""Approximate nearest neighbours: a navigable small-world graph per shard.

Vectors are dealt to shards by a hash.  A shard's graph is kept as one row of
flat arrays; each block of queries is searched in each shard and the results of
the shards are merged.  Nearness is the inner product.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch, usable

# Distinct vectors a shard, and queries a block: what one task holds.
SHARD_ROWS = 8192
QUERY_ROWS = 4096
# Links of a node in the upper layers (twice as many in the lowest), candidates
# that a new node chooses its links from, and width of the search.
LINKS = 16
BUILD_WIDTH = 64
SEARCH_WIDTH = 100
# Nodes that are put into the graph, and queries that are searched, at a time.
STEP = 256


def _diverse(near: np.ndarray, ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Links for each row of candidates: the nearest first, leaving out those
    nearer to a link than to the node; free places go to the nearest left out.

    ``near`` and ``ids`` are (rows, candidates), best first; -1 marks none."""
    rows, width = ids.shape
    points = x[np.maximum(ids, 0)]
    between = points @ points.transpose(0, 2, 1)
    kept = np.zeros((rows, width), bool)
    count = np.zeros(rows, np.int64)
    for j in range(width):
        blocked = (kept & (between[:, j, :] > near[:, j, None])).any(axis=1)
        kept[:, j] = (ids[:, j] >= 0) & ~blocked & (count < most)
        count += kept[:, j]
    # Kept ones first, then the others, both by nearness.
    order = np.argsort(~kept * width + np.arange(width), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, axis=1)


def _layer(x: np.ndarray, members: np.ndarray, most: int, width: int) -> np.ndarray:
    """Neighbour array (all nodes, ``most``) of one layer; -1 fills.

    Members go in one after another: each links to a diverse choice of the
    nearest that are in already, which gives early members far links.  The
    candidates come from one matrix product over the shard, which holds a bounded
    number of vectors, instead of a walk on the half-built graph."""
    out = np.full((len(x), most), -1, np.int32)
    forward = np.full((len(members), most), -1, np.int64)
    v = x[members]
    for s in range(0, len(members), STEP):
        e = min(s + STEP, len(members))
        near = v[s:e] @ v[:e].T
        near[np.arange(e)[None, :] >= np.arange(s, e)[:, None]] = -np.inf
        k = min(width, e)
        ids = np.argpartition(-near, k - 1, axis=1)[:, :k]
        got = np.take_along_axis(near, ids, axis=1)
        order = np.argsort(-got, axis=1, kind="stable")
        ids, got = np.take_along_axis(ids, order, axis=1), np.take_along_axis(got, order, axis=1)
        ids[got == -np.inf] = -1
        links = _diverse(got, ids, v, most // 2)
        forward[s:e, :links.shape[1]] = links
    # Links both ways; nodes with too many keep a diverse choice.
    a = np.repeat(np.arange(len(members)), most)
    b = forward.ravel()
    a, b = a[b >= 0], b[b >= 0]
    near = np.einsum("ij,ij->i", v[a], v[b])
    a, b, near = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([near, near])
    order = np.lexsort((-near, a))
    a, b, near = a[order], b[order], near[order]
    starts = np.searchsorted(a, np.arange(len(members) + 1))
    place = np.arange(len(a)) - starts[a]
    wide = min(4 * most, int(np.diff(starts).max(initial=1)))
    ids, got = np.full((len(members), wide), -1, np.int64), np.full((len(members), wide), -np.inf)
    inside = place < wide
    ids[a[inside], place[inside]], got[a[inside], place[inside]] = b[inside], near[inside]
    for s in range(0, len(members), STEP):
        links = _diverse(got[s:s + STEP], ids[s:s + STEP], v, most)
        out[members[s:s + STEP], :links.shape[1]] = np.where(links >= 0, members[np.maximum(links, 0)], -1)
    return out


def build(vectors: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH) -> tuple[list[np.ndarray], int]:
    """Neighbour arrays of the layers, lowest first, and the entry node.

    For inner products the vectors get one more component that makes them
    equally long; then the nearest is the one with the largest product."""
    norms = (vectors * vectors).sum(axis=1)
    x = np.hstack([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]])
    rng = np.random.default_rng(17)
    level = np.minimum(np.floor(-np.log(1 - rng.random(len(x))) / math.log(links)).astype(np.int64), 8)
    order = rng.permutation(len(x))
    entry = int(order[level[order].argmax()])
    return [_layer(x, order[level[order] >= k], links * (2 if k == 0 else 1), width)
            for k in range(int(level.max()) + 1)], entry


def search(vectors: np.ndarray, layers: list[np.ndarray], entry: int, queries: np.ndarray,
           width: int = SEARCH_WIDTH) -> np.ndarray:
    """Nodes found for each query, about ``width``, in no order; -1 fills."""
    x, out = vectors.astype(np.float32), []
    for s in range(0, len(queries), STEP):
        q = queries[s:s + STEP].astype(np.float32)
        now = np.full(len(q), entry)
        for layer in layers[:0:-1]:
            best = np.einsum("ij,ij->i", q, x[now])
            moving = np.ones(len(q), bool)
            while moving.any():
                ids = layer[now]
                near = np.einsum("ij,ikj->ik", q, x[np.maximum(ids, 0)])
                near[ids < 0] = -np.inf
                j = near.argmax(axis=1)
                top = near[np.arange(len(q)), j]
                moving = top > best
                now = np.where(moving, ids[np.arange(len(q)), j], now)
                best = np.maximum(best, top)
        out.append(_beam(x, layers[0], now, q, min(width, len(x))))
    return np.concatenate(out)


def _beam(x: np.ndarray, layer: np.ndarray, entry: np.ndarray, q: np.ndarray, width: int, at_once: int = 4
          ) -> np.ndarray:
    rows = np.arange(len(q))[:, None]
    seen = np.zeros((len(q), len(x) + 1), bool)
    ids = np.full((len(q), width), -1, np.int64)
    near = np.full((len(q), width), -np.inf, np.float32)
    open_ = np.zeros((len(q), width), bool)
    ids[:, 0], near[:, 0], open_[:, 0] = entry, np.einsum("ij,ij->i", q, x[entry]), True
    seen[rows[:, 0], entry] = True
    while open_.any():
        waiting = np.where(open_, near, -np.inf)
        pick = np.argpartition(-waiting, min(at_once, width) - 1, axis=1)[:, :at_once]
        chosen = np.where(np.take_along_axis(open_, pick, axis=1), np.take_along_axis(ids, pick, axis=1), -1)
        np.put_along_axis(open_, pick, False, axis=1)
        new = np.where(chosen[:, :, None] >= 0, layer[np.maximum(chosen, 0)], -1).reshape(len(q), -1)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[seen[rows, new]] = -1
        a, b = np.nonzero(new >= 0)
        if len(a):
            found = new[a, b]
            seen[a, found] = True
            got = np.full(new.shape, -np.inf, np.float32)
            got[a, b] = np.einsum("ij,ij->i", q[a], x[found])
            ids = np.concatenate([ids, new], axis=1)
            near = np.concatenate([near, got], axis=1)
            open_ = np.concatenate([open_, new >= 0], axis=1)
            best = np.argpartition(-near, width - 1, axis=1)[:, :width]
            ids, near, open_ = (np.take_along_axis(z, best, axis=1) for z in (ids, near, open_))
    return ids


def _rows(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def build_index(vectors: DataFrame, keep_ids: int, scratch: Scratch, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index of all usable rows of ``vec_id, embedding``: one row a shard.

    Columns: ``dim, shard, entry, n``, the vectors, the layers (``sizes`` has
    the links of each) and, for each vector, the smallest ids of the rows that
    have it (``keep_ids`` at most; the places in ``starts``).  Equal vectors
    are one node, so copies don't crowd the graph; which ids are smallest is
    found per salt first, so a common vector is spread over tasks.
    """
    good = vectors.where(usable(F.col("embedding"))).select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    good = good.select("*", F.xxhash64("embedding").alias("h"), F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt"))
    first = Window.partitionBy("h", "embedding", "salt").orderBy(F.col("vec_id").asc_nulls_last())
    then = Window.partitionBy("h", "embedding").orderBy(F.col("vec_id").asc_nulls_last())
    few = good.select("*", F.row_number().over(first).alias("r")).where(F.col("r") <= keep_ids)
    few = few.select("h", "embedding", "vec_id", F.row_number().over(then).alias("n")).where(F.col("n") <= keep_ids)
    nodes = scratch.keep(few.groupBy("h", "embedding").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    shards = max(1, math.ceil(nodes.count() / shard_rows))
    placed = nodes.select(F.size("embedding").alias("dim"), F.pmod(F.col("h"), F.lit(shards)).cast("int").alias("shard"),
                          "h", "embedding", "ids")

    def make(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h", kind="stable")
        x = _rows(rows["embedding"])
        layers, entry = build(x)
        ids = [np.asarray(i, np.int64) for i in rows["ids"]]
        return pd.DataFrame([{
            "dim": key[0], "shard": key[1], "entry": entry, "n": len(x), "vectors": x.tobytes(),
            "sizes": [z.shape[1] for z in layers], "layers": [z.tobytes() for z in layers],
            "starts": np.cumsum([0, *map(len, ids)]).astype(np.int64).tobytes(),
            "ids": np.concatenate(ids).tobytes()}])

    index = placed.groupBy("dim", "shard").applyInPandas(
        make, "dim int, shard int, entry int, n int, vectors binary, sizes array<int>, layers array<binary>, "
              "starts binary, ids binary")
    return scratch.keep(index, "index")


def nearest(index: DataFrame, queries: DataFrame, k: int, scratch: Scratch, query_rows: int = QUERY_ROWS,
            width: int = SEARCH_WIDTH) -> DataFrame:
    """``query_id, rank, vec_id, score`` for queries ``query_id, embedding``.

    Each block of queries meets each shard of its dimension in a task of its
    own.  A query's own id is no candidate.  Scores are computed anew in double
    precision; ties go to the smaller id."""
    asked = queries.where(usable(F.col("embedding"))).select(
        "query_id", F.col("embedding").cast("array<double>").alias("embedding")).distinct()
    asked = scratch.keep(asked.select("*", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("h")), "asked")
    blocks = max(1, math.ceil(asked.count() / query_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "h"), F.lit(blocks)).cast("int"))
    shards = index.select(F.col("dim").alias("d"), F.col("shard").alias("s"))
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # One row per shard and block: bounded by what the search itself has to look at.
    right = asked.join(shards, F.col("dim") == F.col("d")).select("dim", F.col("s").alias("shard"), "block", "query_id", "h", "embedding")

    def look(key, shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "h": pd.Series([], dtype="int64"),
                              "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        if not len(shard) or not len(block):
            return empty
        s = shard.iloc[0]
        x = np.frombuffer(s["vectors"]).reshape(s["n"], key[0])
        layers = [np.frombuffer(z, np.int32).reshape(-1, m) for z, m in zip(s["layers"], s["sizes"])]
        starts, ids = np.frombuffer(s["starts"], np.int64), np.frombuffer(s["ids"], np.int64)
        q = _rows(block["embedding"])
        found = search(x, layers, int(s["entry"]), q, max(width, k + 1))
        out = []
        for i, own in enumerate(block["query_id"].to_numpy()):
            nodes = found[i][found[i] >= 0]
            score = x[nodes] @ q[i]
            best = np.argsort(-score, kind="stable")[:2 * k + 2]
            nodes, score = nodes[best], score[best]
            count = starts[nodes + 1] - starts[nodes]
            at = np.repeat(starts[nodes] - np.cumsum(count) + count, count) + np.arange(count.sum())
            vec, score = ids[at], np.repeat(score, count)
            other = vec != own
            vec, score = vec[other], score[other]
            order = np.lexsort((vec, -score))[:k]
            out.append(pd.DataFrame({"query_id": own, "h": block["h"].iloc[i], "vec_id": vec[order], "score": score[order]}))
        return pd.concat(out, ignore_index=True) if out else empty

    found = (left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block"))
             .applyInPandas(look, "query_id long, h long, vec_id long, score double"))
    best = Window.partitionBy("query_id", "h").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def search_table(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id",
                 embedding: str = "embedding", **options) -> DataFrame:
    """Index all rows of ``vectors`` and search those of ``queries`` (same columns).

    Vectors that are null, empty, zero or have null or non-finite components,
    and rows without an id, take no part.  Vectors are compared with those of
    the same length.  Copies of a vector are candidates each, the smallest ids
    first; of repeated rows with one id each is a candidate.  A query with
    fewer candidates gets them all; no query, no rows.
    """
    scratch = Scratch(vectors.sparkSession, "hnsw")
    named = lambda df: df.where(F.col(f"`{vec_id}`").isNotNull())
    rows = named(vectors).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("embedding"))
    asked = named(queries).select(F.col(f"`{vec_id}`").cast("long").alias("query_id"), F.col(f"`{embedding}`").alias("embedding"))
    index = build_index(rows, k + 1, scratch, **options)
    return nearest(index, asked, k, scratch)
