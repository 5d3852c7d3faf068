"""Embedding near-dedup: spherical k-means cells, blocked cosines, one kept per group."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import Scratch, group_runs, group_starts, usable

COSINE = 0.98
# A label with more classes than this is cut into cells, unless that made more
# than MAX_CELLS cells of the whole table: then cells are larger.
CELL_ROWS = 2048
MAX_CELLS = 16384
# Sampled vectors for each centroid, and rounds of k-means.
SAMPLE_PER_CELL = 64
ROUNDS = 6
# Members of a cell are compared in tiles of this many by this many.
TILE = 1024


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Unit rows, in double precision, of a column of equally long lists."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)
    # Scaled first, so that squares neither overflow nor vanish.
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    rng = np.random.default_rng(5)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norms = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-300)[:, None], centres)
    return centres


def _fit(classes: DataFrame, total: int) -> dict[tuple, np.ndarray]:
    """Centroids of each group that is cut.  Groups of at most ``rows`` classes
    stay whole, so at most ``total / rows`` groups are cut, into at most
    2 x MAX_CELLS cells in all: that bounds what is sent to the tasks."""
    rows = max(CELL_ROWS, math.ceil(total / MAX_CELLS))
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > rows)
    sizes = sizes.select(F.col("label").alias("l"), F.col("dim").alias("d"), F.col("n").alias("all"),
                         F.ceil(F.col("n") / rows).cast("int").alias("cells"))
    share = F.col("cells") * SAMPLE_PER_CELL / F.col("all")
    sample = classes.join(sizes, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d"))).where(
        F.pmod(F.xxhash64(F.lit(3), "class"), F.lit(1 << 20)) < share * (1 << 20))
    sample = sample.select("label", "dim", "cells", "embedding").repartition("label", "dim").sortWithinPartitions(
        "label", "dim")

    def fit(batches):
        for table in group_runs(batches, ["label", "dim"]):
            starts = group_starts(table, ["label", "dim"])
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
                part = table.slice(s, e - s)
                centres = _spherical_kmeans(_matrix(part.column("embedding")), part.column("cells")[0].as_py())
                yield pa.RecordBatch.from_arrays(
                    [part.column("label").combine_chunks()[:1], part.column("dim").combine_chunks()[:1],
                     pa.array([centres.tobytes()], pa.binary())], names=["label", "dim", "centres"])

    kind = dict(classes.dtypes)["label"]
    found = sample.mapInArrow(fit, f"label {kind}, dim int, centres binary").collect()
    return {(r["label"], r["dim"]): np.frombuffer(bytes(r["centres"])).reshape(-1, r["dim"]) for r in found}


def _members(classes: DataFrame, centres: dict[tuple, np.ndarray], cosine: float) -> DataFrame:
    """``class, label, dim, cell, home``: each class in its nearest cell and, as
    a visitor, in every later cell that can hold a partner.

    Partners are at most ``reach`` apart on the unit sphere.  If x is nearest to
    c and its partner to c', x is at most ``reach`` from the plane half-way
    between c and c'; so the test below loses no pair."""
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    kinds = dict(classes.dtypes)

    def assign(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            labels, dims = table.column("label").to_pylist(), table.column("dim").to_pylist()
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(labels, dims)):
                groups.setdefault(key, []).append(i)
            index, cell, home = [], [], []
            for key, rows in groups.items():
                rows = np.array(rows)
                c = centres.get(key)
                if c is None:
                    index.append(rows)
                    cell.append(np.zeros(len(rows), np.int32))
                    home.append(np.ones(len(rows), bool))
                    continue
                between = np.sqrt(np.maximum(0.0, 2 - 2 * (c @ c.T)))
                near = _matrix(table.column("embedding").take(pa.array(rows))) @ c.T
                own = near.argmax(axis=1)
                margin = near[np.arange(len(rows)), own][:, None] - near
                visits = (margin <= reach * between[own]) & (np.arange(len(c))[None, :] > own[:, None])
                r, v = np.nonzero(visits)
                index += [rows, rows[r]]
                cell += [own.astype(np.int32), v.astype(np.int32)]
                home += [np.ones(len(rows), bool), np.zeros(len(r), bool)]
            if not index:
                continue
            out = table.take(pa.array(np.concatenate(index))).append_column(
                "cell", pa.array(np.concatenate(cell))).append_column("home", pa.array(np.concatenate(home)))
            yield from out.combine_chunks().to_batches()

    return classes.select("class", "n", "label", "dim", "embedding").mapInArrow(
        assign, f"class long, n long, label {kinds['label']}, dim int, embedding {kinds['embedding']}, "
                "cell int, home boolean")


def _compare(members: DataFrame, cosine: float, tile: int) -> DataFrame:
    """``a, b, links``: for a class and one tile, a class it is connected with
    (the least of the tile; itself if none) and how many rows it links to.

    A cell with more than ``tile`` members is cut into parts by a hash, and
    each pair of parts is a tile of its own."""
    cell = ["label", "dim", "cell"]
    sizes = members.groupBy(*cell).agg(F.count("*").alias("m")).where(F.col("m") > 1).select(
        *[F.col(c).alias(f"s_{c}") for c in cell], F.ceil(F.col("m") / tile).cast("int").alias("parts"))
    on = (F.col("label") == F.col("s_label")) & (F.col("dim") == F.col("s_dim")) & (F.col("cell") == F.col("s_cell"))
    placed = members.join(sizes, on).select(
        *cell, "class", "n", "embedding", "home", "parts",
        F.pmod(F.xxhash64(F.lit(13), "class"), F.col("parts")).cast("int").alias("p"))
    tiles = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o")).select(
        *cell, F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "p", "class", "n", "embedding", "home")
    keys = [*cell, "i", "j"]
    ordered = tiles.repartition(*keys).sortWithinPartitions(*keys, "p", "class")

    def compare(batches):
        for table in group_runs(batches, keys):
            starts = group_starts(table, keys)
            out = [], [], []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
                part = table.slice(s, e - s)
                x = _matrix(part.column("embedding"))
                ids, n = part.column("class").to_numpy(), part.column("n").to_numpy()
                home, p = part.column("home").to_numpy(zero_copy_only=False), part.column("p").to_numpy()
                i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
                # Rows are sorted by part: the first part against the second, or itself.
                cut = len(ids) if i == j else int(np.searchsorted(p, j))
                left, right = slice(0, cut), slice(0, cut) if i == j else slice(cut, len(ids))
                near = (x[left] @ x[right].T) >= cosine
                near &= home[left][:, None] | home[right][None, :]
                if i == j:
                    np.fill_diagonal(near, False)
                r, c = np.nonzero(near)
                if not len(r):
                    continue
                r, c = r + left.start, c + right.start
                if i != j:
                    r, c = np.concatenate([r, c]), np.concatenate([c, r])
                links = np.bincount(r, weights=n[c], minlength=len(ids)).astype(np.int64)
                label = np.arange(len(ids))
                while True:
                    low = label.copy()
                    np.minimum.at(low, r, label[c])
                    low = low[low]
                    if (low == label).all():
                        break
                    label = low
                hit = np.flatnonzero(links)
                out[0].append(ids[hit])
                out[1].append(ids[label[hit]])
                out[2].append(links[hit])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["a", "b", "links"])

    return ordered.mapInArrow(compare, "a long, b long, links long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                    label: str = "label", cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row.

    Rows of one label link when their cosine, in double precision, is at least
    ``cosine``.  ``n_links`` counts other rows linked directly; ``component_id``
    is the smallest id that links reach, the row's own included; ``kept`` marks
    the row with that id.  Rows with equal label and vector are one class before
    any comparison, so copies, however many, cost nothing.  Rows whose vector
    is null, empty, zero or has a null or non-finite component, and rows
    without a label, link with nothing; vectors of different length don't
    link.  Null ids are linked and counted but are never the smallest; repeated
    rows are rows of their own.  An empty table gives none.
    """
    scratch = Scratch(vectors.sparkSession, "neardup")
    v = F.col(f"`{embedding}`")
    rows = vectors.select(F.col(f"`{vec_id}`").alias("id"), v.alias("embedding"), F.col(f"`{label}`").alias("label"))
    rows = rows.select("*", (F.col("label").isNotNull() & usable(F.col("embedding"))).alias("ok"))
    good = rows.where("ok")
    classes = good.groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("n")).select(
        "label", "embedding", "rep", "n", F.size("embedding").alias("dim"),
        F.monotonically_increasing_id().alias("class"))
    classes = scratch.keep(classes, "classes")
    centres = _fit(classes, classes.count())
    found = scratch.keep(_compare(_members(classes, centres, cosine), cosine, tile), "found")
    joined = components(found.select("a", "b"), scratch)
    counts = found.groupBy("a").agg(F.sum("links").alias("others"))
    linked = classes.select("class", "rep").join(joined, F.col("class") == F.col("node"))
    least = linked.groupBy("component").agg(F.min("rep").alias("least")).withColumnRenamed("component", "c")
    moved = linked.join(least, F.col("component") == F.col("c")).select(F.col("class").alias("moved"), "least")
    answers = (classes.join(counts, F.col("class") == F.col("a"), "left")
               .join(moved, F.col("class") == F.col("moved"), "left")
               .select(F.col("label").alias("l"), F.col("embedding").alias("e"),
                       (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                       F.when(F.col("moved").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id")))
    answers = scratch.keep(answers, "answers")
    with_links = good.join(answers, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e"))).select(
        "id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"),
                                            F.col("id").alias("component_id"))
    return with_links.unionByName(alone).select(
        F.col("id").alias(vec_id), "n_links", "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
