"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells.

1. Equal vectors are one class; its smallest vec_id stands for it, with the number of copies.
2. Spherical k-means is fitted on the driver to a bounded sample of the classes (``sample`` rows at most).  Every
   class is then indexed: it goes to the ``probes`` nearest of the cells, whose number is bounded too.
3. A cell is cut into blocks of about ``block`` classes; every two blocks of a cell meet in one group, where a matrix
   product in double precision gives all cosines.  A pair that meets in several cells counts in the first only.
4. A group returns, for each class, how many vectors it is linked with and one edge to the smallest class of its
   component in that group: never the pairs themselves.  Edges are closed to components.

Links are found if two vectors share one of their ``probes`` cells; ``recall`` measures the share found against brute
force.  No link under the threshold is reported.  Vectors that are null, empty, zero or hold null or non-finite
components link with nothing.  Vectors of different lengths are not linked; those of an unusual length share one cell
for each length (modulo 64) and are compared exactly.  Repeated rows of a vec_id are vectors of their own that share an id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, need
from .components import connected_components

#: Rows, and bytes, that k-means may be fitted to.
SAMPLE = 32_768
SAMPLE_BYTES = 32 << 20
MOST_CELLS = 2_048
#: Classes for each cell.
PER_CELL = 64
PROBES = 4
BLOCK = 400


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids of unit vectors.  Starts from the first ``k`` rows; a cell without rows keeps its centroid."""
    centroids = x[:k].copy()
    for _ in range(rounds):
        nearest = np.concatenate([np.argmax(x[i : i + 4096] @ centroids.T, axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        norm = np.linalg.norm(sums, axis=1)
        centroids[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return centroids


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    # scaling first keeps squares of very large and very small components in range
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(centroids: np.ndarray, probes: int):
    k, dim = centroids.shape

    def run(batches):
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("v")])
            cells = np.full((batch.num_rows, probes), -1, np.int64)
            cells[:, 0] = -1 - sizes % 64
            usual = np.flatnonzero(sizes == dim)
            if len(usual):
                x = _matrix(batch.column("v").take(pa.array(usual)), dim)
                near = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, : min(probes, k)]
                cells[usual[:, None], np.arange(near.shape[1])] = near
                cells[usual[:, None], np.arange(near.shape[1], probes)] = near[:, :1]
            odd = sizes != dim
            cells[odd, 1:] = cells[odd, :1]
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * probes)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "copies", "v")), pa.ListArray.from_arrays(offsets, pa.array(cells.reshape(-1)))], ["rep", "copies", "v", "cells"])

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` nodes reaches over links (a, b)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


_OUT = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _compare(threshold: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cell, low, high = (k.as_py() for k in key)
        table = table.sort_by("rep")
        sizes = np.array([len(v) for v in table.column("v")])
        found = [_OUT.empty_table()]
        for dim in np.unique(sizes):
            rows = table.take(pa.array(np.flatnonzero(sizes == dim)))
            x, reps, copies, part = _matrix(rows.column("v"), int(dim)), *(rows.column(c).to_numpy() for c in ("rep", "copies", "part"))
            cells = rows.column("cells").combine_chunks().flatten().to_numpy().reshape(len(reps), -1)
            left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
            hit = x[left] @ x[right].T >= threshold
            i, j = np.nonzero(np.triu(hit, 1) if low == high else hit)
            i, j = left[i], right[j]
            keep = np.zeros(len(i), bool)
            for at in range(0, len(i), 100_000):
                a, b = cells[i[at : at + 100_000]], cells[j[at : at + 100_000]]
                shared = (a[:, :, None] == b[:, None, :]).any(axis=2)
                keep[at : at + 100_000] = np.where(shared, a, np.iinfo(np.int64).max).min(axis=1) == cell
            i, j = i[keep], j[keep]
            links = np.bincount(i, copies[j], len(reps)) + np.bincount(j, copies[i], len(reps))
            root = _roots(len(reps), i, j)
            some = np.flatnonzero(links > 0)
            found.append(pa.Table.from_arrays([pa.array(reps[some]), pa.array(links[some].astype(np.int64)), pa.array(reps[root[some]])], schema=_OUT))
        return pa.concat_tables(found)

    return run


def near_vectors(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", probes: int = PROBES, per_cell: int = PER_CELL, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: vectors with cosine >= threshold are linked."""
    need(df, id_col, vector_col)
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(usable, F.lit(False)), F.col("v")))
    classes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.save(classes, "classes")
    n, dim = classes.select(F.count("*"), F.mode(F.size("v"), deterministic=True)).first()
    found, summed = None, None
    if n:
        most = min(sample, max(1, SAMPLE_BYTES // (8 * dim)))
        some = classes.where(F.size("v") == dim).select(F.xxhash64("rep").alias("h"), "v")
        if n > most:
            some = some.where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * most / n))
        picked = some.limit(2 * most).toArrow()
        x = _matrix(picked.sort_by("h").column("v"), dim) if picked.num_rows else np.eye(1, dim)
        centroids = spherical_kmeans(x, max(1, min(MOST_CELLS, n // per_cell, len(x))))
        placed = scratch.save(classes.mapInArrow(_assign(centroids, probes), "rep long, copies long, v array<double>, cells array<long>"), "cells")
        each = placed.select("rep", "copies", "v", "cells", F.explode(F.array_distinct("cells")).alias("cell"))
        # one row for each cell: at most MOST_CELLS + 64
        sizes = placed.select(F.explode(F.array_distinct("cells")).alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / block).alias("parts"))
        each = each.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
        met = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = met.select("cell", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "rep", "copies", "v", "cells", "part")
        compared = met.groupBy("cell", "low", "high").applyInArrow(_compare(threshold), "rep long, links long, root long")
        compared = scratch.save(compared, "compared")
        summed = compared.groupBy("rep").agg(F.sum("links").alias("links"))
        found = connected_components(compared.where("rep <> root").select(F.col("rep").alias("src"), F.col("root").alias("dst")), scratch)
        classes = classes.join(summed, "rep", "left").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
        classes = classes.select("v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    else:
        classes = classes.select("v", F.lit(0).cast("long").alias("n_links"), F.col("rep").alias("component"))
    out = rows.join(classes, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def recall(found: DataFrame, vectors: DataFrame, threshold: float = 0.9, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """Share of links found, over the vectors whose id is divisible by ``every``, against all vectors (brute force, in blocks).

    The queries are read to the driver: choose ``every`` so that they fit.
    """
    asked = vectors.where(F.col(id_col) % every == 0).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).toArrow()
    if not asked.num_rows:
        return 1.0
    dim = len(asked.column("v")[0])
    q, ids = _matrix(asked.column("v"), dim), asked.column("vec_id").to_numpy()

    def run(batches):
        for batch in batches:
            hit = (_matrix(batch.column("v"), dim) @ q.T >= threshold) & (batch.column("vec_id").to_numpy()[:, None] != ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hit.sum(axis=0).astype(np.int64))], ["vec_id", "there"])

    every_row = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    there = every_row.mapInArrow(run, "vec_id long, there long").groupBy("vec_id").agg(F.sum("there").alias("there"))
    got, want = there.join(found.select("vec_id", "n_links"), "vec_id").select(F.sum("n_links"), F.sum("there")).first()
    return 1.0 if not want else got / want
