"""Bound-certified packing of tokenised documents into sequences of a fixed length.

1. ``pieces``: ids of every text plus an end id; texts longer than a sequence are cut into full pieces and a rest.
2. ``pack``: pieces that fill a sequence need no search.  All others are dealt over partitions of a bounded number
   of rows and packed best fit decreasing, each partition by itself.
3. A lower bound from dual feasible functions certifies a partition's number of sequences.  Partitions that meet
   their bound are done.  Where a gap is left, sequences that are filled almost to the end stay, and the documents
   of the others go to a pool; the pool is dealt anew, so that partitions exchange documents, and packed again.
   This is repeated while it saves sequences.  A round's packing is adopted only if it needs fewer sequences.

Only (document, piece, length) rows are shuffled, never texts or ids.  No step holds more than a partition's rows.
The dealing is by hash, so an executor lost at any point recomputes the same partitions.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, need, texts_of
from .wordpieces import word_pieces

LENGTH = 4096
#: Rows of a partition that is packed at once.
ROWS = 40_000
#: A sequence with at most this share left empty is kept when documents are exchanged.
SLACK = 1 / 256
ROUNDS = 4


def _pieces(path: str, end_id: int, length: int, forget: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, end = word_pieces(path), np.uint32(end_id).tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), use.ids([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * length)):
                        some = ids[at : at + 4 * length]
                        rows.append((doc, piece, at // 4, len(some) // 4, zlib.crc32(some)))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        if forget:
            use.forget()

    return run


def pieces(df: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", forget: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; null text is empty: its end id alone.

    ``forget``: a worker keeps no ids of words for its next task.
    """
    return texts_of(df, id_col, text_col).mapInArrow(lean(_pieces(tokenizer_path, end_id, length, forget)), "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: the best of several dual feasible functions.

    With threshold t, pieces over capacity - t count as whole sequences and pieces under t as nothing (u1); the
    rounding functions f_k keep multiples of capacity / (k + 1) and else round x * (k + 1) / capacity down.
    """
    if len(lengths) == 0:
        return 0
    x = np.sort(lengths.astype(np.int64))
    sums = np.concatenate([[0], np.cumsum(x)])
    t = np.unique(np.concatenate([[0], x[x <= capacity // 2]]))
    low, high = np.searchsorted(x, t), np.searchsorted(x, capacity - t, side="right")
    best = int(np.max(len(x) - high + -(-(sums[high] - sums[low]) // capacity)))
    for k in range(1, 20):
        scaled = x * (k + 1)
        value = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        best = max(best, -(-int(value.sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces in any order: sequence and offset of each, and how full each sequence is.  Ties: earlier rows first."""
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    sizes: list[int] = []
    fill: list[int] = []
    for i in order.tolist():
        n = int(lengths[i])
        at = bisect_left(sizes, n)
        if at == len(sizes):
            b = len(fill)
            fill.append(0)
        else:
            left = sizes[at]
            b = room[left].pop()
            if not room[left]:
                del sizes[at]
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += n
        left = capacity - fill[b]
        if left:
            if not room[left]:
                sizes.insert(bisect_left(sizes, left), left)
            room[left].append(b)
    return bin_of, offset, np.array(fill, np.int64)


_FIELDS = [("doc_id", pa.int64()), ("piece", pa.int32()), ("length", pa.int64()), ("copy", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("settled", pa.bool_())]
_SCHEMA = "doc_id long, piece int, length long, copy long, sequence_id long, offset long, settled boolean"


def _pack(capacity: int, slack: int, base: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("copy", "ascending")])
        lengths = table.column("length").to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        certified = len(fill) == lower_bound(lengths, capacity)
        settled = np.full(len(lengths), True) if certified else (fill >= capacity - slack)[bins]
        part = table.column("part")[0].as_py() if table.num_rows else 0
        made = [table.column(c) for c in ("doc_id", "piece", "length", "copy")]
        made += [pa.array(base + (part << 32) + bins), pa.array(offsets), pa.array(settled)]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in made], schema=pa.schema(_FIELDS))

    return run


def _deal(rows: DataFrame, n: int, seed: int) -> DataFrame:
    parts = max(1, -(-n // ROWS))
    return rows.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "piece", "copy"), F.lit(parts)))


def pack(rows: DataFrame, length: int = LENGTH, slack: float = SLACK, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset to (doc_id, piece, length, ...) rows, every length at most ``length``.

    Repeated (doc_id, piece) rows are packed each; an empty table stays empty; a length under 1 or over ``length``
    is an error of the caller and raises when the job runs.
    """
    need(rows, "doc_id", "piece", "length")
    spark = rows.sparkSession
    scratch, slack_tokens = Scratch(spark), int(length * slack)
    rest = [c for c in rows.columns if c not in {"doc_id", "piece", "length", "copy", "sequence_id", "offset"}]
    ordered = [F.col(f"`{c}`") for c in rest]
    rows = rows.select("doc_id", "piece", "length", F.struct(*ordered).alias("rest") if rest else F.lit(None).cast("string").alias("rest"))
    checked = rows.withColumn("length", F.when(F.col("length").between(1, length), F.col("length")).otherwise(F.raise_error(F.lit("length out of bounds"))))
    all_rows = scratch.save(checked.withColumn("copy", F.monotonically_increasing_id()), "pieces")
    keys = all_rows.select("doc_id", "piece", "length", "copy")
    pool = keys.where(F.col("length") < length)
    full = keys.where(F.col("length") == length).select("copy", (-1 - F.col("copy")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = [full]
    n, before, kept_pool = pool.count(), None, None
    for i in range(rounds):
        if n == 0:
            break
        dealt = _deal(pool, n, i)
        # at most 40 000 rows a group: the partition count follows the number of rows
        made = dealt.groupBy("part").applyInArrow(_pack(length, slack_tokens, i << 56), _SCHEMA)
        made = scratch.save(made, f"round{i}")
        now, left, open_bins = made.select(F.count_distinct("sequence_id"), F.count_if(~F.col("settled")), F.count_distinct(F.when(~F.col("settled"), F.col("sequence_id")))).first()
        if before is not None and now >= before:
            placed.append(kept_pool)
            n = 0
            break
        placed.append(made.where("settled").select("copy", "sequence_id", "offset"))
        pool = made.where(~F.col("settled")).select("doc_id", "piece", "length", "copy")
        kept_pool = made.where(~F.col("settled")).select("copy", "sequence_id", "offset")
        n, before = left, open_bins
    if n and kept_pool is not None:
        placed.append(kept_pool)
    where = placed[0]
    for some in placed[1:]:
        where = where.unionByName(some)
    out = all_rows.join(where, "copy")
    return out.select("doc_id", "piece", "length", *([F.col(f"rest.`{c}`").alias(c) for c in rest]), "sequence_id", "offset")
