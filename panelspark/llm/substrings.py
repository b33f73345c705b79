"""Repeated passages: fixed-block anchors, rolling probes, maximal exact repeats.

A word is removed if some window of ``window`` words covers it whose word sequence also starts in a document with a
smaller doc_id.  Windows are judged on the input.

1. Texts with equal word sequences are one class; all but its smallest doc_id are wholly repeated and leave the search.
2. Index: the non-overlapping blocks of each text, half a window long, so every window holds a whole block.
3. Probe: every rolling block of every text is tested against a Bloom filter of the indexed blocks; what passes joins
   the index.  A block is an anchor if an indexed document comes before another document that holds it.
4. Extension: only windows that hold an anchor are hashed and compared, by the smallest document each starts in.
   Overlapping repeated windows merge to maximal repeats.

Nothing pairs documents with documents: a passage in n documents costs n rows, reduced by min before the shuffle.
The filters have at most 2**MOST_BITS bits; more blocks than one filter holds are searched in several passes over
slices of the hash space.  Texts are shuffled only where something is removed.

Null text has no words.  Repeated rows are judged each; rows of the same doc_id don't remove from one another.  Rows
without a doc_id neither lose words nor make others lose them.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, filter_of, in_filter, routed, slot_of, texts_of
from .textscan import as_long, doc_windows, mix, slices, words

WINDOW = 50
#: Bits of a filter for each entry, how many of them an entry sets, and the largest filter (32 MB).
BITS_EACH = 8
PROBES = 3
MOST_BITS = 28


def bloom_of(hashes: DataFrame, n: int) -> bytes:
    """A Bloom filter of the longs in the one column of ``hashes``, about ``n`` rows; at most 2**MOST_BITS bits are read back."""
    bits = 1 << min(MOST_BITS, max(16, (BITS_EACH * n - 1).bit_length()))
    h = F.col(hashes.columns[0])
    step = F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    slots = F.array(*[(h.bitwiseAND(F.lit(bits - 1)) + j * step).bitwiseAND(F.lit(bits - 1)) for j in range(PROBES)])
    slot = hashes.select(F.explode(slots).alias("s"))
    found = slot.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return table.tobytes()


def bloom_has(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of ``h`` may be in the filter (``table``: its 64-bit words)."""
    mask = np.uint64(len(table) * 64 - 1)
    low, step = h & mask, h >> np.uint64(32) | np.uint64(1)
    at = np.arange(len(h))
    for j in range(PROBES):
        slot = (low[at] + np.uint64(j) * step[at]) & mask
        at = at[(table[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)]
    out = np.zeros(len(h), bool)
    out[at] = True
    return out


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _scan(block: int):
    """Of each row: word count, a digest of the word sequence and the hashes of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in slices(batch, "text"):
                w = words(data, offs)
                n = np.diff(w.first)
                place = np.arange(len(w.hash), dtype=np.int64) - np.repeat(w.first[:-1], n)
                with np.errstate(over="ignore"):
                    salted = [mix(w.hash + mix((place + k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) for k in (1, 1 << 40)]
                    sums = [np.concatenate([[np.uint64(0)], np.cumsum(s, dtype=np.uint64)]) for s in salted]
                    digests = [as_long(mix(s[w.first[1:]] - s[w.first[:-1]] + n.astype(np.uint64))) for s in sums]
                at, hashes = doc_windows(w, block)
                whole = place[at] % block == 0
                sizes = np.histogram(at[whole], bins=np.append(w.first, len(w.hash) + 1))[0][: len(n)] if len(at) else np.zeros(len(n), np.int64)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("key"), pa.array(n), *map(pa.array, digests), _lists(as_long(hashes[whole]), sizes)], ["doc_id", "key", "n_words", "d1", "d2", "blocks"])

    return run


def _of_reps(batch: pa.RecordBatch, bits: bytes) -> pa.RecordBatch:
    return batch.filter(pa.array(in_filter(bits, batch.column("slot").to_numpy())))


def _doc_of(w, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(w.first, at, side="right") - 1


def _probe(block: int, reps, bloom, part: int, parts: int):
    """Rolling blocks that may be indexed, blocks of the text's own index aside: (hash, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, table = reps.value, np.frombuffer(bloom.value, np.uint64)
        for batch in batches:
            for rows, data, offs in slices(_of_reps(batch, use), "text"):
                w = words(data, offs)
                at, hashes = doc_windows(w, block)
                doc = _doc_of(w, at)
                try_ = (at - w.first[doc]) % block != 0
                if parts > 1:
                    try_ &= as_long(hashes) % parts == part
                hit = np.flatnonzero(try_)[bloom_has(table, hashes[try_])]
                yield pa.RecordBatch.from_arrays([pa.array(as_long(hashes[hit])), rows.column("doc_id").take(pa.array(doc[hit]))], ["h", "doc_id"])

    return run


def _extend(window: int, block: int, reps, bloom, part: int, parts: int):
    """Windows that hold an anchor: (hash, doc_id, key, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, table = reps.value, np.frombuffer(bloom.value, np.uint64)
        for batch in batches:
            for rows, data, offs in slices(_of_reps(batch, use), "text"):
                w = words(data, offs)
                at, hashes = doc_windows(w, block)
                mine = as_long(hashes) % parts == part if parts > 1 else np.ones(len(hashes), bool)
                anchors = at[mine][bloom_has(table, hashes[mine])]
                near = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(near, np.maximum(anchors - (window - block), 0), 1)
                np.add.at(near, np.minimum(anchors + 1, len(w.hash)), -1)
                start, long_hashes = doc_windows(w, window)
                some = np.cumsum(near)[start] > 0
                start, long_hashes = start[some], long_hashes[some]
                doc = _doc_of(w, start)
                place = (start - w.first[doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(as_long(long_hashes)), rows.column("doc_id").take(pa.array(doc)), rows.column("key").take(pa.array(doc)), pa.array(place)], ["h", "doc_id", "key", "place"])

    return run


def repeated_words(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", entries: int = (1 << MOST_BITS) // BITS_EACH, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, key, whole, places of documents that lose words: everything, or the windows that start at ``places``.

    ``key`` is xxhash64 of the text.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    spark, block = df.sparkSession, (window + 1) // 2
    scratch = scratch or Scratch(spark)
    docs = texts_of(df, id_col, text_col).where("doc_id is not null").withColumn("key", F.xxhash64("text"))
    index = scratch.save(docs.mapInArrow(_scan(block), "doc_id long, key long, n_words long, d1 long, d2 long, blocks array<long>"), "index").where(F.col("n_words") >= window)
    least = scratch.save(index.groupBy("d1", "d2", "n_words").agg(F.min("doc_id").alias("rep")), "classes")
    classed = scratch.save(index.join(least, ["d1", "d2", "n_words"]).select("doc_id", "key", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("blocks")).alias("blocks")), "classed")
    copies = classed.where("doc_id > rep").select("doc_id", "key", F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("places")).distinct()
    reps = classed.where("doc_id = rep")
    blocks = reps.select(F.explode("blocks").alias("h"), "doc_id")
    n = reps.select(F.sum(F.size("blocks"))).first()[0] or 0
    if n == 0:
        return copies
    sc = spark.sparkContext
    bits = filter_of(reps.select("doc_id"))
    use = sc.broadcast(bits)
    texts = docs.select("doc_id", "key", "text", slot_of(F.col("doc_id"), 8 * len(bits)).alias("slot"))
    parts = -(-n // entries)
    found = []
    for part in range(parts):
        own = blocks.where(F.pmod("h", F.lit(parts)) == part) if parts > 1 else blocks
        bloom = sc.broadcast(bloom_of(own.select("h"), -(-n // parts)))
        probes = texts.mapInArrow(_probe(block, use, bloom, part, parts), "h long, doc_id long")
        both = own.select("h", F.col("doc_id").alias("indexed"), "doc_id").unionByName(probes.select("h", F.lit(None).cast("long").alias("indexed"), "doc_id"))
        anchors = both.groupBy("h").agg(F.min("indexed").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h")
        anchors = scratch.save(anchors, f"anchors{part}")
        bloom = sc.broadcast(bloom_of(anchors, max(1 << 20, 4 * anchors.count())))
        found.append(scratch.save(texts.mapInArrow(_extend(window, block, use, bloom, part, parts), "h long, doc_id long, key long, place int"), f"windows{part}"))
    windows = found[0]
    for some in found[1:]:
        windows = windows.unionByName(some)
    first = windows.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h", "first")
    first = scratch.save(first, "firsts")
    hit = windows.join(first, "h").where("doc_id > first")
    # a copy may have passed the filter of representatives, which is one of bits: one row for it all the same
    both = hit.select("doc_id", "key", "place", F.lit(False).alias("whole")).unionByName(copies.select("doc_id", "key", F.lit(None).cast("int").alias("place"), "whole"))
    return scratch.save(both.groupBy("doc_id", "key").agg(F.max("whole").alias("whole"), F.collect_set("place").alias("places")), "repeats")


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, places = batch.column("whole").to_pylist(), batch.column("places")
            done = 0
            for rows, data, offs in slices(batch, "text"):
                w = words(data, offs)
                counts, removed, kept = [], [], []
                raw = data.tobytes()
                for i in range(rows.num_rows):
                    own = w.of(i)
                    start, end = w.start[own], w.end[own]
                    gone = np.zeros(len(start) + 1, np.int64)
                    if whole[done + i]:
                        gone[0] = 1
                    elif places[done + i].is_valid:
                        at = places[done + i].values.to_numpy()
                        gone[at] += 1
                        gone[at + window] -= 1
                    stay = np.cumsum(gone[:-1]) == 0
                    counts.append(len(start))
                    removed.append(int(len(start) - stay.sum()))
                    kept.append(b" ".join([raw[a:b] for a, b in zip(start[stay].tolist(), end[stay].tolist(), strict=True)]).decode())
                done += rows.num_rows
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", entries: int = (1 << MOST_BITS) // BITS_EACH) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of every row."""
    repeats = repeated_words(df, window, id_col, text_col, entries)
    docs = texts_of(df, id_col, text_col).withColumn("key", F.xxhash64("text"))
    hit, rest = routed(docs, repeats.select("doc_id").distinct())
    schema = "doc_id long, n_words long, n_removed long, kept string"
    nothing = F.lit(None).cast("array<int>").alias("places")
    as_is = rest.select("doc_id", "text", F.lit(False).alias("whole"), nothing)
    changed = hit.join(repeats, ["doc_id", "key"], "left").select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "places")
    return as_is.mapInArrow(_remove(window), schema).unionByName(changed.mapInArrow(_remove(window), schema))
