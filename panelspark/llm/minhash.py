"""Near-duplicate documents by b-bit MinHash.

1. Every text's set of distinct word shingles (64-bit hashes) gives 128 minima.  The low 4 bits of each, packed into
   eight longs, are its signature; four full minima at a time are hashed into 32 band keys.
2. Documents with equal sets are one class, and its smallest doc_id stands for it from here on.
3. Classes that share a band key are candidates.  Not all pairs of a bucket are formed: each is paired with its
   bucket's smallest member; candidates are screened by the signatures (matching nibbles counted with bit
   operations, corrected for chance matches) and confirmed on the full sets.
4. Links are closed to components.  Members that are still apart from their bucket's first member meet that one's
   component's smallest member, the pivot.  Who is apart from it too is compared with the other members by the
   shingles that set both off from the pivot: two sets can only be similar if enough of these differences agree, so
   they meet on one of their first differences (an exact prefix filter).  What a group of copies has in common makes
   no pairs.  Every pair of a bucket is compared, refused by that bound, or in one component already: no link that
   could change a component is lost, and there is no cap on buckets.

A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**4)**32 = 1 - 5e-8; the screen passes pairs whose
estimate is no more than 0.18 under the threshold (4.9 standard deviations) and whose sizes allow the similarity.

Null or empty text, or text without words, has an empty set: linked with nothing, its own component, kept.  Rows that
repeat a doc_id are one document with several texts and join their classes (doc_ids are taken to lie below 2**62).  Rows without a doc_id come back unlinked, with no component,
and are kept.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, filter_of, lean, slot_of, texts_of
from .linking import grown, link_members, members_of
from .textscan import as_long, doc_windows, mix, slices, words

BANDS = 32
ROWS = 4
HASHES = BANDS * ROWS
#: Bits kept of each minimum; sixteen of them fill a long.
BITS = 4
MARGIN = 0.18
#: First differences from a pivot that two members must have in common to be compared, if they need as many.
AGREE = 3

_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = mix(np.arange(1001, HASHES + 1001, dtype=np.uint64))
_BAND = mix(np.arange(5001, BANDS + 5001, dtype=np.uint64))


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> list[np.ndarray]:
    """Of each text: sorted distinct hashes of its runs of ``size`` words, or of all words if there are fewer."""
    w = words(data, offs, lower=True)
    at, hashes = doc_windows(w, size)
    cut = np.searchsorted(at, w.first)
    out = []
    for i in range(len(offs) - 1):
        some = hashes[cut[i] : cut[i + 1]]
        n = int(w.first[i + 1] - w.first[i])
        if 0 < n < size:
            with np.errstate(over="ignore"):
                some = np.array([0], np.uint64)
                for h in w.hash[w.of(i)]:
                    some = mix(some * np.uint64(3) + h + np.uint64(n))
        out.append(np.unique(some))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), 1024):
            np.minimum(best, (shingles[i : i + 1024, None] * _SEEDS + _SHIFTS).min(axis=0), out=best)
    return best


def sketch(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eight packed longs, band keys) of a set."""
    best = mix(minima(shingles))
    low = (best & np.uint64(15)).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(BITS))
    with np.errstate(over="ignore"):
        keys = _BAND.copy()
        for j in range(ROWS):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + best.reshape(BANDS, ROWS)[:, j])
    return np.bitwise_or.reduce(low, axis=1), keys


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two packed signatures: equal nibbles, corrected for those equal by chance."""
    differ = None
    for i in range(HASHES * BITS // 64):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        n = F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
        differ = n if differ is None else differ + n
    chance = 1 / (1 << BITS)
    return ((HASHES - differ) / F.lit(float(HASHES)) - chance) / (1 - chance)


def _fixed(values: list[np.ndarray], size: int) -> pa.Array:
    flat = np.concatenate(values) if values else np.empty(0, np.uint64)
    offsets = np.arange(len(values) + 1, dtype=np.int32) * size
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(as_long(flat)))


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of each set, as two longs."""
    return np.frombuffer(b"".join([blake2b(s.tobytes(), digest_size=16).digest() for s in sets]), np.int64).reshape(-1, 2)


def _sketches(size: int):
    longs = HASHES * BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in slices(batch, "text"):
                sets = shingle_sets(data, offs, size)
                made = [sketch(s) if len(s) else (np.zeros(longs, np.uint64), np.zeros(BANDS, np.uint64)) for s in sets]
                d = _digests(sets)
                columns = [rows.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), _fixed([m[0] for m in made], longs), _fixed([m[1] for m in made], BANDS)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "d1", "d2", "signature", "bands"])

    return run


def _sets(size: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint64)
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            hit = table[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)
            for rows, data, offs in slices(batch.filter(pa.array(hit.astype(bool))), "text"):
                sets = shingle_sets(data, offs, size)
                offsets = np.zeros(len(sets) + 1, np.int32)
                np.cumsum([len(s) for s in sets], out=offsets[1:])
                shingles = pa.ListArray.from_arrays(pa.array(offsets), pa.array(as_long(np.concatenate(sets))))
                d = _digests(sets)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(d[:, 0]), pa.array(d[:, 1]), shingles], ["doc_id", "d1", "d2", "shingles"])

    return run


def _synthetic() -> Column:
    """Stands for a class none of whose documents has this one text alone; larger than any doc_id below 2**62."""
    return F.shiftrightunsigned(F.xxhash64("d1", "d2"), 2).bitwiseOR(F.lit(1 << 62))


def _order(tokens: Column, added: int) -> Column:
    """Tokens as (0 for those added to the pivot and 1 for those missing, hash, token), in one order for all sets."""
    return F.transform(tokens, lambda t: F.struct(F.lit(added).alias("kind"), F.xxhash64(t).alias("place"), t.alias("token")))


def _residue(sets: DataFrame, percent: int, scratch: Scratch) -> Callable[[DataFrame], DataFrame]:
    """Pairs of a group by the shingles that set them off from its pivot.

    With P the pivot's set, and r of its shingles missing in x and a added to it, x and y have at least the similarity
    only if their differences from P have T = w(x) + w(y) - (1 - 2f) * |P| in common, where f = percent / (100 + percent)
    and w = (1 - f) * r + f * a.  A member apart from the pivot has w > (1 - 2f) * |P|, so T is more than w of the other
    one.  In any order the first k of the common differences are then among the first |D| - T + k of both, for every k
    up to T: pairs are proposed that have at least k = min(AGREE, T) there.  The order is by how often a group has them.
    """
    f = percent / (100 + percent)

    def pairs(groups: DataFrame) -> DataFrame:
        pivots = sets.select(F.col("rep").alias("pivot"), F.col("shingles").alias("xp"))
        both = groups.join(sets, "rep").join(pivots, "pivot")
        added, missing = F.array_except("shingles", "xp"), F.array_except("xp", "shingles")
        both = both.select("pivot", "rep", "of_rep", "apart", F.size("xp").alias("np"), added.alias("added"), missing.alias("missing"))
        weight = (1 - f) * F.size("missing") + f * F.size("added") - (1 - 2 * f) * F.col("np")
        sized = both.select("pivot", "rep", "of_rep", "apart", weight.alias("slack"), F.col("np"), F.concat(_order(F.col("added"), 0), _order(F.col("missing"), 1)).alias("d"))
        sized = scratch.save(sized, "differences")
        # the rarest of a group come first: what all but the pivot have is compared last
        each = sized.select("pivot", "rep", F.explode("d").alias("t"))
        often = each.groupBy("pivot", "t").agg(F.count("*").alias("often"))
        ranked = each.join(often, ["pivot", "t"]).groupBy("pivot", "rep").agg(F.sort_array(F.collect_list(F.struct("often", "t.kind", "t.place", "t.token"))).alias("d"))
        sized = scratch.save(sized.drop("d").join(ranked, ["pivot", "rep"]), "ranked")
        # the slack of a member apart is positive; the other one's w is its slack and what P allows
        room = F.col("slack") + (1 - 2 * f) * F.col("np")
        index = sized.select("pivot", F.col("rep").alias("y"), F.col("of_rep").alias("cy"), F.col("apart").alias("ay"), F.col("slack").alias("sy"), F.size("d").alias("ny"), F.posexplode(F.slice("d", 1, F.greatest(F.size("d") - F.floor(room - 1e-9).cast("int") + AGREE - 1, F.lit(0)))).alias("py", "t"))
        probe = sized.where("apart").select("pivot", F.col("rep").alias("x"), F.col("of_rep").alias("cx"), "np", F.col("slack").alias("sx"), F.size("d").alias("nx"), F.posexplode("d").alias("px", "t"))
        index = index.select("pivot", "y", "cy", "ay", "sy", "ny", "py", F.col("t.token").alias("token"), F.col("t.kind").alias("kind"))
        probe = probe.select("pivot", "x", "cx", "np", "sx", "nx", "px", F.col("t.token").alias("token"), F.col("t.kind").alias("kind"))
        least = F.ceil(F.col("sx") + F.col("sy") + (1 - 2 * f) * F.col("np") - 1e-6)
        agree = F.greatest(F.least(least, F.lit(AGREE)), F.lit(1))
        fits = (F.col("cx") != F.col("cy")) & (~F.col("ay") | (F.col("x") < F.col("y"))) & (F.col("px") + least < F.col("nx") + agree) & (F.col("py") + least < F.col("ny") + agree)
        met = probe.join(index, ["pivot", "token", "kind"]).where(fits).groupBy("pivot", F.col("x").alias("a"), F.col("y").alias("b")).agg(F.count("*").alias("n"), F.min(agree).alias("k"))
        return met.where("n >= k").select("a", "b")

    return pairs


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: documents with 100 * common >= percent * united shingles are linked."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    docs = texts_of(df, id_col, text_col)
    least = percent / 100 - MARGIN

    made = docs.mapInArrow(lean(_sketches(size)), "doc_id long, n_shingles long, d1 long, d2 long, signature array<long>, bands array<long>")
    made = scratch.save(made, "sketches")
    filled = made.where("n_shingles > 0 and doc_id is not null")
    # documents with several texts belong to several classes, so they can't stand for one
    several = filled.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("low"), F.max(F.struct("d1", "d2")).alias("high")).where("low <> high")
    several = scratch.save(several.select("doc_id", F.lit(True).alias("several")), "several")
    some_several = not several.isEmpty()
    flagged = filled.join(several, "doc_id", "left") if some_several else filled.withColumn("several", F.lit(None).cast("boolean"))
    flagged = flagged.withColumn("several", F.coalesce("several", F.lit(False)))
    classes = flagged.groupBy("d1", "d2").agg(F.min(F.struct("several", "doc_id")).alias("least"))
    classes = scratch.save(classes.select("d1", "d2", F.col("least.doc_id").alias("carrier"), F.when(F.col("least.several"), _synthetic()).otherwise(F.col("least.doc_id")).alias("rep")), "classes")
    carried = filled.select(F.col("doc_id").alias("carrier"), "d1", "d2", "n_shingles", "signature", "bands")
    reps = scratch.save(carried.join(classes, ["d1", "d2", "carrier"]).dropDuplicates(["rep"]).select("rep", "carrier", "n_shingles", "signature", "bands"), "reps")

    members = members_of(reps.select("rep", F.explode("bands").alias("band")), scratch)
    signatures = reps.select("rep", F.struct("signature", "n_shingles").alias("feature"))

    mine = members.select("rep").distinct()
    bits = filter_of(mine.join(reps.where("rep <> carrier").select("rep", "carrier"), "rep", "left").select(F.coalesce("carrier", "rep").alias("doc_id"))) if some_several else filter_of(mine)
    sets = docs.where("doc_id is not null").withColumn("slot", slot_of(F.col("doc_id"), len(bits) * 8)).mapInArrow(lean(_sets(size, spark.sparkContext.broadcast(bits))), "doc_id long, d1 long, d2 long, shingles array<long>")
    if some_several:
        # a text of a document with several is the class's only if none other carries it
        sets = sets.join(several, "doc_id", "left").withColumn("rep", F.when(F.col("several"), _synthetic()).otherwise(F.col("doc_id"))).dropDuplicates(["rep"])
    else:
        sets = sets.withColumn("rep", F.col("doc_id")).dropDuplicates(["rep"])
    sets = scratch.save(sets.select("rep", "shingles"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("xa"))
        b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("xb"))
        both = F.size(F.array_intersect("xa", "xb"))
        return pairs.join(b, "b").join(a, "a").where(100 * both >= percent * (F.size("xa") + F.size("xb") - both)).select("a", "b")

    def alike(a: Column, b: Column) -> Column:
        small, large = F.least(a["n_shingles"], b["n_shingles"]), F.greatest(a["n_shingles"], b["n_shingles"])
        return (100 * small >= percent * large) & (estimate(a["signature"], b["signature"]) >= least)

    found = link_members(members, signatures, alike, confirmed, _residue(sets, percent, scratch), scratch)
    if some_several:
        joined = flagged.where("several").join(classes, ["d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        found = grown(found, joined, scratch, "joined")

    # an equal set's class, then that class's component
    named = made.select("doc_id", "n_shingles", "d1", "d2").join(classes.select("d1", "d2", "rep"), ["d1", "d2"], "left")
    if found is None:
        named = named.withColumn("component", F.lit(None).cast("long"))
    else:
        named = named.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    linkable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(linkable, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    out = named.select("doc_id", "n_shingles", component.alias("component_id"))
    return scratch.finish(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "result")
