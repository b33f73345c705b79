"""Language-model scoring by cross-entropy difference.

A target and a background bigram model are matched: one vocabulary (the token ids of a public tokenizer and a start
mark), one order, one smoothing.  With counts c of a corpus of N tokens and V ids,

    P(w) = (c(w) + 1) / (N + V)                    P(w | v) = (c(v w) + mu P(w)) / (c(v) + mu)

and a document's score is its mean loss per token under the target model minus that under the background model: the
lower, the more it is like the target.

Counts cover every token of all documents.  Each task adds up what it reads before it sends counts on.  Bigram counts
stay distributed; only sums by id (at most V) are read to the driver.  Scoring looks the loss differences of bigrams
up in sorted arrays; a table of more than ``entries`` bigrams is cut into slices, each looked up in a pass of its own,
and the sums are added, so no broadcast exceeds 8 * ``entries`` bytes.  A bigram without a count backs off by the same
formula.

Null, empty or blank texts have no tokens and a null score.  Repeated rows are counted and scored each; rows without a
doc_id belong to the background.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, routed, texts_of
from .wordpieces import word_pieces

MU = 50.0
#: Mark of a text's start; ids are under it.
START = 0xFFFF
#: Bigrams of one broadcast.
ENTRIES = 4 << 20
#: Distinct bigrams that a task holds before it sends them on.
HELD = 2 << 20


def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = word_pieces(path)
        if use.size >= START:
            raise ValueError("ids don't fit into 16 bits")
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [np.frombuffer(x, np.uint32).astype(np.uint16).tobytes() for x in use.ids([t or "" for t in part.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def token_ids(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (16-bit little-endian) of every whole text."""
    return texts_of(df, id_col, text_col).mapInArrow(_tokenize(tokenizer_path), "doc_id long, ids binary")


def _bigrams(cells) -> tuple[np.ndarray, np.ndarray]:
    """(bigrams, tokens of each text): the id before, or the start mark, in the upper 16 bits."""
    raw = [c.as_buffer() if c.is_valid else b"" for c in cells]
    ids = [np.frombuffer(r, np.uint16) for r in raw]
    sizes = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate([np.empty(0, np.uint16), *ids]).astype(np.uint32)
    before = np.empty(len(flat), np.uint32)
    before[1:] = flat[:-1]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = START
    return before << np.uint32(16) | flat, sizes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, sums = np.empty(0, np.uint32), np.empty(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(sums)], ["bigram", "n"])

    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            found, n = np.unique(_bigrams(batch.column("ids").slice(i, 1024))[0], return_counts=True)
            both = np.concatenate([keys, found])
            order = np.argsort(both, kind="stable")
            both, weights = both[order], np.concatenate([sums, n])[order]
            first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.empty(0, np.int64)
            keys, sums = both[first], np.add.reduceat(weights, first) if len(first) else weights
            if len(keys) > HELD:
                yield out()
                keys, sums = np.empty(0, np.uint32), np.empty(0, np.int64)
    yield out()


def count_bigrams(ids: DataFrame) -> DataFrame:
    """bigram, n; each task's counts are added up, not yet those of different tasks."""
    return ids.select("ids").mapInArrow(_count, "bigram long, n long")


@dataclass(frozen=True)
class Unigrams:
    """Of one corpus, by id: count, count as a context, smoothed probability."""

    context: np.ndarray
    p: np.ndarray


@dataclass(frozen=True)
class Difference:
    """Loss differences of both models; ``table`` has (bigram, difference) rows."""

    target: Unigrams
    background: Unigrams
    table: DataFrame
    rows: int
    mu: float

    def backoff(self, bigram: np.ndarray) -> np.ndarray:
        v, w = bigram >> np.uint32(16), bigram & np.uint32(0xFFFF)
        loss = [-np.log(self.mu * m.p[w] / (m.context[v] + self.mu)) for m in (self.target, self.background)]
        return loss[0] - loss[1]


def fit_difference(target: DataFrame, background: DataFrame, vocabulary: int, scratch: Scratch, mu: float = MU) -> Difference:
    """Both models from count_bigrams tables; ``background`` are counts of what isn't target: the target is added."""
    none = F.lit(0).cast("long")
    rows = target.select("bigram", F.col("n").alias("t"), F.col("n").alias("b")).unionByName(background.select("bigram", none.alias("t"), F.col("n").alias("b")))
    counts = scratch.save(rows.groupBy("bigram").agg(F.sum("t").alias("t"), F.sum("b").alias("b")), "counts")
    w, v = F.col("bigram").bitwiseAND(F.lit(0xFFFF)), F.shiftright("bigram", 16)
    # one row for each id at most
    by_id = counts.groupBy(w.alias("id")).agg(F.sum("t").alias("t"), F.sum("b").alias("b")).toArrow()
    by_context = counts.groupBy(v.alias("id")).agg(F.sum("t").alias("t"), F.sum("b").alias("b")).toArrow()
    models = []
    for c in ("t", "b"):
        count, context = np.zeros(START + 1), np.zeros(START + 1)
        count[by_id.column("id").to_numpy()] = by_id.column(c).to_numpy()
        context[by_context.column("id").to_numpy()] = by_context.column(c).to_numpy()
        models.append(Unigrams(context, (count + 1) / (count.sum() + vocabulary)))
    t, b = models
    spark = scratch.spark
    used = np.flatnonzero((b.context > 0) | (b.p > b.p.min()))
    small = spark.createDataFrame(pa.table({"id": used.astype(np.int64), "tc": t.context[used], "bc": b.context[used], "tp": t.p[used], "bp": b.p[used]}))
    of_w = F.broadcast(small.select(F.col("id").alias("w"), "tp", "bp"))
    of_v = F.broadcast(small.select(F.col("id").alias("v"), "tc", "bc"))
    both = counts.withColumn("w", w).withColumn("v", v).join(of_w, "w").join(of_v, "v")
    losses = [-F.log((F.col(n) + mu * F.col(p)) / (F.col(c) + mu)) for n, p, c in (("t", "tp", "tc"), ("b", "bp", "bc"))]
    table = scratch.save(both.select("bigram", (losses[0] - losses[1]).cast("float").alias("difference")), "differences")
    return Difference(t, b, table, table.count(), mu)


def _score(shared, keys, values, part: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known, differences = np.frombuffer(keys.value, np.uint32), np.frombuffer(values.value, np.float32)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                rows = batch.slice(i, 1024)
                bigrams, sizes = _bigrams(rows.column("ids"))
                at = np.minimum(np.searchsorted(known, bigrams), max(len(known) - 1, 0))
                hit = known[at] == bigrams if len(known) else np.zeros(len(bigrams), bool)
                value = np.zeros(len(bigrams))
                value[hit] = differences[at[hit]]
                rest = np.flatnonzero(~hit & (bigrams % np.uint32(parts) == part))
                value[rest] = model.backoff(bigrams[rest])
                sums = np.concatenate([[0.0], np.cumsum(value)])
                end = np.cumsum(sizes)
                total = sums[end] - sums[end - sizes]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in rows.schema.names if c != "ids"), pa.array(sizes), pa.array(total)], [*(c for c in rows.schema.names if c != "ids"), "n_tokens", "total"])

    return run


def score_difference(ids: DataFrame, model: Difference, entries: int = ENTRIES) -> DataFrame:
    """doc_id, n_tokens, score of every row of (doc_id, ids)."""
    sc = ids.sparkSession.sparkContext
    bare = sc.broadcast(Difference(model.target, model.background, None, model.rows, model.mu))
    parts = max(1, -(-model.rows // entries))
    rows = ids.select("doc_id", "ids") if parts == 1 else ids.select("doc_id", "ids", F.xxhash64("ids").alias("key"))
    schema = "doc_id long, n_tokens long, total double" if parts == 1 else "doc_id long, key long, n_tokens long, total double"
    made = []
    for part in range(parts):
        own = model.table if parts == 1 else model.table.where(F.col("bigram") % parts == part)
        found = own.toArrow()
        order = np.argsort(found.column("bigram").to_numpy())
        keys = sc.broadcast(found.column("bigram").to_numpy()[order].astype(np.uint32).tobytes())
        values = sc.broadcast(found.column("difference").to_numpy()[order].astype(np.float32).tobytes())
        made.append(rows.mapInArrow(_score(bare, keys, values, part, parts), schema).withColumn("part", F.lit(part)))
    if parts == 1:
        out = made[0]
    else:
        every = made[0]
        for some in made[1:]:
            every = every.unionByName(some)
        # equal rows have equal sums: one of each slice
        once = every.groupBy("doc_id", "key", "part").agg(F.min("total").alias("total"), F.min("n_tokens").alias("n_tokens"))
        sums = once.groupBy("doc_id", "key").agg(F.sum("total").alias("total"), F.min("n_tokens").alias("n_tokens"))
        a, b = rows.select("doc_id", "key").alias("a"), sums.alias("b")
        out = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key"))).select("a.doc_id", "n_tokens", "total")
    return out.select("doc_id", "n_tokens", F.when(F.col("n_tokens") > 0, F.col("total") / F.col("n_tokens")).alias("score"))


def cross_entropy_difference(df: DataFrame, target_ids: DataFrame, tokenizer_path: str, mu: float = MU, entries: int = ENTRIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, score of every row; the documents named in ``target_ids`` are the target, all are the background."""
    scratch = Scratch(df.sparkSession)
    ids = scratch.save(token_ids(df, tokenizer_path, id_col, text_col), "ids")
    wanted = scratch.save(target_ids.select(F.col(target_ids.columns[0]).cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "target")
    hit, rest = routed(ids, wanted)
    marked = scratch.save(hit.join(wanted.withColumn("is_target", F.lit(True)), "doc_id", "left").select("ids", F.coalesce("is_target", F.lit(False)).alias("is_target")), "marked")
    others = count_bigrams(rest).unionByName(count_bigrams(marked.where(~F.col("is_target"))))
    model = fit_difference(count_bigrams(marked.where("is_target")), others, word_pieces(tokenizer_path).size + 1, scratch, mu)
    return score_difference(ids, model, entries)
