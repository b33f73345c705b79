"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``
(n_chars follows the text).  ``run`` writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import Scratch, without
from panelspark.llm.lines import dedup_lines
from panelspark.llm.minhash import near_duplicates
from panelspark.llm.packing import pack, pieces
from panelspark.llm.pii import replace_pii
from panelspark.llm.quality import fit_quality, with_quality
from panelspark.llm.queries import PII_SECRET

#: A character that normalised lines keep: no ASCII sign, no white space.
WORD = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]"

#: Documents that score lower go.
LEAST_QUALITY = 0.3


def _counted(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, n_chars as the text now has."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from four fifths of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learnt = labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    scored = with_quality(docs, fit_quality(docs, learnt), "__score")
    return scored.where(F.col("__score") >= LEAST_QUALITY).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; one that lost lines and has no word left goes."""
    plain = docs.select(*docs.columns)
    clean = dedup_lines(plain)
    return _counted(clean.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD)), docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    found = near_duplicates(docs, size=5, percent=80)
    gone = Scratch(spark).save(found.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    return without(docs, gone)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    return _counted(replace_pii(docs, PII_SECRET), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 4096 tokens."""
    packed = pack(pieces(docs, path("word_bpe_49k.json"), end_id=1, forget=True))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("PII", pii_surrogates),
    ("best-fit packing", best_fit_packing),
]

#: Fuzzy matching, keyed hashing and learned scores have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs, f"stage{i}")
            # what the stage before left has been read for the last time
            scratch.drop(f"stage{i - 1}")
    return docs
