"""Registered queries of this subpackage: thin wrappers that derive the digest columns of the contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Key of the surrogates in the registered queries; a real run passes its own.
PII_SECRET = "panelspark"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN, path

    from .bpe import bpe_decode, bpe_encode, ids_text

    ranks = path("byte_bpe_multi_50k.tiktoken")
    coded = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), ranks, PATTERN), ranks, PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids_text("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, score_quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    scored = score_quality(docs, fit_quality(docs, labels.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import replace_pii

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs, PII_SECRET, count_col="n_replaced")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .packing import pack, pieces

    packed = pack(pieces(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"), end_id=1))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "n_left", "text")


def op7_spherical_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op8_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .lmscore import cross_entropy_difference

    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good, path("word_bpe_49k.json"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import encode_media, media_features

    out = media_features(encode_media(table(spark, sf_dir, "documents")))
    return out.withColumn("feature", F.lower(F.hex("hash"))).drop("hash")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {}
