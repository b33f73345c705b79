"""Loading and refreshing bar shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: that of the greatest ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def upsert(old: DataFrame, new: DataFrame, start: str, end: str) -> DataFrame:
    """Both frames within [start, end]; where both have a (ticker, date), the new row wins."""
    both = old.withColumn("__from", F.lit(0)).unionByName(new.withColumn("__from", F.lit(1)))
    inside = both.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return latest(inside, ["ticker", "date"], "__from").drop("__from")


def bounds(df: DataFrame) -> DataFrame:
    return df.groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def missing_starts(df: DataFrame, start: str, end: str) -> DataFrame:
    """(ticker, first_date, last_date, covered, missing_start): where an incremental load has to begin.

    Null if [start, end] is covered, the day after the last bar if only the end is missing, ``start`` otherwise.
    """
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    covered = (F.col("first_date") <= a) & (F.col("last_date") >= b)
    begin = F.when(covered, None).when(F.col("first_date") <= a, F.date_add("last_date", 1)).otherwise(a)
    return bounds(df).withColumn("covered", covered).withColumn("missing_start", begin)


def write_shards(df: DataFrame, path: str, force: bool = False) -> None:
    """One folder for each ticker; folders that exist stay unless ``force``."""
    spark = df.sparkSession
    if not force:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            df = df.join(spark.read.parquet(path).select("ticker").distinct(), "ticker", "left_anti")
    df.write.mode("append" if not force else "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(path)


def combine_shards(df: DataFrame, order: str) -> DataFrame:
    """Distinct (ticker, date) rows of a folder of shards, the last by ``order``."""
    if df.isEmpty():
        raise RuntimeError("no shards")
    return latest(df, ["ticker", "date"], order)


def normalize_tickers(df: DataFrame, column: str = "ticker") -> DataFrame:
    """Trimmed upper-case names, each once, in order of appearance (column ``place``)."""
    name = F.upper(F.trim(column))
    out = df.withColumn(column, name).where(F.col(column) != "")
    return out.groupBy(column).agg(F.min("place").alias("place")).orderBy("place") if "place" in df.columns else out.select(column).distinct()


def decode_bars(df: DataFrame) -> DataFrame:
    """Bars from records with long or short keys and epoch milliseconds."""

    def pick(*names: str):
        there = [F.col(n) for n in names if n in df.columns]
        return F.coalesce(*there) if there else F.lit(None)

    date = F.to_date(F.timestamp_millis(pick("timestamp", "t").cast("long")))
    short = {"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v", "vwap": "vw"}
    return df.select("ticker", date.alias("date"), *[pick(k, v).cast("double").alias(k) for k, v in short.items()])
