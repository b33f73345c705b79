"""Bars and order streams built from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars by supplier nation: prices are unit prices of line items, volume their quantities."""
    items = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    cents = F.col("l_extendedprice").cast("decimal(18,2)")
    return items.groupBy(F.col("s_nationkey").cast("int").alias("ticker"), F.date_trunc("week", "l_shipdate").cast("date").alias("date")).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum("l_quantity").alias("volume"),
        (F.sum(cents).cast("double") / F.sum("l_quantity")).alias("vwap"),
    )


def bars_user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by user: prices are event values, volume their number."""
    order = F.struct("ts", "event_id")
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date")).agg(
        F.min_by("value", order).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", order).alias("close"),
        F.count("*").cast("double").alias("volume"),
    )


def _clock(key: Column) -> Column:
    """A time HHMMSSmmm within 09:15 to 15:00 that follows from a key."""
    second = F.lit(33_300) + F.pmod(key * 37, F.lit(20_700))
    return (F.floor(second / 3600) * 10_000_000 + F.floor(F.pmod(second, F.lit(3600)) / 60) * 100_000 + F.pmod(second, F.lit(60)) * 1000).cast("long")


def l3_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order submissions: one for each order with line items."""
    size = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ex_order_id")).agg(F.sum("l_quantity").alias("lines"), F.avg(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("price"))
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("ex_order_id")
    return orders.withColumnRenamed("o_orderkey", "ex_order_id").join(size, "ex_order_id").select(
        F.format_string("%06d.%s", F.col("c_nationkey"), F.when(F.col("c_nationkey") % 2 == 0, "SZ").otherwise("SH")).alias("wind_code"),
        F.date_format("o_orderdate", "yyyyMM").cast("int").alias("date"),
        _clock(key).alias("time"),
        key.alias("order_id"),
        key,
        F.when(key % 2 == 0, "B").otherwise("S").alias("order_code"),
        F.round("price").alias("price"),
        (F.col("lines") + 10 * (key % 3)).alias("volume"),
    )


def l3_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills and cancels of those orders; the other side is the order before of the same stock and month, if any."""
    o = l3_orders(spark, sf_dir).select("wind_code", "date", "ex_order_id", F.col("time").alias("submitted"))
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ex_order_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    rows = items.join(o, "ex_order_id")
    key, cancel = F.col("ex_order_id"), F.col("l_returnflag") == "R"
    other = F.when(cancel, F.lit(0)).otherwise(F.when(F.col("l_partkey") % 4 == 0, F.lit(0)).otherwise(key + 1 - 2 * (F.col("l_partkey") % 2)))
    buy = key % 2 == 0
    return rows.select(
        "wind_code",
        "date",
        _clock(key + F.col("l_linenumber") + F.col("l_partkey") % 7).alias("time"),
        (key * 1_000_000 + F.col("l_linenumber") * 100_000 + F.col("l_partkey") % 100_000).alias("trade_id"),
        F.when(cancel, "C").otherwise("0").alias("trade_code"),
        F.when(F.col("l_returnflag") == "N", F.lit(None)).otherwise(F.when(F.col("l_suppkey") % 2 == 0, "B").otherwise("S")).alias("bs_flag"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).alias("price"),
        F.col("l_quantity").alias("volume"),
        F.when(buy, other).otherwise(key).cast("long").alias("ask_order_id"),
        F.when(buy, key).otherwise(other).cast("long").alias("bid_order_id"),
    )


def l3_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quote for each second with fills: last price, volume, running volume of the stock and month."""
    fills = l3_trades(spark, sf_dir).where("trade_code <> 'C'")
    ticks = fills.groupBy("wind_code", "date", "time").agg(F.max("price").alias("price"), F.sum("volume").alias("volume"))
    run = Window.partitionBy("wind_code", "date").orderBy("time")
    return ticks.withColumn("cum_volume", F.sum("volume").over(run))
