"""Streaming forms of the minute table and of the shard refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ingest import latest
from ..operators.orderflow import clean_code


def minute_trades(trades: DataFrame, event_time: str = "event_ts", delay: str = "2 minutes", cancel_code: str = "C") -> DataFrame:
    """(wind_code, start, trade_count, trade_volume, event_cancel_count, event_cancel_volume) of each minute.

    Events later than ``delay`` are dropped; state is one row for each stock and open minute.
    """
    cancel = F.coalesce(clean_code("trade_code") == cancel_code, F.lit(False))
    made = (
        trades.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, "1 minute"), "wind_code")
        .agg(
            F.count_if(~cancel).alias("trade_count"),
            F.sum(F.when(~cancel, F.col("volume")).otherwise(0.0)).alias("trade_volume"),
            F.count_if(cancel).alias("event_cancel_count"),
            F.sum(F.when(cancel, F.col("volume")).otherwise(0.0)).alias("event_cancel_volume"),
        )
    )
    return made.select("wind_code", F.col("window.start").alias("start"), "trade_count", "trade_volume", "event_cancel_count", "event_cancel_volume")


def refresh_shards(bars: DataFrame, path: str, checkpoint: str, order: str = "received"):
    """Appends arriving bars to ``path`` by batch; within a batch the latest row of a (ticker, date) stays."""

    def batch(frame: DataFrame, number: int) -> None:
        clean = latest(frame, ["ticker", "date"], order).withColumn("batch", F.lit(number))
        # a batch that is run again replaces itself
        clean.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return bars.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
