"""Forward-return labels and their cross-sectional transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bucket, by_ticker, cs_rank, cs_zscore, div

TRANSFORMS = ("return", "rank", "zscore", "quantile", "top_bottom")


def forward_return(horizon: int, price: str = "close") -> Column:
    """close[t + h] / close[t] - 1 by ticker."""
    return div(F.lead(price, horizon).over(by_ticker()), price) - 1


def add_forward_return(df: DataFrame, horizon: int = 5, name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"future_return_{horizon}d", forward_return(horizon))


def add_label(df: DataFrame, horizon: int = 5, transform: str = "return", quantiles: int = 5, name: str | None = None) -> DataFrame:
    """A label ``future_return_{h}d[_{transform}]``.

    rank: percentile by date.  zscore: by date.  quantile: bucket among min(quantiles, n), null for n < 2.
    top_bottom: only buckets 0 and quantiles - 1, null where n < max(2, quantiles).
    """
    if transform not in TRANSFORMS:
        raise ValueError(f"Unknown label transform: {transform}")
    name = name or f"future_return_{horizon}d" + ("" if transform == "return" else f"_{transform}")
    df = df.withColumn("__r", forward_return(horizon))
    n = F.count("__r").over(Window.partitionBy("date"))
    if transform == "return":
        value = F.col("__r")
    elif transform == "rank":
        value = cs_rank("__r")
    elif transform == "zscore":
        value = cs_zscore("__r")
    elif transform == "quantile":
        value = F.when(n >= 2, bucket("__r", F.least(n, F.lit(quantiles)), "date"))
    else:
        at = bucket("__r", quantiles, "date")
        value = F.when((n >= max(2, quantiles)) & at.isin(0, quantiles - 1), at)
    return df.withColumn(name, value).drop("__r")
