"""Column expressions for panels: rolling windows by ticker and cross sections by date.

A rolling value needs ``least`` non-null rows in its window (all ``n`` unless given).  Division never fails: a zero
denominator gives null.  Correlations are built from covariance and deviations, because ``corr`` raises on constants.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: str | Column) -> Column:
    """NaN and infinities become null."""
    x = col(x)
    return F.when(F.isnan(x) | (F.abs(x) == INF), None).otherwise(x)


def normalize_nulls(df: DataFrame) -> DataFrame:
    """Applies ``finite`` to every floating-point column."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, T.FloatType | T.DoubleType)}
    return df.select(*[finite(F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


def div(x: str | Column, y: str | Column) -> Column:
    return F.try_divide(col(x).cast("double"), col(y).cast("double"))


def div0(x: str | Column, y: str | Column) -> Column:
    """A ratio that is 0 where it isn't defined."""
    return F.coalesce(div(x, y), F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def signed_power(x: str | Column, exponent: float) -> Column:
    return F.signum(col(x)) * F.pow(F.abs(col(x)), F.lit(exponent))


def by_ticker(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*(keys or ("ticker",))).orderBy(order)


def rows(n: int, w: WindowSpec | None = None) -> WindowSpec:
    return (w if w is not None else by_ticker()).rowsBetween(-(n - 1), 0)


def delay(x: str | Column, n: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lag(col(x), n).over(w if w is not None else by_ticker())


def delta(x: str | Column, n: int = 1) -> Column:
    return col(x) - delay(x, n)


def change(x: str | Column, n: int = 1) -> Column:
    """Relative change over ``n`` rows."""
    return div(x, delay(x, n)) - 1


def rolling(agg: Callable[[Column], Column], x: str | Column, n: int, least: int | None = None, w: WindowSpec | None = None) -> Column:
    frame = rows(n, w)
    return F.when(F.count(col(x)).over(frame) >= (n if least is None else least), agg(col(x)).over(frame))


def rolling_mean(x, n: int, least: int | None = None) -> Column:
    return rolling(F.avg, x, n, least)


def rolling_std(x, n: int, least: int | None = None) -> Column:
    return rolling(F.stddev_samp, x, n, least)


def rolling_max(x, n: int) -> Column:
    return rolling(F.max, x, n)


def rolling_sum(x, n: int) -> Column:
    return rolling(F.sum, x, n)


def rolling_corr(x: str | Column, y: str | Column, n: int) -> Column:
    frame = rows(n)
    a, b = F.when(col(y).isNotNull(), col(x)), F.when(col(x).isNotNull(), col(y))
    value = div(F.covar_samp(a, b).over(frame), F.stddev_samp(a).over(frame) * F.stddev_samp(b).over(frame))
    return F.when(F.count(a).over(frame) >= n, value)


def ts_rank(x: str | Column, n: int) -> Column:
    """Percentile rank of the last value within its window, ties averaged."""
    x = col(x)
    seen = F.collect_list(x).over(rows(n))
    below, same = F.size(F.filter(seen, lambda v: v < x)), F.size(F.filter(seen, lambda v: v == x))
    return F.when((F.size(seen) == n) & x.isNotNull(), (below + (same + 1) / 2) / n)


def decay_linear(x: str | Column, n: int) -> Column:
    """Mean with weights 1..n, the newest row the heaviest."""
    total = None
    for k in range(n):
        term = delay(x, n - 1 - k) * (k + 1) if k < n - 1 else col(x) * n
        total = term if total is None else total + term
    return total / (n * (n + 1) / 2)


def average_rank(x: str | Column, *keys: str) -> Column:
    """Rank 1..n among the non-null values of a group, ties averaged."""
    x = col(x)
    w = Window.partitionBy(*keys).orderBy(x.asc_nulls_last())
    return F.when(x.isNotNull(), (F.rank().over(w) + F.count(x).over(w)) / 2)


def cs_rank(x: str | Column, *keys: str) -> Column:
    """Percentile rank in the cross section."""
    keys = keys or ("date",)
    return average_rank(x, *keys) / F.count(col(x)).over(Window.partitionBy(*keys))


def cs_zscore(x: str | Column, *keys: str) -> Column:
    w = Window.partitionBy(*(keys or ("date",)))
    return div(col(x) - F.avg(col(x)).over(w), F.nullif(F.stddev_samp(col(x)).over(w), F.lit(0.0)))


def winsorize(x: str | Column, low: float = 0.01, high: float = 0.99, *keys: str) -> Column:
    x, w = col(x), Window.partitionBy(*(keys or ("date",)))
    a, b = F.percentile(x, F.lit(low)).over(w), F.percentile(x, F.lit(high)).over(w)
    return F.when(x.isNotNull(), F.greatest(F.least(x, b), a))


def bucket(x: str | Column, q: int | Column, *keys: str, tie: str = "ticker") -> Column:
    """Quantile bucket 0..q-1 of the rank in order of appearance; edges are linear quantiles, closed on the right."""
    x = col(x)
    place = F.row_number().over(Window.partitionBy(*keys, x.isNull()).orderBy(x, tie))
    n = F.count(x).over(Window.partitionBy(*keys))
    q = F.lit(q) if isinstance(q, int) else q
    at = F.ceil(F.try_divide(((place - 1) * q).cast("double"), (n - 1).cast("double")))
    return F.when(x.isNotNull(), F.greatest(F.coalesce(at, F.lit(1)), F.lit(1)).cast("int") - 1)


def pearson(x: str | Column, y: str | Column) -> Column:
    """Aggregate: correlation, null for constants."""
    return div(F.covar_samp(col(x), col(y)), F.stddev_samp(col(x)) * F.stddev_samp(col(y)))


def ratio_or_zero(mean: Column, std: Column) -> Column:
    """mean / std; 0 where std is 0, null where it is unknown."""
    return F.when(std == 0, F.lit(0.0)).otherwise(div(mean, std))
