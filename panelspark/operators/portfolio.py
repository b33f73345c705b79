"""Quantile portfolios of all factors at once: weights, turnover, returns, metrics, benchmark, leaderboard, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import div, ratio_or_zero
from .evaluate import bucketed, daily_ic, ic_stats

YEAR = 252
#: Error codes that fail a factor, and their limits.
FATAL = ("MISSING_FACTOR", "LOW_COVERAGE", "LOW_ACTIVE_DAYS", "CONSTANT_CROSS_SECTION")


def weights(long: DataFrame, quantiles: int = 5) -> DataFrame:
    """(factor, date, ticker, side, weight, label): the top bucket long, the bottom bucket short, equal weights."""
    rows = bucketed(long, quantiles).where(F.col("quantile").isin(0, quantiles - 1))
    n = F.count("*").over(Window.partitionBy("factor", "date", "quantile"))
    side = F.when(F.col("quantile") == quantiles - 1, "long").otherwise("short")
    weight = F.when(F.col("quantile") == quantiles - 1, 1 / n).otherwise(-1 / n)
    return rows.select("factor", "date", "ticker", side.alias("side"), weight.alias("weight"), "label")


def turnover(held: DataFrame) -> DataFrame:
    """(factor, date, turnover): mean over both sides of the share of names that changed since the date before; 1 at first."""
    sets = held.groupBy("factor", "date").agg(*[F.collect_set(F.when(F.col("side") == s, F.col("ticker"))).alias(s) for s in ("long", "short")])
    w = Window.partitionBy("factor").orderBy("date")

    def side(c: str) -> Column:
        before = F.coalesce(F.lag(c).over(w), F.array().cast(sets.schema[c].dataType))
        union = F.size(F.array_union(c, before))
        changed = F.size(F.array_except(F.col(c), before)) + F.size(F.array_except(before, F.col(c)))
        return changed / F.greatest(union, F.lit(1))

    return sets.select("factor", "date", ((side("long") + side("short")) / 2).alias("turnover"))


def benchmark(long: DataFrame) -> DataFrame:
    """(date, benchmark_return): mean forward return of all tickers of the date."""
    one = long.select("ticker", "date", "label").where("label is not null").groupBy("ticker", "date").agg(F.first("label").alias("label"))
    return one.groupBy("date").agg(F.avg("label").alias("benchmark_return"))


def returns(long: DataFrame, quantiles: int = 5, cost_bps: float = 5.0, held: DataFrame | None = None) -> DataFrame:
    """Daily returns of each factor's portfolio, with cumulative products."""
    held = weights(long, quantiles) if held is None else held
    legs = held.groupBy("factor", "date").agg(
        F.sum(F.when(F.col("side") == "long", F.col("weight") * F.col("label")).otherwise(0.0)).alias("long_return"),
        F.sum(F.when(F.col("side") == "short", -F.col("weight") * F.col("label")).otherwise(0.0)).alias("short_leg_return"),
        F.count_if(F.col("side") == "long").alias("top_count"),
        F.count_if(F.col("side") == "short").alias("bottom_count"),
    )
    out = legs.join(turnover(held), ["factor", "date"]).join(benchmark(long), "date", "left")
    out = out.withColumn("cost", F.col("turnover") * cost_bps / 10_000)
    out = out.withColumn("spread_return", F.col("long_return") - F.col("short_leg_return") - F.col("cost")).withColumn("long_excess_return", F.col("long_return") - F.col("benchmark_return"))
    run = Window.partitionBy("factor").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    names = {"long_return": "cumulative_long_return", "spread_return": "cumulative_spread_return", "benchmark_return": "cumulative_benchmark_return", "long_excess_return": "cumulative_long_excess_return"}
    return out.withColumns({new: F.product(1 + F.col(old)).over(run) - 1 for old, new in names.items()})


def drawdowns(daily: DataFrame, column: str = "spread_return") -> DataFrame:
    """(factor, date, equity, drawdown): equity over its running maximum, less 1."""
    run = Window.partitionBy("factor").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = daily.where(F.col(column).isNotNull()).select("factor", "date", F.product(1 + F.col(column)).over(run).alias("equity"))
    return out.withColumn("drawdown", div("equity", F.max("equity").over(run)) - 1)


def _measures(column: str, prefix: str, horizon: int) -> dict[str, Column]:
    """Aggregates of one daily return, whose drawdowns are in ``__dd_<column>``; nulls take no part."""
    r = F.col(column)
    return {
        f"{prefix}periods": F.count(r),
        f"{prefix}total_return": F.product(1 + r) - 1,
        f"{prefix}annualized_return": F.avg(r) * (YEAR / horizon),
        f"{prefix}annualized_volatility": F.coalesce(F.stddev_samp(r), F.lit(0.0)) * (YEAR / horizon) ** 0.5,
        f"{prefix}hit_rate": F.avg((r > 0).cast("double")),
        f"{prefix}downside_volatility": F.coalesce(F.stddev_samp(F.when(r < 0, r)), F.lit(0.0)) * (YEAR / horizon) ** 0.5,
        f"{prefix}max_drawdown": F.min(f"__dd_{column}"),
    }


def _with_drawdowns(daily: DataFrame, *columns: str) -> DataFrame:
    run = Window.partitionBy("factor").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = daily.withColumns({f"__eq_{c}": F.product(1 + F.col(c)).over(run) for c in columns})
    return out.withColumns({f"__dd_{c}": div(f"__eq_{c}", F.max(f"__eq_{c}").over(run)) - 1 for c in columns})


def return_metrics(daily: DataFrame, column: str = "spread_return", horizon: int = 1) -> DataFrame:
    """One row for each factor: total and annual return, volatility, information ratio, drawdown, hit rate, calmar."""
    rows = _with_drawdowns(daily.where(F.col(column).isNotNull()), column)
    made = rows.groupBy("factor").agg(*[e.alias(k) for k, e in _measures(column, "", horizon).items()])
    made = made.withColumn("information_ratio", ratio_or_zero(F.col("annualized_return"), F.col("annualized_volatility")))
    return made.withColumn("calmar", F.coalesce(div("annualized_return", F.abs("max_drawdown")), F.lit(0.0)))


def metrics(daily: DataFrame, horizon: int = 1) -> DataFrame:
    """All portfolio metrics of each factor: one pass of windows over the daily returns and one aggregate.

    Beta and correlation of the long leg with the benchmark, and the metrics of its excess, count dates that have both;
    beta, correlation and calmar are zero where undefined.
    """
    x, y = F.col("long_return"), F.col("benchmark_return")
    both = x.isNotNull() & y.isNotNull()
    rows = _with_drawdowns(daily.withColumn("__excess", x - y), "spread_return", "__excess")
    own, excess = _measures("spread_return", "", horizon), _measures("__excess", "__x_", horizon)
    more = {
        "__beta": div(F.covar_samp(x, y), F.var_samp(F.when(both, y))),
        "__correlation": div(F.covar_samp(x, y), F.stddev_samp(F.when(both, x)) * F.stddev_samp(F.when(both, y))),
        **{name: F.product(1 + F.col(c)) - 1 for c, name in (("long_return", "long_total_return"), ("benchmark_return", "benchmark_total_return"), ("long_excess_return", "long_excess_total_return"))},
        "average_turnover": F.avg("turnover"),
        "average_cost": F.avg("cost"),
    }
    made = rows.groupBy("factor").agg(*[e.alias(k) for k, e in (own | excess | more).items()]).where("periods > 0")
    zero, told = F.lit(0.0), F.col("__x_periods") > 0
    made = made.withColumn("information_ratio", ratio_or_zero(F.col("annualized_return"), F.col("annualized_volatility")))
    made = made.withColumn("calmar", F.coalesce(div("annualized_return", F.abs("max_drawdown")), zero))
    made = made.withColumn("benchmark_beta", F.when(told, F.coalesce("__beta", zero))).withColumn("benchmark_correlation", F.when(told, F.coalesce("__correlation", zero)))
    made = made.withColumn("excess_total_return", F.col("__x_total_return")).withColumn("excess_max_drawdown", F.col("__x_max_drawdown"))
    made = made.withColumn("excess_information_ratio", F.when(told, ratio_or_zero(F.col("__x_annualized_return"), F.col("__x_annualized_volatility"))))
    names = [*own, "information_ratio", "calmar", "benchmark_beta", "benchmark_correlation", "excess_total_return", "excess_information_ratio", "excess_max_drawdown", *[k for k in more if not k.startswith("__")]]
    return made.select("factor", *names)


def leaderboard(long: DataFrame, ic_long: DataFrame, quantiles: int = 5, cost_bps: float = 5.0) -> DataFrame:
    """Metrics and IC of each factor that can be traded; score = IR + IC IR + (hit rate - 0.5) - 0.1 turnover."""
    out = metrics(returns(long, quantiles, cost_bps)).join(ic_stats(daily_ic(ic_long)).select("factor", "mean_ic", "ic_ir"), "factor", "left")
    score = F.col("information_ratio") + F.coalesce("ic_ir", F.lit(0.0)) + (F.col("hit_rate") - 0.5) - 0.1 * F.col("average_turnover")
    return out.withColumn("score", score).orderBy(F.col("score").desc_nulls_last(), "factor")


def diagnostics(long: DataFrame, ic_long: DataFrame, quantiles: int = 5, cost_bps: float = 5.0, min_coverage: float = 0.6, min_days: int = 100, active_only: tuple[str, ...] = ("ml_prediction_5d",)) -> DataFrame:
    """(factor, status, error_codes, ...): checks of data, signal and portfolio of every factor in one job.

    Factors in ``active_only`` are judged on the dates on which they have values.
    """
    value = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    by_day = long.groupBy("factor", "date").agg(F.count("*").alias("n"), F.count(value).alias("there"), F.count_distinct(value).alias("unique"))
    scoped = by_day.where(~F.col("factor").isin(*active_only) | (F.col("unique") > 0))
    data = scoped.groupBy("factor").agg(div(F.sum("there"), F.sum("n")).alias("coverage"), F.count_if(F.col("unique") >= quantiles).alias("active_days"), F.median("unique").alias("median_daily_unique"))
    out = by_day.select("factor").distinct().join(data, "factor", "left")
    zero = F.lit(0.0)
    out = out.fillna(0.0, ["coverage", "median_daily_unique"]).fillna(0, ["active_days"])
    out = out.join(ic_stats(daily_ic(ic_long)).select("factor", "mean_ic", "ic_ir", "positive_ic_rate"), "factor", "left").fillna(0.0, ["mean_ic", "ic_ir", "positive_ic_rate"])
    out = out.join(metrics(returns(long, quantiles, cost_bps)), "factor", "left")
    traded = F.col("periods").isNotNull()
    ir, ic = F.coalesce("information_ratio", zero), F.col("mean_ic")
    codes = {
        "LOW_COVERAGE": F.col("coverage") < min_coverage,
        "LOW_ACTIVE_DAYS": F.col("active_days") < min_days,
        "CONSTANT_CROSS_SECTION": F.col("median_daily_unique") < quantiles,
        "WEAK_SIGNAL": (F.abs(ic) < 0.01) & (F.abs("ic_ir") < 0.05),
        "BACKTEST_NO_VALID_PERIODS": ~traded,
        "NEGATIVE_PORTFOLIO": traded & ((ir < 0) | (F.col("total_return") < 0)),
        "POOR_EXCESS_RETURN": traded & (F.coalesce("excess_total_return", zero) < 0),
        "HIGH_BENCHMARK_BETA": traded & (F.coalesce("benchmark_beta", zero) > 1.5),
        "HIGH_BENCHMARK_CORRELATION": traded & (F.coalesce("benchmark_correlation", zero) > 0.9),
        "HIGH_DRAWDOWN": traded & (F.coalesce("max_drawdown", zero) < -0.35),
        "HIGH_TURNOVER": traded & (F.coalesce("average_turnover", zero) > 0.8),
        "IC_BACKTEST_MISMATCH": traded & (((ic > 0.01) & (ir < 0)) | ((ic < -0.01) & (ir > 0))),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in codes.items()]), lambda x: x.isNotNull())
    out = out.withColumn("__codes", found)
    status = F.when(F.arrays_overlap("__codes", F.array(*map(F.lit, FATAL))), "fail").when(F.size("__codes") > 0, "review").otherwise("pass")
    order = F.when(F.col("status") == "pass", 0).when(F.col("status") == "review", 1).otherwise(2)
    out = out.withColumn("status", status).withColumn("error_codes", F.array_join("__codes", ",")).drop("__codes")
    return out.orderBy(order, F.col("information_ratio").desc_nulls_last(), F.col("mean_ic").desc_nulls_last(), "factor")
