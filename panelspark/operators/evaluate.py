"""Factor evaluation on the long form (ticker, date, factor, value, label): rank correlations, verdicts, reports.

Every function handles all factors in one job, keyed by factor: nothing loops over factors or dates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import average_rank, bucket, div, finite, pearson, ratio_or_zero

#: The limits of the five gates.
MIN_ICIR, MIN_T, MIN_MONOTONICITY, MIN_SHARPE, MAX_DRAWDOWN = 0.5, 2.0, 0.7, 1.0, -0.30
#: Verdicts (insufficient, candidate, near, partial, fail) and classes of a mean IC.
VERDICTS = ("数据不足", "可盈利候选", "接近达标", "部分达标", "未达标")
SIGNALS = ("强信号", "待观察", "负向信号", "弱信号")
MIN_AGREEMENT, MIN_YEARS, MIN_ORTH_IC, MIN_ORTH_IR = 0.80, 2, 0.01, 0.3


def _spearman(rows: DataFrame, *keys: str) -> DataFrame:
    """(*keys, n, ic): average-rank correlation of value and label; null unless both vary."""
    ranked = rows.select(*keys, average_rank("value", *keys).alias("x"), average_rank("label", *keys).alias("y"))
    made = ranked.groupBy(*keys).agg(F.count("*").alias("n"), pearson("x", "y").alias("ic"))
    return made


def pairs(long: DataFrame) -> DataFrame:
    return long.where(F.col("value").isNotNull() & F.col("label").isNotNull() & F.col("date").isNotNull())


def daily_ic(long: DataFrame) -> DataFrame:
    """(factor, date, ic) of the dates with two or more pairs that vary on both sides; noise beyond 12 digits is cut."""
    return _spearman(pairs(long), "factor", "date").where("n >= 2 and ic is not null").select("factor", "date", F.round("ic", 12).alias("ic"))


def ic_stats(ic: DataFrame) -> DataFrame:
    """(factor, mean_ic, ic_std, ic_ir, positive_ic_rate, days)."""
    made = ic.groupBy("factor").agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("ic_std"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_ic_rate"), F.count("*").alias("days"))
    return made.withColumn("ic_ir", ratio_or_zero(F.col("mean_ic"), F.col("ic_std")))


def ic_report(long: DataFrame) -> DataFrame:
    """IC statistics and the pooled rank correlation of each factor, best mean first."""
    pooled = _spearman(pairs(long), "factor").select("factor", F.col("ic").alias("overall_rank_corr"))
    out = ic_stats(daily_ic(long)).join(pooled, "factor", "left")
    return out.orderBy(F.col("mean_ic").desc_nulls_last(), "factor")


def bucketed(long: DataFrame, quantiles: int = 5) -> DataFrame:
    """Pairs with their bucket, of dates with enough pairs and two distinct values."""
    day = Window.partitionBy("factor", "date")
    rows = pairs(long).withColumn("__n", F.count("*").over(day)).withColumn("__low", F.min("value").over(day)).withColumn("__high", F.max("value").over(day))
    rows = rows.where((F.col("__n") >= quantiles) & (F.col("__low") < F.col("__high")))
    return rows.withColumn("quantile", bucket("value", quantiles, "factor", "date")).drop("__n", "__low", "__high")


def quantile_returns(long: DataFrame, quantiles: int = 5) -> DataFrame:
    """(factor, date, quantile, mean_return, n)."""
    return bucketed(long, quantiles).groupBy("factor", "date", "quantile").agg(F.avg("label").alias("mean_return"), F.count("*").alias("n"))


def monotonicity(by_quantile: DataFrame) -> DataFrame:
    """(factor, monotonicity): rank correlation of bucket and its mean return over dates; 0 where it isn't defined."""
    means = by_quantile.groupBy("factor", "quantile").agg(F.round(F.avg("mean_return"), 12).alias("label")).withColumn("value", F.col("quantile").cast("double"))
    return _spearman(means, "factor").select("factor", F.coalesce("ic", F.lit(0.0)).alias("monotonicity"))


def newey_west(ic: DataFrame, lag: int = 5) -> DataFrame:
    """(factor, nw_t): t statistic of the mean with Bartlett weights; 0 for fewer than two dates or no deviation."""
    series = ic.withColumn("dm", F.col("ic") - F.avg("ic").over(Window.partitionBy("factor")))
    w = Window.partitionBy("factor").orderBy("date")
    series = series.withColumns({f"g{k}": F.col("dm") * F.lag("dm", k).over(w) for k in range(lag + 1)})
    made = series.groupBy("factor").agg(F.count("*").alias("n"), F.avg("ic").alias("mean"), *[F.sum(f"g{k}").alias(f"g{k}") for k in range(lag + 1)])
    n = F.col("n")
    top = F.least(F.lit(lag), n - 1)
    variance = F.col("g0") / n
    total = variance
    for k in range(1, lag + 1):
        total = total + F.when(top >= k, 2 * (1 - F.lit(k) / (top + 1)) * F.coalesce(f"g{k}", F.lit(0.0)) / n).otherwise(0.0)
    used = F.when(total > 0, total).otherwise(variance)
    t = div("mean", F.sqrt(used / n))
    return made.select("factor", F.when((n < 2) | (used <= 0), 0.0).otherwise(t).alias("nw_t"))


def yearly_agreement(ic: DataFrame, least: int = MIN_YEARS) -> DataFrame:
    """(factor, yearly_agreement, years): share of years whose mean has the sign of the mean of years."""
    by_year = ic.groupBy("factor", F.year("date").alias("year")).agg(F.avg("ic").alias("m"))
    sign = F.when(F.avg("m").over(Window.partitionBy("factor")) >= 0, 1).otherwise(-1)
    rows = by_year.withColumn("same", (F.when(F.col("m") >= 0, 1).otherwise(-1) == sign).cast("double"))
    made = rows.groupBy("factor").agg(F.avg("same").alias("share"), F.count("*").alias("years"))
    return made.select("factor", F.when(F.col("years") >= least, F.col("share")).otherwise(0.0).alias("yearly_agreement"), "years")


def orthogonal_daily_ic(long: DataFrame, pool: DataFrame, pool_columns: list[str], least: int = 5) -> DataFrame:
    """(factor, date, ic) of each factor's residual on the pool (least squares with intercept, by date) with the label.

    ``pool`` has (ticker, date, *pool_columns); a factor is not regressed on itself.  Dates with fewer than ``least``
    complete rows, and those where the residual is numerically constant, give none.
    """
    columns = [finite(c).alias(f"__{c}") for c in pool_columns]
    rows = pairs(long).join(pool.select("ticker", "date", *columns), ["ticker", "date"])

    def one_date(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        factor, date = key
        use = [f"__{c}" for c in pool_columns if c != factor]
        frame = frame.replace([np.inf, -np.inf], np.nan).dropna(subset=["value", "label", *use]).sort_values("ticker")
        empty = pd.DataFrame({"factor": pd.Series(dtype=str), "date": pd.Series(dtype=object), "ic": pd.Series(dtype=float)})
        if len(frame) < least or not use:
            return empty
        x = np.column_stack([np.ones(len(frame)), frame[use].to_numpy(float)])
        y = frame["value"].to_numpy(float)
        fit, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
        residual = y - x @ fit
        scale = max(np.abs(y).max(), 1e-300)
        if len(frame) <= rank or np.ptp(residual) <= 1e-12 * scale or frame["label"].nunique() < 2:
            return empty
        a, b = pd.Series(residual).rank(), pd.Series(frame["label"].to_numpy()).rank()
        return pd.DataFrame({"factor": [factor], "date": [date], "ic": [float(np.corrcoef(a, b)[0, 1])]})

    return rows.groupBy("factor", "date").applyInPandas(one_date, "factor string, date date, ic double")


def orthogonal_ic_one(long: DataFrame, pool: DataFrame, column: str, least: int = 5) -> DataFrame:
    """The same for a pool of one column, in closed form and without Python."""
    rows = pairs(long).join(pool.select("ticker", "date", finite(column).alias("z")), ["ticker", "date"]).where("z is not null")
    day = Window.partitionBy("factor", "date")
    beta = div(F.covar_samp("value", "z").over(day), F.var_samp("z").over(day))
    rows = rows.withColumn("n", F.count("*").over(day)).withColumn("residual", F.col("value") - F.avg("value").over(day) - F.coalesce(beta, F.lit(0.0)) * (F.col("z") - F.avg("z").over(day)))
    rows = rows.where(F.col("n") >= least).withColumn("value", F.round("residual", 10))
    return _spearman(rows, "factor", "date").where("ic is not null").select("factor", "date", "ic")


def profile(long: DataFrame) -> DataFrame:
    """(factor, coverage, active_days, median_daily_unique, mean_abs); active days have five distinct values or more."""
    value = finite("value")
    by_day = long.groupBy("factor", "date").agg(F.count("*").alias("n"), F.count(value).alias("there"), F.count_distinct(value).alias("unique"), F.sum(F.abs(value)).alias("abs"))
    return by_day.groupBy("factor").agg(
        div(F.sum("there"), F.sum("n")).alias("coverage"),
        F.count_if(F.col("unique") >= 5).alias("active_days"),
        F.median("unique").alias("median_daily_unique"),
        div(F.sum("abs"), F.sum("there")).alias("mean_abs"),
    )


def discovery_report(long: DataFrame) -> DataFrame:
    """Profile and IC of each factor with a score, best first."""
    out = profile(long).join(ic_stats(daily_ic(long)), "factor", "left")
    score = F.abs(F.coalesce("mean_ic", F.lit(0.0))) + 0.25 * F.abs(F.coalesce("ic_ir", F.lit(0.0))) + 0.1 * F.abs(F.coalesce("positive_ic_rate", F.lit(0.5)) - 0.5)
    return out.withColumn("discovery_score", score).orderBy(F.col("discovery_score").desc_nulls_last(), "factor")


def directional_rate(mean: Column, positive: Column) -> Column:
    return F.when(mean >= 0, positive).otherwise(1 - positive)


def verdict_label(passed: Column, evaluated: Column) -> Column:
    unknown, best, near, partial, fail = VERDICTS
    return F.when(evaluated < 3, unknown).when((passed == 5) & (evaluated == 5), best).when(passed >= 4, near).when(passed >= 3, partial).otherwise(fail)


def gates(df: DataFrame) -> DataFrame:
    """Adds the five gates (null: not evaluated), passed, evaluated and verdict.

    Reads ic_ir, nw_t, monotonicity, information_ratio, max_drawdown, yearly_agreement, years, ic_orth, orth_ir.
    """
    made = {
        "gate_ic": (F.abs("ic_ir") >= MIN_ICIR) & (F.abs("nw_t") >= MIN_T),
        "gate_monotonicity": F.abs("monotonicity") >= MIN_MONOTONICITY,
        "gate_backtest": (F.col("information_ratio") >= MIN_SHARPE) & (F.col("max_drawdown") > MAX_DRAWDOWN),
        "gate_yearly": F.when(F.col("years") >= MIN_YEARS, F.col("yearly_agreement") >= MIN_AGREEMENT),
        "gate_orthogonal": (F.abs("ic_orth") >= MIN_ORTH_IC) & (F.abs("orth_ir") >= MIN_ORTH_IR),
    }
    out = df.withColumns(made)
    passed = sum((F.coalesce(F.col(g), F.lit(False)).cast("int") for g in made), F.lit(0))
    evaluated = sum((F.col(g).isNotNull().cast("int") for g in made), F.lit(0))
    return out.withColumn("passed", passed).withColumn("evaluated", evaluated).withColumn("verdict", verdict_label(F.col("passed"), F.col("evaluated")))


def verdict(long: DataFrame, backtest_metrics: DataFrame, orthogonal: DataFrame | None = None, quantiles: int = 5) -> DataFrame:
    """One row for each factor with all gate inputs and the verdict."""
    ic = daily_ic(long)
    out = ic_stats(ic).join(newey_west(ic), "factor", "left").join(yearly_agreement(ic), "factor", "left")
    out = out.join(monotonicity(quantile_returns(long, quantiles)), "factor", "left")
    out = out.join(backtest_metrics.select("factor", "information_ratio", "max_drawdown", "average_turnover"), "factor", "left")
    if orthogonal is None:
        out = out.withColumns({"ic_orth": F.lit(None).cast("double"), "orth_ir": F.lit(None).cast("double")})
    else:
        out = out.join(ic_stats(orthogonal).select("factor", F.col("mean_ic").alias("ic_orth"), F.col("ic_ir").alias("orth_ir")), "factor", "left")
    return gates(out).orderBy(F.col("passed").desc(), F.col("mean_ic").desc_nulls_last(), "factor")


def validation_report(long: DataFrame, backtest_metrics: DataFrame, orthogonal: DataFrame, min_coverage: float = 0.2) -> DataFrame:
    """Verdicts of experimental factors with enough coverage, and a score."""
    out = verdict(long, backtest_metrics, orthogonal).join(profile(long), "factor").where(F.col("coverage") >= min_coverage)
    zero = F.lit(0.0)
    score = F.abs(F.coalesce("ic_orth", zero)) + 0.05 * F.abs(F.coalesce("orth_ir", zero)) + 0.01 * F.col("passed") - 0.005 * F.coalesce("average_turnover", zero)
    out = out.withColumn("directional_rate", directional_rate(F.col("mean_ic"), F.col("positive_ic_rate"))).withColumn("validation_score", score)
    return out.orderBy(F.col("validation_score").desc_nulls_last(), F.col("passed").desc(), "factor")


def signal_class(mean_ic: Column) -> Column:
    strong, watch, negative, weak = SIGNALS
    return F.when(mean_ic >= 0.03, strong).when(mean_ic >= 0.01, watch).when(mean_ic <= -0.01, negative).otherwise(weak)
