"""Daily factors: a registry of specifications and a compiler that evaluates any of them in four window stages.

Stages alternate between windows by ticker and cross sections by date: (1) by ticker, (2) by date, (3) by ticker again,
(4) by date again.  All columns of a stage are made in one projection, so the whole registry costs four exchanges.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import change, cs_rank, cs_zscore, decay_linear, delay, delta, div, finite, rolling_corr, rolling_max, rolling_mean, rolling_std, rolling_sum, ts_rank

BAR_COLUMNS = ("ticker", "date", "open", "high", "low", "close", "volume", "vwap")


@dataclass(frozen=True)
class FactorSpec:
    name: str
    category: str
    formula: str
    lookback: int
    stage: int
    enabled: bool = True
    expected_direction: int = 1


#: Names, categories and lookbacks of the registered factors.  Formulas are in this engine's own function
#: names (``functions/expr.py``); the last number is the stage that makes a factor.
REGISTRY = (
    FactorSpec("reversal_1d", "price_reversal", "-change(close, 1)", 1, 1),
    FactorSpec("momentum_5d", "price_momentum", "change(close, 5)", 5, 1),
    FactorSpec("momentum_21d", "price_momentum", "change(close, 21)", 21, 1),
    FactorSpec("momentum_63d", "price_momentum", "change(close, 63)", 63, 1),
    FactorSpec("volatility_21d", "risk", "std(ret_1d, 21)", 21, 2),
    FactorSpec("volume_z_21d", "volume", "(volume - mean(volume, 21)) / std(volume, 21)", 21, 1),
    FactorSpec("dollar_volume", "liquidity", "close * volume", 1, 1),
    FactorSpec("close_to_high", "intraday_position", "(high - close) / (high - low)", 1, 1),
    FactorSpec("close_to_low", "intraday_position", "(close - low) / (high - low)", 1, 1),
    FactorSpec("vwap_gap", "intraday_position", "close / vwap - 1", 1, 1),
    FactorSpec("alpha_open_volume_corr_10", "formula_alpha", "-corr(rank(open), rank(volume), 10)", 10, 4),
    FactorSpec("alpha_vwap_reversion_10", "formula_alpha", "-rank(open - decay_linear(vwap, 10))", 10, 3),
    FactorSpec("alpha_range_ts_rank_9", "formula_alpha", "-ts_rank(delta(high - low, 1), 9)", 10, 2),
    FactorSpec("alpha_overnight_gap_reversal_5", "formula_alpha", "-ts_rank(open / delay(close, 1) - 1, 5)", 6, 2),
    FactorSpec("alpha_intraday_strength_5", "formula_alpha", "ts_rank((close - open) / open, 5)", 5, 2),
    FactorSpec("alpha_volume_price_divergence_21", "formula_alpha", "-corr(rank(close), rank(volume), 21)", 21, 4),
    FactorSpec("alpha_low_volatility_21d", "risk", "-std(ret_1d, 21)", 21, 2),
    FactorSpec("alpha_price_to_21d_high", "price_momentum", "close / max(high, 21) - 1", 21, 1),
    FactorSpec("alpha_ma_gap_21d", "price_momentum", "close / mean(close, 21) - 1", 21, 1),
    FactorSpec("alpha_liquidity_quality_21d", "liquidity", "-mean(abs(ret_1d) / dollar_volume, 21)", 21, 2),
    FactorSpec("alpha_close_position_5", "intraday_position", "ts_rank(close_to_low, 5)", 5, 2),
    FactorSpec("alpha_residual_momentum_21d", "residual_price_path", "sum(ret_1d - market, 21)", 21, 4),
    FactorSpec("alpha_residual_reversal_5d", "residual_price_path", "-sum(ret_1d - market, 5)", 5, 4),
    FactorSpec("alpha_range_compression_21d", "price_path", "-((high - low) / mean(high - low, 21) - 1)", 21, 2),
    FactorSpec("alpha_volatility_contraction_21d", "risk", "-(std(ret_1d, 5) / std(ret_1d, 21) - 1)", 21, 2),
    FactorSpec("alpha_volume_trend_5_21d", "volume", "mean(volume, 5) / mean(volume, 21) - 1", 21, 1),
    FactorSpec("alpha_intraday_quality_21d", "intraday_position", "mean(intraday, 21) / std(intraday, 21)", 21, 2),
    FactorSpec("alpha_gap_pressure_21d", "overnight_path", "mean(gap, 21) / std(gap, 21)", 21, 2),
    FactorSpec("ml_prediction_5d", "machine_learning", "walk-forward model prediction", 252, 0),
)
FACTORS = tuple(s.name for s in REGISTRY if s.stage)
HELPERS = ("ret_1d", "market_residual_ret_1d", "overnight_gap", "intraday_return", "daily_range")


def spec(name: str) -> FactorSpec:
    for s in REGISTRY:
        if s.name == name:
            return s
    raise KeyError(name)


def registry_frame(spark: SparkSession, enabled_only: bool = True) -> DataFrame:
    return spark.createDataFrame([asdict(s) for s in REGISTRY if s.enabled or not enabled_only])


def _first() -> dict[str, Column]:
    """By ticker, from bars alone."""
    high, low, close, volume = (F.col(c) for c in ("high", "low", "close", "volume"))
    spread = F.nullif(high - low, F.lit(0.0))
    return {
        "ret_1d": change("close"),
        "overnight_gap": div("open", delay("close")) - 1,
        "intraday_return": div(close - F.col("open"), "open"),
        "daily_range": spread,
        "range_delta": delta(high - low),
        "vwap_decay": decay_linear("vwap", 10),
        "reversal_1d": -change("close"),
        "momentum_5d": change("close", 5),
        "momentum_21d": change("close", 21),
        "momentum_63d": change("close", 63),
        "volume_z_21d": div(volume - rolling_mean("volume", 21), F.nullif(rolling_std("volume", 21), F.lit(0.0))),
        "dollar_volume": close * volume,
        "close_to_high": div(high - close, spread),
        "close_to_low": div(close - low, spread),
        "vwap_gap": div(close, "vwap") - 1,
        "alpha_price_to_21d_high": div(close, rolling_max("high", 21)) - 1,
        "alpha_ma_gap_21d": div(close, rolling_mean("close", 21)) - 1,
        "alpha_volume_trend_5_21d": div(rolling_mean("volume", 5), rolling_mean("volume", 21)) - 1,
    }


def _second() -> dict[str, Column]:
    """By ticker, from the first."""
    vol = rolling_std("ret_1d", 21)

    def quality(x: str) -> Column:
        return div(rolling_mean(x, 21), F.nullif(rolling_std(x, 21), F.lit(0.0)))

    return {
        "illiquidity": div(F.abs("ret_1d"), F.nullif(F.col("dollar_volume"), F.lit(0.0))),
        "volatility_21d": vol,
        "alpha_low_volatility_21d": -vol,
        "alpha_range_ts_rank_9": -ts_rank("range_delta", 9),
        "alpha_overnight_gap_reversal_5": -ts_rank("overnight_gap", 5),
        "alpha_intraday_strength_5": ts_rank("intraday_return", 5),
        "alpha_close_position_5": ts_rank("close_to_low", 5),
        "alpha_range_compression_21d": -(div(F.col("high") - F.col("low"), rolling_mean("daily_range", 21)) - 1),
        "alpha_volatility_contraction_21d": -(div(rolling_std("ret_1d", 5), F.nullif(vol, F.lit(0.0))) - 1),
        "alpha_intraday_quality_21d": quality("intraday_return"),
        "alpha_gap_pressure_21d": quality("overnight_gap"),
    }


def _across() -> dict[str, Column]:
    """By date."""
    day = Window.partitionBy("date")
    return {
        "market_residual_ret_1d": F.col("ret_1d") - F.avg("ret_1d").over(day),
        "open_rank": cs_rank("open"),
        "close_rank": cs_rank("close"),
        "volume_rank": cs_rank("volume"),
        "alpha_vwap_reversion_10": -cs_rank(F.col("open") - F.col("vwap_decay")),
    }


def _last() -> dict[str, Column]:
    """By ticker, from cross sections."""
    return {
        "alpha_liquidity_quality_21d": -rolling_mean("illiquidity", 21),
        "alpha_open_volume_corr_10": -rolling_corr("open_rank", "volume_rank", 10),
        "alpha_volume_price_divergence_21": -rolling_corr("close_rank", "volume_rank", 21),
        "alpha_residual_momentum_21d": rolling_sum("market_residual_ret_1d", 21),
        "alpha_residual_reversal_5d": -rolling_sum("market_residual_ret_1d", 5),
    }


def add_factors(bars: DataFrame) -> DataFrame:
    """Bars with the helper columns and all 28 computed factors; values that aren't finite are null."""
    if missing := sorted(set(BAR_COLUMNS) - set(bars.columns)):
        raise ValueError(f"Missing required columns: {missing}")
    out = bars
    for stage in (_first, _second, _across, _last):
        out = out.withColumns(stage())
    return out.select(*bars.columns, *HELPERS, *[finite(f).alias(f) for f in FACTORS])


def add_cross_sections(df: DataFrame, columns: Iterable[str], ranks: bool = True, zscores: bool = True) -> DataFrame:
    """Adds <c>_rank and <c>_zscore by date for the columns that exist."""
    made: dict[str, Column] = {}
    for c in columns:
        if c in df.columns:
            if ranks:
                made[f"{c}_rank"] = cs_rank(finite(c))
            if zscores:
                made[f"{c}_zscore"] = cs_zscore(finite(c))
    return df.withColumns(made)


def to_long(df: DataFrame, factors: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """(ticker, date, *keep, factor, value): one row for each factor."""
    return df.unpivot(["ticker", "date", *keep], [F.col(f).cast("double").alias(f) for f in factors], "factor", "value")
