"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.  The SQL they must equal is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as E
from ..operators import evaluate, factors, ingest, kline, labels, latent, orderflow, portfolio
from ..sources import adapters as A

IC_FACTORS = ("momentum_5d", "reversal_1d", "volatility_21d", "close_to_low", "vwap_gap")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*[(F.round(c.name, digits) + F.lit(0.0)).alias(c.name) if isinstance(c.dataType, T.DoubleType) else F.col(c.name) for c in df.schema.fields])


def compounded(df: DataFrame, *names: str) -> DataFrame:
    """Columns that are products over many dates, on a signed logarithmic scale: digits are compared, not magnitudes."""
    return df.withColumns({c: F.signum(c) * F.log1p(F.abs(c)) for c in names})


def _bars(s: SparkSession, d: str) -> DataFrame:
    return A.bars_week(s, d)


def _factors(s: SparkSession, d: str) -> DataFrame:
    return factors.add_factors(_bars(s, d))


def _long(s: SparkSession, d: str, horizon: int = 5, names: tuple[str, ...] = IC_FACTORS) -> DataFrame:
    panel = labels.add_forward_return(_factors(s, d), horizon, "label")
    long = factors.to_long(panel, names, ["label"])
    return long.select("ticker", "date", "factor", F.round("value", 10).alias("value"), F.round("label", 10).alias("label"))


def q_bars_week(s, d):
    return rounded(_bars(s, d))


def q_bars_user_day(s, d):
    return rounded(A.bars_user_day(s, d))


def q_delay_delta(s, d):
    return rounded(_bars(s, d).select("ticker", "date", E.delay("close", 2).alias("delay_2"), E.delta("close", 3).alias("delta_3")))


def q_rolling(s, d):
    return rounded(_bars(s, d).select("ticker", "date", E.rolling_mean("close", 5).alias("mean_5"), E.rolling_std("close", 5).alias("std_5"), E.rolling_max("high", 5).alias("max_5"), E.rolling_corr("close", "volume", 10).alias("corr_10")))


def q_ts_rank(s, d):
    return rounded(_bars(s, d).select("ticker", "date", E.ts_rank("close", 9).alias("ts_rank_9")))


def q_decay_linear(s, d):
    return rounded(_bars(s, d).select("ticker", "date", E.decay_linear("vwap", 10).alias("decay_10"), E.signed_power(E.delta("close", 1), 0.5).alias("power")))


def q_cross_section(s, d):
    return rounded(_bars(s, d).select("ticker", "date", E.cs_rank("close").alias("rank"), E.cs_zscore("volume").alias("zscore"), E.winsorize("close", 0.05, 0.95).alias("clipped")))


def q_factors_base(s, d):
    return rounded(_factors(s, d).select("ticker", "date", *factors.FACTORS[:10]))


def q_factors_formula(s, d):
    return rounded(_factors(s, d).select("ticker", "date", *factors.FACTORS[10:21]))


def q_factors_path(s, d):
    return rounded(_factors(s, d).select("ticker", "date", *factors.FACTORS[21:], *factors.HELPERS))


def q_factor_ranks(s, d):
    base = _factors(s, d).select("ticker", "date", F.round("momentum_5d", 10).alias("momentum_5d"), "dollar_volume")
    return rounded(factors.add_cross_sections(base, ["momentum_5d", "dollar_volume", "absent"]).drop("momentum_5d", "dollar_volume"))


def q_registry(s, d):
    return factors.registry_frame(s).select("name", "category", "formula", "lookback", "stage", "enabled", "expected_direction")


def _label(transform: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(s, d):
        return rounded(labels.add_label(_bars(s, d), 5, transform, 5, "label").select("ticker", "date", F.col("label").cast("double").alias("label")))

    return run


q_label_return, q_label_rank, q_label_zscore, q_label_quantile, q_label_top_bottom = map(_label, labels.TRANSFORMS)


def q_daily_ic(s, d):
    return rounded(evaluate.daily_ic(_long(s, d)))


def q_ic_momentum_5d(s, d):
    return rounded(evaluate.ic_stats(evaluate.daily_ic(_long(s, d, names=("momentum_5d",)))))


def q_ic_report(s, d):
    return rounded(evaluate.ic_report(_long(s, d)))


def q_quantile_returns(s, d):
    return rounded(evaluate.quantile_returns(_long(s, d)))


def q_monotonicity(s, d):
    return rounded(evaluate.monotonicity(evaluate.quantile_returns(_long(s, d))))


def q_newey_west(s, d):
    return rounded(evaluate.newey_west(evaluate.daily_ic(_long(s, d))))


def q_yearly_agreement(s, d):
    return rounded(evaluate.yearly_agreement(evaluate.daily_ic(_long(s, d))))


def _pool(s, d):
    return _factors(s, d).select("ticker", "date", *kline.POOL)


def q_orth_ic_small_pool(s, d):
    long = _long(s, d, names=("momentum_5d", "close_to_low"))
    return rounded(evaluate.orthogonal_ic_one(long, _pool(s, d), "reversal_1d"))


def q_orth_ic_full_pool(s, d):
    return rounded(evaluate.orthogonal_daily_ic(_long(s, d), _pool(s, d), list(kline.POOL)))


def q_weights(s, d):
    return rounded(portfolio.weights(_long(s, d, 1)))


def q_turnover(s, d):
    return rounded(portfolio.turnover(portfolio.weights(_long(s, d, 1))))


def q_benchmark(s, d):
    return rounded(portfolio.benchmark(_long(s, d, 1)))


CUMULATIVE = ("cumulative_long_return", "cumulative_spread_return", "cumulative_benchmark_return", "cumulative_long_excess_return")
PRODUCTS = ("total_return", "max_drawdown", "calmar", "excess_total_return", "excess_max_drawdown", "long_total_return", "benchmark_total_return", "long_excess_total_return")


def q_backtest_returns(s, d):
    return rounded(compounded(portfolio.returns(_long(s, d, 1)), *CUMULATIVE))


def q_drawdown(s, d):
    return rounded(compounded(portfolio.drawdowns(portfolio.returns(_long(s, d, 1)), "long_excess_return"), "equity", "drawdown"))


def q_backtest_metrics(s, d):
    return rounded(compounded(portfolio.metrics(portfolio.returns(_long(s, d, 1))), *PRODUCTS), 5)


def q_factor_profile(s, d):
    return rounded(evaluate.profile(_long(s, d)))


def q_discovery(s, d):
    return rounded(evaluate.discovery_report(_long(s, d)))


def q_leaderboard(s, d):
    return rounded(portfolio.leaderboard(_long(s, d, 1), _long(s, d)), 5)


def q_diagnostics(s, d):
    return rounded(portfolio.diagnostics(_long(s, d, 1), _long(s, d)), 5)


def _verdict_inputs(s, d):
    long = _long(s, d)
    return long, portfolio.metrics(portfolio.returns(_long(s, d, 1))), evaluate.orthogonal_daily_ic(long, _pool(s, d), list(kline.POOL))


def q_verdict(s, d):
    return rounded(evaluate.verdict(*_verdict_inputs(s, d)), 5)


def q_validation(s, d):
    return rounded(evaluate.validation_report(*_verdict_inputs(s, d)), 5)


def q_kline_states(s, d):
    return kline.add_states(_bars(s, d)).select("ticker", "date", *[f"kline_{k}_state" for k in kline.STATES], "kline_token")


def q_kline_top_tokens(s, d):
    return kline.top_tokens(kline.add_states(_bars(s, d)))


def q_kline_sequences(s, d):
    out = kline.add_sequence_factors(_bars(s, d), (20, 60))
    return rounded(out.select("ticker", "date", *kline.sequence_columns((20, 60))))


def q_kline_event_share(s, d):
    states = kline.add_states(_bars(s, d))
    events = {k: v for k, v in kline.pattern_events(states).items() if k in {"return_up", "up_to_down", "return_up_volume_normal"}}
    out, names = kline.event_shares(states, events, (20,))
    return rounded(out.select("ticker", "date", *names))


def q_kline_discovery(s, d):
    return rounded(kline.discovery(_bars(s, d), _pool(s, d), windows=(20,), most_tokens=4), 5)


def q_latent_observations(s, d):
    return rounded(latent.add_observations(_bars(s, d)).select("ticker", "date", *latent.OBSERVATIONS))


def q_latent_states(s, d):
    out = latent.add_states(_bars(s, d))
    return rounded(out.select("ticker", "date", *[f"latent_{k}_prob" for k in latent.PROTOTYPES], "latent_dominant_state", "latent_state_confidence"))


def _life(s, d):
    return orderflow.lifecycle(A.l3_orders(s, d), A.l3_trades(s, d))


def _minutes(s, d):
    trades = A.l3_trades(s, d)
    return orderflow.minute_features(_life(s, d), trades, A.l3_quotes(s, d))


def q_l3_lifecycle(s, d):
    return rounded(_life(s, d).select("wind_code", "date", "ex_order_id", "side", "session", "price_scaled", "submitted_volume", "filled_volume", "canceled_volume", "aggressor_filled_volume", "passive_filled_volume", "filled_event_count", "canceled_event_count", "remaining_volume", "fill_ratio", "cancel_ratio", "aggressor_fill_ratio", "first_event_time_ms", "last_event_time_ms", "lifetime_ms", "observed_lifetime_lower_bound_ms", "terminal_state"))


def q_l3_terminal_states(s, d):
    return _life(s, d).groupBy("terminal_state").agg(F.count("*").alias("orders"))


def q_l3_quality(s, d):
    return rounded(orderflow.quality(A.l3_orders(s, d), A.l3_trades(s, d), _life(s, d)))


def q_l3_quote_recon(s, d):
    return rounded(orderflow.quote_reconciliation(A.l3_trades(s, d), A.l3_quotes(s, d)))


def q_l3_coverage(s, d):
    return rounded(orderflow.coverage(A.l3_orders(s, d), A.l3_trades(s, d)))


def q_l3_aggressor(s, d):
    fills = orderflow.aggressors(A.l3_trades(s, d), _life(s, d))
    return fills.groupBy("aggressor_side_source", "aggressor_side").agg(F.count("*").alias("fills"), F.sum("volume").alias("volume"))


def q_l3_minute(s, d):
    # a price with a 5 as its seventh digit is rounded alike by both engines
    return rounded(_minutes(s, d).withColumn("trade_vwap_scaled", F.col("trade_vwap_scaled") * (1 + 1e-11)))


def q_l3_minute_quality(s, d):
    return rounded(orderflow.minute_quality(_life(s, d), A.l3_trades(s, d), _minutes(s, d), A.l3_quotes(s, d)))


def q_l3_forward_returns(s, d):
    out = orderflow.forward_returns(_minutes(s, d).where("quote_ticks > 0"))
    return rounded(out.select("wind_code", "date", "minute", "future_return_1m", "future_return_3m", "future_return_5m"))


def _stated(s, d):
    out = orderflow.forward_returns(_minutes(s, d).where("quote_ticks > 0"), (1, 3, 5))
    return out.withColumn("hmm_state", F.col("trade_count").cast("int") % 3)


def q_l3_state_screen(s, d):
    return rounded(orderflow.state_screen(_stated(s, d))[0], 4)


def q_l3_state_spread(s, d):
    return rounded(orderflow.state_screen(_stated(s, d))[2], 4)


def q_l3_run_lengths(s, d):
    return orderflow.run_lengths(_stated(s, d)).select("wind_code", "date", "run", "hmm_state", "length")


def q_l3_cluster_share(s, d):
    return rounded(orderflow.shares(_stated(s, d).withColumnRenamed("hmm_state", "cluster")))


def q_l3_standardize(s, d):
    from ..operators import regimes

    out = regimes.standardize(_minutes(s, d), list(regimes.FEATURES))
    return rounded(out.select("wind_code", "date", "minute", *[f"z_{c}" for c in regimes.FEATURES]), 5)


def q_l3_kmeans(s, d):
    from ..operators import regimes

    return rounded(regimes.cluster(_minutes(s, d)).diagnostics, 4)


def q_l3_hmm(s, d):
    from ..operators import regimes

    return rounded(regimes.hidden_states(_minutes(s, d)).diagnostics, 4)


def q_walk_forward_splits(s, d):
    from ..operators import learning

    return learning.splits_frame(_bars(s, d), train=100, test=20, embargo=5)


def q_training_frame(s, d):
    from ..operators import learning

    out = learning.training_frame(_factors(s, d), ["momentum_5d", "dollar_volume"], horizon=5, lag=1)
    return rounded(out.select("ticker", "date", "momentum_5d", "dollar_volume", "future_return_5d"))


def q_ml_predictions(s, d):
    from ..operators import learning

    panel = _factors(s, d)
    return rounded(learning.walk_forward(panel, ["momentum_5d", "volatility_21d", "close_to_low"], train=252, test=63, embargo=5, model="ridge").select("ticker", "date", "ml_prediction_5d"), 5)


def _shards(s, d):
    bars = _bars(s, d).select("ticker", "date", "close")
    old = bars.where(F.year("date") <= 1998)
    new = bars.where(F.year("date") >= 1998).withColumn("close", F.col("close") + 1)
    return old, new


def q_upsert_latest(s, d):
    old, new = _shards(s, d)
    return rounded(ingest.upsert(old, new, "1996-01-01", "2000-12-31"))


def q_missing_window(s, d):
    return ingest.missing_starts(_shards(s, d)[0], "1995-01-02", "1999-06-30")


def q_semi_join_hits(s, d):
    return rounded(orderflow.hit_rates(A.l3_orders(s, d), A.l3_trades(s, d)))


def q_set_overlap(s, d):
    old, new = (x.select("ticker").distinct() for x in (_shards(s, d)[0].where("ticker < 15"), _shards(s, d)[1].where("ticker > 8")))
    sides = {"common": old.intersect(new), "old_only": old.exceptAll(new), "new_only": new.exceptAll(old)}
    out = None
    for name, df in sides.items():
        one = df.select(F.lit(name).alias("side"), "ticker")
        out = one if out is None else out.unionByName(one)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("q_") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import oracle

    return oracle.sql()
