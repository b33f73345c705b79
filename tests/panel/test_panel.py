import numpy as np
import pandas as pd
import pytest

from panelspark.functions import expr as E
from panelspark.operators import evaluate, factors, ingest, labels, latent, learning, portfolio


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(1)
    rows = []
    for t in "abcdefg":
        price = 100.0
        for d in pd.bdate_range("2020-01-01", periods=90):
            price *= 1 + rng.normal() * 0.02
            high, low = price * 1.01, price * 0.99
            rows.append((t, d.date(), price * (1 + rng.normal() * 0.003), high, low, price, float(rng.integers(100, 999)), price * 1.001))
    pdf = pd.DataFrame(rows, columns=list(factors.BAR_COLUMNS))
    return pdf, spark.createDataFrame(pdf)


def test_rolling_operators_equal_pandas(panel):
    pdf, bars = panel
    got = bars.select("ticker", "date", E.rolling_mean("close", 5).alias("m"), E.rolling_std("close", 5).alias("s"), E.ts_rank("close", 9).alias("r"), E.cs_rank("close").alias("c"), E.cs_zscore("close").alias("z"), E.decay_linear("close", 4).alias("w")).toPandas().sort_values(["ticker", "date"])
    by = pdf.groupby("ticker")["close"]
    want = {
        "m": by.rolling(5).mean().to_numpy(),
        "s": by.rolling(5).std().to_numpy(),
        "r": by.rolling(9).rank(pct=True).to_numpy(),
        "w": by.rolling(4).apply(lambda x: (x * [1, 2, 3, 4]).sum() / 10, raw=True).to_numpy(),
        "c": pdf.groupby("date")["close"].rank(pct=True).to_numpy(),
        "z": pdf.groupby("date")["close"].transform(lambda x: (x - x.mean()) / x.std()).to_numpy(),
    }
    for k, v in want.items():
        np.testing.assert_allclose(got[k].to_numpy(float), v, rtol=1e-9, atol=1e-12, equal_nan=True)


def test_all_factors_exist_and_lookbacks_hold(panel):
    pdf, bars = panel
    out = factors.add_factors(bars).toPandas().sort_values(["ticker", "date"])
    assert set(factors.FACTORS) <= set(out.columns) and len(out) == len(pdf)
    assert out.groupby("ticker")["momentum_63d"].apply(lambda x: x.notna().sum()).eq(27).all()
    with pytest.raises(ValueError, match="vwap"):
        factors.add_factors(bars.drop("vwap"))


def test_buckets_are_linear_quantiles_of_ranks(spark):
    df = spark.createDataFrame([("d", f"t{i}", float(i)) for i in range(7)], "date string, ticker string, x double")
    got = [r.b for r in df.select("ticker", E.bucket("x", 5, "date").alias("b")).orderBy("ticker").collect()]
    assert got == pd.qcut(pd.Series(range(1, 8)), 5, labels=False).tolist() == [0, 0, 1, 2, 3, 4, 4]


def test_ic_and_portfolio_of_a_perfect_factor(panel):
    _, bars = panel
    rows = labels.add_forward_return(bars, 1, "label").selectExpr("ticker", "date", "label", "label AS perfect", "-label AS inverse")
    long = factors.to_long(rows, ["perfect", "inverse"], ["label"])
    stats = {r.factor: r for r in evaluate.ic_report(long).collect()}
    assert stats["perfect"].mean_ic == pytest.approx(1) and stats["inverse"].mean_ic == pytest.approx(-1) and stats["perfect"].days == 89
    daily = portfolio.returns(long)
    metrics = {r.factor: r for r in portfolio.metrics(daily).collect()}
    assert metrics["perfect"].total_return > 0 > metrics["inverse"].total_return and metrics["inverse"].max_drawdown < 0
    assert portfolio.turnover(portfolio.weights(long)).where("factor = 'perfect'").orderBy("date").first().turnover == 1.0
    codes = {r.factor: r for r in portfolio.diagnostics(long, long, min_days=10).collect()}
    assert codes["inverse"].status == "review" and "NEGATIVE_PORTFOLIO" in codes["inverse"].error_codes


def test_orthogonal_ic_vanishes_for_a_pool_combination(panel):
    _, bars = panel
    base = factors.add_factors(bars).select("ticker", "date", "close", "momentum_5d", "reversal_1d")
    rows = labels.add_forward_return(base, 5, "label").selectExpr("*", "2 * momentum_5d - 1.5 * reversal_1d AS mixed")
    got = evaluate.orthogonal_daily_ic(factors.to_long(rows, ["mixed"], ["label"]), rows, ["momentum_5d", "reversal_1d"])
    assert got.count() == 0


def test_latent_probabilities_sum_to_one(panel):
    _, bars = panel
    out = latent.add_states(bars).toPandas()
    assert np.allclose(out[[f"latent_{k}_prob" for k in latent.PROTOTYPES]].sum(axis=1), 1)
    with pytest.raises(ValueError):
        latent.add_states(bars, persistence=1.0)


def test_walk_forward_splits_keep_the_embargo():
    dates = [d.date() for d in pd.bdate_range("2020-01-01", periods=30)]
    for s in learning.splits(dates, 10, 5, 2):
        assert dates.index(s.test_start) - dates.index(s.train_end) == 3


def test_upsert_prefers_new_rows(spark):
    old = spark.sql("SELECT 'a' ticker, DATE'2020-01-01' date, 1D close UNION ALL SELECT 'a', DATE'2020-01-02', 2D")
    new = spark.sql("SELECT 'a' ticker, DATE'2020-01-02' date, 9D close UNION ALL SELECT 'a', DATE'2021-01-01', 3D")
    assert sorted(r.close for r in ingest.upsert(old, new, "2020-01-01", "2020-12-31").collect()) == [1.0, 9.0]
