import json

import pytest

from panelspark.operators import portfolio
from panelspark.sources import readers


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"tickers": [" aapl", "MSFT"], "start": "2024-01-01", "factors_path": "f.parquet", "timespan": "hour", "other": 1}))
    found = readers.load_config(f"{tmp_path}/c.json")
    assert found.tickers == ("AAPL", "MSFT") and found.factors_path == "f.parquet" and found.timespan == "hour"
    assert found.multiplier == 1 and found.request_pause_seconds == 13 and found.extra == {"other": 1}


def test_reports_are_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    for path in (f"{tmp_path}/x.csv", f"{tmp_path}/x.parquet"):
        readers.write_report(df, path)
        readers.write_report(df, path)
        assert sorted(map(tuple, readers.read_table(spark, path).collect())) == [(1, "a"), (2, None)]
    assert readers.read_optional(spark, f"{tmp_path}/none.csv") is None


def test_metrics_equal_pandas(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    rows = []
    for factor in "ab":
        for i in range(40):
            x = rng.normal(0, 0.02, 3).tolist()
            rows.append((factor, i, x[0], x[1], None if i == 7 else x[2], 0.1, 0.001))
    pdf = pd.DataFrame(rows, columns=["factor", "date", "long_return", "spread_return", "benchmark_return", "turnover", "cost"])
    pdf["long_excess_return"] = pdf["long_return"] - pdf["benchmark_return"]
    df = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in pdf.astype({"date": object}).itertuples(index=False)], "factor string, date int, long_return double, spread_return double, benchmark_return double, turnover double, cost double, long_excess_return double")
    got = {r.factor: r for r in portfolio.metrics(df).collect()}
    for factor, g in pdf.groupby("factor"):
        r, x = g["spread_return"], (g["long_return"] - g["benchmark_return"]).dropna()
        told = got[factor]

        def dd(s):
            e = (1 + s).cumprod()
            return (e / e.cummax() - 1).min()

        both = g.dropna(subset=["benchmark_return"])
        want = {
            "periods": 40, "total_return": (1 + r).prod() - 1, "annualized_return": r.mean() * 252, "annualized_volatility": r.std() * 252**0.5, "hit_rate": (r > 0).mean(),
            "max_drawdown": dd(r), "calmar": r.mean() * 252 / abs(dd(r)), "information_ratio": r.mean() / r.std() * 252**0.5, "excess_total_return": (1 + x).prod() - 1, "excess_max_drawdown": dd(x),
            "excess_information_ratio": x.mean() / x.std() * 252**0.5, "benchmark_beta": both["long_return"].cov(both["benchmark_return"]) / both["benchmark_return"].var(),
            "benchmark_correlation": both["long_return"].corr(both["benchmark_return"]), "benchmark_total_return": (1 + both["benchmark_return"]).prod() - 1, "average_turnover": 0.1,
        }
        for name, value in want.items():
            assert told[name] == pytest.approx(value), name
