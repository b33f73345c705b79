"""Command line: ``python -m panelspark.cli COMMAND --bars PATH --out PATH ...``.

Every command reads Parquet, runs one engine call and writes its result.  The download commands of a data vendor are
not here: bars are read from files that another job fetched.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reports
from .operators import evaluate, factors, ingest, kline, labels, latent, learning, orderflow, portfolio, regimes
from .sources import readers


def _session() -> SparkSession:
    return SparkSession.builder.appName("panelspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _long(panel: DataFrame, names: list[str], horizon: int) -> DataFrame:
    return factors.to_long(labels.add_forward_return(panel, horizon, "label"), names, ["label"])


class Run:
    """What a command has at hand; tables are read when they are asked for."""

    def __init__(self, a: argparse.Namespace):
        self.a, self.spark = a, _session()
        self.windows = tuple(int(x) for x in a.windows.split(","))
        self.horizons = tuple(int(x) for x in a.horizons.split(","))
        self.k = tuple(int(x) for x in a.k_values.split(","))
        self.sessions = a.sessions.split(",") if a.sessions else None
        self.days = a.dates.split(",") if a.dates else None
        self.codes = a.wind_codes.split(",") if a.wind_codes else None

    def bars(self) -> DataFrame:
        return readers.read_table(self.spark, self.a.bars)

    def panel(self) -> DataFrame:
        return readers.read_table(self.spark, self.a.factors) if self.a.factors else factors.add_factors(self.bars())

    def names(self, panel: DataFrame) -> list[str]:
        return self.a.factor_columns.split(",") if self.a.factor_columns else [s.name for s in factors.REGISTRY if s.name in panel.columns]

    def stream(self, name: str) -> DataFrame:
        return readers.read_stream(self.spark, self.a.raw_dir, name, self.days, self.codes)

    def life(self) -> DataFrame:
        return orderflow.lifecycle(self.stream("orders"), self.stream("trades"))

    def minutes(self) -> DataFrame:
        return orderflow.minute_features(self.life(), self.stream("trades"), self.stream("quotes"))

    def evaluated(self) -> tuple[DataFrame, DataFrame]:
        panel = self.panel()
        names = self.names(panel)
        return _long(panel, names, self.a.backtest_horizon), _long(panel, names, self.a.horizon)

    def save(self, df: DataFrame, suffix: str = "") -> None:
        readers.write_report(df, self.a.out + suffix)


def cmd_fetch(r: Run) -> None:
    r.save(ingest.decode_bars(r.spark.read.json(r.a.bars)))


def cmd_factors(r: Run) -> None:
    out = factors.add_factors(r.bars())
    r.save(factors.add_cross_sections(out, factors.FACTORS))


def cmd_kline_factors(r: Run) -> None:
    out = kline.add_sequence_factors(r.bars(), r.windows)
    r.save(factors.add_cross_sections(out, kline.sequence_columns(r.windows)))


def cmd_discover_factors(r: Run) -> None:
    panel = r.panel()
    r.save(evaluate.discovery_report(_long(panel, r.names(panel), r.a.horizon)))


def cmd_discover_kline_patterns(r: Run) -> None:
    r.save(kline.discovery(r.bars(), r.panel(), r.windows, r.a.horizon, r.a.max_token_patterns, r.a.min_coverage))


def cmd_validate_experiment(r: Run) -> None:
    base, trial = r.panel(), readers.read_table(r.spark, r.a.experiment)
    prefixes = tuple(r.a.factor_prefixes.split(","))
    found = [f for f, t in trial.dtypes if f.startswith(prefixes) and t in {"double", "float", "int", "bigint"} and not f.endswith(("_rank", "_zscore"))]
    names = r.a.factor_columns.split(",") if r.a.factor_columns else found
    if missing := sorted(set(names) - set(trial.columns)):
        raise ValueError(f"Missing required columns: {missing}")
    pool = r.a.orthogonal_pool.split(",") if r.a.orthogonal_pool else [s.name for s in factors.REGISTRY if s.stage and s.name in base.columns and s.name not in names]
    panel = trial.select("ticker", "date", *names).join(base.select("ticker", "date", "close", *pool), ["ticker", "date"], "left")
    long = _long(panel, names, r.a.horizon)
    metrics = portfolio.metrics(portfolio.returns(_long(panel, names, r.a.backtest_horizon), r.a.quantiles, r.a.cost_bps))
    r.save(evaluate.validation_report(long, metrics, evaluate.orthogonal_daily_ic(long, panel, pool), r.a.min_coverage))


def cmd_latent_participants(r: Run) -> None:
    out = latent.add_states(r.bars(), r.a.lookback, r.a.persistence, r.a.emission_scale)
    r.save(factors.add_cross_sections(out, [f"alpha_latent_{k}_prob" for k in latent.PROTOTYPES]))


def cmd_a_share_l3_lifecycle(r: Run) -> None:
    life = r.life()
    r.save(life)
    r.save(orderflow.quality(r.stream("orders"), r.stream("trades"), life), ".quality.csv")


def cmd_a_share_l3_coverage(r: Run) -> None:
    r.save(orderflow.coverage(r.stream("orders"), r.stream("trades")))


def cmd_a_share_l3_minute_features(r: Run) -> None:
    r.save(r.minutes())


def cmd_a_share_l3_quality_gates(r: Run) -> None:
    r.save(orderflow.minute_quality(r.life(), r.stream("trades"), r.minutes(), r.stream("quotes")))


def cmd_a_share_l3_static_clusters(r: Run) -> None:
    out = regimes.cluster(r.minutes(), k_values=r.k, sessions=r.sessions, clip=r.a.clip_quantile, seed=r.a.random_state)
    r.save(out.labels, "/labels")
    for name in ("diagnostics", "profile", "shares"):
        r.save(getattr(out, name), f"/{name}.csv")


def cmd_a_share_l3_hmm_states(r: Run) -> None:
    out = regimes.hidden_states(r.minutes(), k_values=r.k, sessions=r.sessions, clip=r.a.clip_quantile, rounds=r.a.max_iter, tolerance=r.a.tol, seed=r.a.random_state)
    r.save(out.labels, "/labels")
    for name in ("diagnostics", "profile", "transitions"):
        r.save(getattr(out, name), f"/{name}.csv")


def cmd_a_share_l3_hmm_signal_screen(r: Run) -> None:
    rows = orderflow.forward_returns(readers.read_table(r.spark, r.a.labels), r.horizons)
    for name, df in zip(("summary", "cells", "spread"), orderflow.state_screen(rows, r.a.state_col, r.horizons), strict=True):
        r.save(df, f"/{name}.csv")


def cmd_train(r: Run) -> None:
    panel = r.panel()
    names = [n for n in r.names(panel) if n != "ml_prediction_5d"]
    print(json.dumps(learning.train_model(panel, names, r.a.out, r.a.horizon, model=r.a.model, transform=r.a.label_transform), sort_keys=True))


def cmd_ml_alpha(r: Run) -> None:
    panel = r.panel()
    names = [n for n in r.names(panel) if n != "ml_prediction_5d"]
    r.save(learning.walk_forward(panel, names, r.a.horizon, r.a.train_size, r.a.test_size, r.a.embargo, model=r.a.model, transform=r.a.label_transform))


def cmd_tune_lightgbm(r: Run) -> None:
    panel = r.panel()
    r.save(learning.tune(panel, [n for n in r.names(panel) if n != "ml_prediction_5d"], r.a.horizon, r.a.train_size, r.a.test_size, r.a.embargo, r.a.max_trials))


def cmd_report(r: Run) -> None:
    r.save(evaluate.ic_report(r.evaluated()[1]))


def cmd_charts(r: Run) -> None:
    long = r.evaluated()[1]
    ic = evaluate.ic_report(long).toPandas()
    quantiles = evaluate.quantile_returns(long).groupBy("factor", "quantile").agg(F.avg("mean_return").alias("mean_return")).orderBy("factor", "quantile").toPandas()
    reports.write(r.a.out, reports.page("Charts", {"IC": reports.bars_chart(ic, "factor", "mean_ic"), "Quantile returns": reports.table(quantiles, 200)}))


def cmd_html_report(r: Run) -> None:
    traded, judged = r.evaluated()
    board = portfolio.leaderboard(traded, judged).toPandas()
    verdicts = evaluate.verdict(judged, portfolio.metrics(portfolio.returns(traded))).toPandas()
    ic = evaluate.ic_report(judged).toPandas()
    reports.write(r.a.out, reports.page("Factor report", {"IC": reports.bars_chart(ic, "factor", "mean_ic") + reports.table(ic), "Leaderboard": reports.table(board, r.a.top_n), "Verdicts": reports.table(verdicts)}))


def cmd_l2_l3_report(r: Run) -> None:
    parts = {}
    for name in ("coverage", "quality", "diagnostics", "profile", "transitions"):
        df = readers.read_optional(r.spark, f"{r.a.report_dir}/{name}.csv")
        if df is not None:
            made = {"coverage": reports.coverage_summary, "quality": reports.quality_summary, "transitions": reports.likely_next}.get(name, lambda x: x)(df)
            parts[name] = reports.table(made.toPandas())
    reports.write(r.a.out, reports.page("Order-flow report", parts))


def cmd_methodology(r: Run) -> None:
    steps = "<ol><li>Bars or order streams are read as Parquet.</li><li>Factors are windows by ticker and cross sections by date.</li><li>Labels look forward only.</li><li>Rank correlations, quantile portfolios and five gates judge a factor.</li><li>Order flow becomes lifecycles, minutes, gates, clusters and regimes.</li></ol>"
    reports.write(r.a.out, reports.page("Methodology", {"Steps": steps, "Factors": reports.table(factors.registry_frame(r.spark).select("name", "category", "formula", "lookback").toPandas(), 100)}))


def cmd_backtest(r: Run) -> None:
    panel = r.panel()
    long = _long(panel, [r.a.factor], r.a.backtest_horizon)
    held = portfolio.weights(long, r.a.quantiles)
    r.save(portfolio.returns(long, r.a.quantiles, r.a.cost_bps, held), "/returns")
    r.save(held, "/weights")


def cmd_leaderboard(r: Run) -> None:
    r.save(portfolio.leaderboard(*r.evaluated(), r.a.quantiles, r.a.cost_bps))


def cmd_alpha_cluster(r: Run) -> None:
    r.save(portfolio.diagnostics(*r.evaluated(), r.a.quantiles, r.a.cost_bps))


def cmd_registry(r: Run) -> None:
    r.save(factors.registry_frame(r.spark, not r.a.include_disabled))


def cmd_run_experiment(r: Run) -> None:
    folder = readers.make_run_dir(r.a.name, r.a.out)
    traded, judged = r.evaluated()
    board = portfolio.leaderboard(traded, judged, r.a.quantiles, r.a.cost_bps)
    for name, df in (("alpha_registry", factors.registry_frame(r.spark)), ("ic_report", evaluate.ic_report(judged)), ("factor_leaderboard", board), ("diagnostics", portfolio.diagnostics(traded, judged, r.a.quantiles, r.a.cost_bps))):
        readers.write_report(df, f"{folder}/{name}.csv")
    best = board.first()
    readers.write_json(folder / "metrics.json", best.asDict() if best else {})


def cmd_pipeline(r: Run) -> None:
    out, r.a.out = r.a.out, r.a.out + "/factors"
    cmd_factors(r)
    r.a.factors, r.a.out = r.a.out, out + "/model"
    cmd_train(r)


COMMANDS = {k[4:].replace("_", "-"): f for k, f in list(globals().items()) if k.startswith("cmd_")}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="panelspark", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    for name in ("bars", "factors", "experiment", "labels", "raw-dir", "report-dir", "dates", "wind-codes", "factor", "factor-columns", "orthogonal-pool", "sessions"):
        p.add_argument(f"--{name}")
    p.add_argument("--out", default="out")
    p.add_argument("--name", default="run")
    p.add_argument("--model", default="random_forest")
    p.add_argument("--label-transform", default="return", choices=labels.TRANSFORMS)
    p.add_argument("--factor-prefixes", default="alpha_,ml_prediction")
    p.add_argument("--state-col", default="hmm_state")
    p.add_argument("--windows", default="20,60")
    p.add_argument("--horizons", default="1,3,5")
    p.add_argument("--k-values", default="2,3,4,5,6")
    p.add_argument("--include-disabled", action="store_true")
    for name, value in {"horizon": 5, "backtest-horizon": 1, "quantiles": 5, "lookback": 21, "max-token-patterns": 24, "train-size": 252, "test-size": 63, "embargo": 5, "max-trials": 24, "top-n": 20, "max-iter": 50, "random-state": 0}.items():
        p.add_argument(f"--{name}", type=int, default=value)
    for name, value in {"cost-bps": 5.0, "min-coverage": 0.2, "persistence": 0.86, "emission-scale": 1.25, "clip-quantile": 0.01, "tol": 1e-4}.items():
        p.add_argument(f"--{name}", type=float, default=value)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    COMMANDS[a.command](Run(a))


if __name__ == "__main__":
    main()
