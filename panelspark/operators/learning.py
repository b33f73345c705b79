"""Walk-forward learning on factor panels."""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass
from datetime import date

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import delay, div, finite
from . import evaluate
from .labels import add_label

#: Names of models and what they mean here; ranking objectives are replaced by regression on transformed labels.
MODELS = {"rf": "random_forest", "random_forest": "random_forest", "ridge": "ridge", "linear": "ridge", "gbt": "gbt", "lgbm": "gbt", "lightgbm": "gbt", "lightgbm_ranker": "gbt", "lightgbm_xendcg_ranker": "gbt"}


@dataclass(frozen=True)
class Split:
    fold: int
    train_start: date
    train_end: date
    test_start: date
    test_end: date


def splits(dates: list[date], train: int = 252, test: int = 63, embargo: int = 5, step: int | None = None) -> list[Split]:
    """Rolling folds over sorted dates: ``train`` dates, a gap of ``embargo``, ``test`` dates."""
    if min(train, test) < 1 or embargo < 0:
        raise ValueError("sizes must be positive")
    dates = sorted(set(dates))
    out, at = [], 0
    while at + train + embargo + test <= len(dates):
        out.append(Split(len(out), dates[at], dates[at + train - 1], dates[at + train + embargo], dates[at + train + embargo + test - 1]))
        at += step or test
    return out


def _dates(df: DataFrame) -> list[date]:
    # one row for each trading date
    return [r.date for r in df.select("date").where("date is not null").distinct().collect()]


def splits_frame(df: DataFrame, train: int = 252, test: int = 63, embargo: int = 5) -> DataFrame:
    rows = [(s.fold, s.train_start, s.train_end, s.test_start, s.test_end) for s in splits(_dates(df), train, test, embargo)]
    return df.sparkSession.createDataFrame(rows, "fold int, train_start date, train_end date, test_start date, test_end date")


def training_frame(panel: DataFrame, features: list[str], horizon: int = 5, lag: int = 1, transform: str = "return", quantiles: int = 5) -> DataFrame:
    """Features of ``lag`` rows before and a label; rows without a label are dropped."""
    name = f"future_return_{horizon}d" + ("" if transform == "return" else f"_{transform}")
    out = add_label(panel, horizon, transform, quantiles, name)
    if transform != "return":
        out = add_label(out, horizon, "return", quantiles, f"future_return_{horizon}d")
    out = out.withColumns({f: finite(delay(f, lag)) if lag else finite(f) for f in features})
    return out.where(F.col(name).isNotNull())


def pipeline(features: list[str], label: str, model: str = "random_forest", seed: int = 42, **parameters) -> Pipeline:
    """Median for nulls, then a model; the linear one is scaled."""
    kind = MODELS.get(model.strip().lower())
    if kind is None:
        raise ValueError(f"Unknown model: {model}")
    filled = [f"__{f}" for f in features]
    stages = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__x")]
    last = {"featuresCol": "__x", "labelCol": label, "predictionCol": "prediction"}
    if kind == "ridge":
        stages += [StandardScaler(inputCol="__x", outputCol="__z", withMean=True), LinearRegression(**{**last, "featuresCol": "__z", "regParam": 0.1, "elasticNetParam": 0.0, **parameters})]
    elif kind == "gbt":
        stages.append(GBTRegressor(**{**last, "maxIter": 50, "stepSize": 0.05, "maxDepth": 4, "subsamplingRate": 0.8, "seed": seed, **parameters}))
    else:
        stages.append(RandomForestRegressor(**{**last, "numTrees": 300, "minInstancesPerNode": 20, "maxDepth": 8, "seed": seed, **parameters}))
    return Pipeline(stages=stages)


def prediction_metrics(predicted: DataFrame, label: str, raw: str) -> dict[str, float]:
    """MAE, R2, directional accuracy and rank correlations by date."""
    y, p = F.col(label), F.col("prediction")
    m = predicted.agg(F.avg(F.abs(y - p)), (1 - div(F.sum((y - p) ** 2), F.var_pop(y) * F.count(y))), F.avg((F.signum(raw) == F.signum(p)).cast("double"))).first()
    long = predicted.select(F.lit("prediction").alias("factor"), "date", "ticker", p.alias("value"), F.col(raw).alias("label"))
    ic = evaluate.ic_stats(evaluate.daily_ic(long)).first()
    ic = ic.asDict() if ic else {}
    values = {"mae": m[0], "r2": m[1], "directional_accuracy": m[2], **{k: ic.get(k) for k in ("mean_ic", "ic_ir", "positive_ic_rate")}}
    return {k: float(v) if v is not None and np.isfinite(v) else 0.0 for k, v in values.items()}


def walk_forward(panel: DataFrame, features: list[str], horizon: int = 5, train: int = 252, test: int = 63, embargo: int = 5, lag: int = 1, model: str = "random_forest", transform: str = "return", column: str | None = None, **parameters) -> DataFrame:
    """``panel`` with out-of-sample predictions; they are keyed by ticker and date, never by position."""
    column = column or f"ml_prediction_{horizon}d"
    label = f"future_return_{horizon}d" + ("" if transform == "return" else f"_{transform}")
    rows = training_frame(panel, features, horizon, lag, transform).select("ticker", "date", *features, label).persist()
    out = None
    for s in splits(_dates(rows), train, test, embargo):
        learnt = rows.where(F.col("date").between(F.lit(s.train_start), F.lit(s.train_end))).na.drop(how="all", subset=features)
        asked = rows.where(F.col("date").between(F.lit(s.test_start), F.lit(s.test_end)))
        fitted = pipeline(features, label, model, 42 + s.fold, **parameters).fit(learnt.withColumn(label, F.col(label).cast("double")))
        one = fitted.transform(asked).select("ticker", "date", F.col("prediction").alias(column))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("not enough dates for one fold")
    return panel.drop(column).join(out, ["ticker", "date"], "left")


def train_model(panel: DataFrame, features: list[str], path: str, horizon: int = 5, test_size: float = 0.25, model: str = "random_forest", transform: str = "return", **parameters) -> dict[str, float]:
    """Fits on the first dates, saves the fitted pipeline with its description, and measures it on the others."""
    raw = f"future_return_{horizon}d"
    label = raw + ("" if transform == "return" else f"_{transform}")
    rows = training_frame(panel, features, horizon, 1, transform).withColumn(label, F.col(label).cast("double"))
    dates = sorted(_dates(rows))
    cut = dates[int(len(dates) * (1 - test_size))]
    fitted = pipeline(features, label, model, **parameters).fit(rows.where(F.col("date") < F.lit(cut)))
    fitted.write().overwrite().save(path)
    note = json.dumps({"features": features, "label": label, "split_date": str(cut), "model": model}, sort_keys=True)
    panel.sparkSession.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/description")
    return prediction_metrics(fitted.transform(rows.where(F.col("date") >= F.lit(cut))), label, raw)


def grid(most: int = 24) -> list[dict]:
    """Evenly spaced settings of the boosted model."""
    axes = {"maxDepth": (3, 4, 5), "maxIter": (30, 60, 90), "stepSize": (0.03, 0.05, 0.1), "subsamplingRate": (0.7, 0.9), "minInstancesPerNode": (10, 30), "transform": ("return", "rank", "zscore", "quantile", "top_bottom")}
    every = [dict(zip(axes, v, strict=True)) for v in itertools.product(*axes.values())]
    return [every[i] for i in np.unique(np.linspace(0, len(every) - 1, min(most, len(every))).astype(int))]


def tune(panel: DataFrame, features: list[str], horizon: int = 5, train: int = 252, test: int = 63, embargo: int = 5, most: int = 24) -> DataFrame:
    """Score (mean IC + 0.25 IC IR) of each setting, best first."""
    raw = f"future_return_{horizon}d"
    tried = []
    for i, setting in enumerate(grid(most)):
        setting = dict(setting)
        transform = setting.pop("transform")
        made = walk_forward(panel, features, horizon, train, test, embargo, 1, "gbt", transform, "prediction", **setting)
        m = prediction_metrics(add_label(made, horizon, "return", name=raw).where(F.col("prediction").isNotNull() & F.col(raw).isNotNull()), raw, raw)
        tried.append((i, transform, json.dumps(setting, sort_keys=True), m["mean_ic"], m["ic_ir"], m["mean_ic"] + 0.25 * m["ic_ir"]))
    out = panel.sparkSession.createDataFrame(tried, "trial int, transform string, setting string, mean_ic double, ic_ir double, score double")
    return out.orderBy(F.col("score").desc(), "trial")
