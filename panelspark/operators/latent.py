"""Latent participant states: observations by window, probabilities by a forward filter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import change, clip, delay, div, rolling_mean, rolling_std

#: The states and their prototypes over the observations.
OBSERVATIONS = ("latent_return_z", "latent_gap_z", "latent_intraday_z", "latent_range_z", "latent_volume_z", "latent_close_location", "latent_trend_5d_z")
PROTOTYPES = {
    "accumulation": (0.45, 0.10, 0.85, 0.15, 1.10, 0.85, 0.45),
    "distribution": (-0.45, -0.10, -0.85, 0.20, 1.10, -0.85, -0.25),
    "forced_selling": (-1.25, -0.75, -0.85, 1.25, 1.60, -0.95, -0.85),
    "market_making_pressure": (0.00, 0.00, 0.00, 1.00, 0.80, 0.00, 0.00),
    "arbitrage_repair": (0.15, -0.90, 0.95, 0.75, 0.70, 0.70, 0.10),
    "noise": (0.00, 0.00, 0.00, -0.45, -0.45, 0.00, 0.00),
}


def add_observations(bars: DataFrame, lookback: int = 21) -> DataFrame:
    least = max(5, lookback // 3)

    def z(x: str) -> Column:
        value = div(F.col(x) - rolling_mean(x, lookback, least), F.nullif(rolling_std(x, lookback, least), F.lit(0.0)))
        return clip(value, -4.0, 4.0)

    raw = {
        "__return": change("close"),
        "__gap": div("open", delay("close")) - 1,
        "__intraday": div("close", "open") - 1,
        "__range": div(F.col("high") - F.col("low"), delay("close")),
        "__volume": F.log1p("volume"),
        "__trend": change("close", 5),
    }
    out = bars.withColumns(raw)
    location = clip(div(F.col("close") - F.col("low"), F.nullif(F.col("high") - F.col("low"), F.lit(0.0))), 0.0, 1.0) * 2 - 1
    made = dict(zip(OBSERVATIONS, [z("__return"), z("__gap"), z("__intraday"), z("__range"), z("__volume"), location, z("__trend")], strict=True))
    return out.withColumns(made).drop(*raw)


def filter_states(observed: np.ndarray, prototypes: np.ndarray, persistence: float, scale: float) -> np.ndarray:
    """Posterior of each row given it and the rows before; uniform before the first."""
    k = len(prototypes)
    moves = np.full((k, k), (1 - persistence) / (k - 1))
    np.fill_diagonal(moves, persistence)
    distance = ((prototypes[None, :, :] - np.nan_to_num(observed)[:, None, :]) ** 2).sum(axis=2)
    logits = -0.5 * distance / scale**2
    emission = np.exp(logits - logits.max(axis=1, keepdims=True))
    emission /= emission.sum(axis=1, keepdims=True)
    emission[np.isnan(observed).all(axis=1)] = 1 / k
    out, now = np.empty_like(emission), np.full(k, 1 / k)
    for i, e in enumerate(emission):
        now = (now @ moves) * e
        total = now.sum()
        now = now / total if total > 0 and np.isfinite(total) else np.full(k, 1 / k)
        out[i] = now
    return out


def add_states(bars: DataFrame, lookback: int = 21, persistence: float = 0.86, scale: float = 1.25) -> DataFrame:
    """Adds six probabilities, the dominant state, its probability and six alpha_latent_* copies.

    The filter is sequential: one Arrow group for each ticker, ordered by date.
    """
    if lookback < 5:
        raise ValueError("lookback must be at least 5")
    if not 0 <= persistence < 1:
        raise ValueError("persistence must be in [0, 1)")
    if scale <= 0:
        raise ValueError("scale must be positive")
    observed = add_observations(bars, lookback)
    prototypes = np.array(list(PROTOTYPES.values()))
    names = [f"latent_{k}_prob" for k in PROTOTYPES]

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date")
        made = filter_states(frame[list(OBSERVATIONS)].to_numpy(float), prototypes, persistence, scale)
        return frame.assign(**{n: made[:, i] for i, n in enumerate(names)})

    schema = type(observed.schema)(list(observed.schema.fields))
    for n in names:
        schema = schema.add(n, "double")
    out = observed.groupBy("ticker").applyInPandas(one, schema)
    best = F.greatest(*names)
    dominant = F.element_at(F.array(*map(F.lit, PROTOTYPES)), F.array_position(F.array(*names), best).cast("int"))
    return out.withColumns({"latent_dominant_state": dominant, "latent_state_confidence": best, **{f"alpha_{n}": F.col(n) for n in names}})
