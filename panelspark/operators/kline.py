"""Bar states, tokens, sequence factors and pattern discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import by_ticker, change, clip, delay, div, rolling, rolling_mean, rolling_std, rows
from . import evaluate

MISSING = "missing"
#: Right-closed edges and names of the states.
RETURN_EDGES, RETURN_STATES = (-0.02, -0.005, 0.005, 0.02), ("strong_down", "down", "flat", "up", "strong_up")
RANGE_EDGES, RANGE_STATES = (0.01, 0.02, 0.04), ("quiet", "normal", "wide", "shock")
VOLUME_EDGES, VOLUME_STATES = (-1.0, 1.0, 2.0), ("low", "normal", "high", "extreme")
LOCATION_EDGES, LOCATION_STATES = (0.25, 0.75), ("near_low", "middle", "near_high")
#: Verdicts on patterns, strongest first.
PATTERN_VERDICTS = ("强增量候选", "增量候选", "观察", "剔除")
WINDOWS = (20, 60)
POOL = ("reversal_1d", "momentum_5d", "volatility_21d")
STATES = {"return": RETURN_STATES, "range": RANGE_STATES, "volume": VOLUME_STATES, "close_location": LOCATION_STATES}


def state(x: Column, edges: tuple[float, ...], names: tuple[str, ...]) -> Column:
    """The name of the right-closed interval that holds ``x``; the word "missing" for null."""
    out = F.when(x.isNull(), MISSING)
    for edge, name in zip(edges, names, strict=False):
        out = out.when(x <= edge, name)
    return out.otherwise(names[-1])


def add_states(bars: DataFrame, volume_window: int = 21) -> DataFrame:
    """Adds kline_{return,range,volume,close_location}_state and kline_token."""
    volume_z = div(F.col("volume") - rolling_mean("volume", volume_window), F.nullif(rolling_std("volume", volume_window), F.lit(0.0)))
    out = bars.withColumns({"__r": F.round(change("close"), 10), "__s": F.round(div(F.col("high") - F.col("low"), delay("close")), 10), "__v": F.round(volume_z, 10), "__l": F.round(clip(div(F.col("close") - F.col("low"), F.nullif(F.col("high") - F.col("low"), F.lit(0.0))), 0.0, 1.0), 10)})
    made = {
        "kline_return_state": state(F.col("__r"), RETURN_EDGES, RETURN_STATES),
        "kline_range_state": state(F.col("__s"), RANGE_EDGES, RANGE_STATES),
        "kline_volume_state": state(F.col("__v"), VOLUME_EDGES, VOLUME_STATES),
        "kline_close_location_state": state(F.col("__l"), LOCATION_EDGES, LOCATION_STATES),
    }
    out = out.withColumns(made).drop("__r", "__s", "__v", "__l")
    return out.withColumn("kline_token", F.concat_ws("|", *made))


def sequence_columns(windows: tuple[int, ...] = WINDOWS) -> list[str]:
    return [f"alpha_kline_{k}_{w}d" for w in windows for k in ("state_entropy", "bull_volume_ngram", "reversal_transition", "path_similarity")]


def _entropy(seen: Column) -> Column:
    def step(total: Column, token: Column) -> Column:
        share = F.size(F.filter(seen, lambda x: x == token)) / F.size(seen)
        return total - share * F.ln(share)

    return F.aggregate(F.array_distinct(seen), F.lit(0.0), step)


def add_sequence_factors(bars: DataFrame, windows: tuple[int, ...] = WINDOWS, volume_window: int = 21) -> DataFrame:
    """Entropy of tokens, share of rising bars with volume, reversals and similarity of the path, for each window.

    All are null in the first w - 1 rows.  Tokens with a missing part count for neither entropy nor similarity.
    """
    windows = tuple(sorted(set(windows)))
    if not windows or windows[0] < 2:
        raise ValueError("windows must be 2 or more")
    out = bars if "kline_token" in bars.columns else add_states(bars, volume_window)
    token, ret = F.col("kline_token"), F.col("kline_return_state")
    out = out.withColumns(
        {
            "__clean": F.when(~token.contains(MISSING), token),
            "__bull": (ret.isin("up", "strong_up") & F.col("kline_volume_state").isin("high", "extreme")).cast("int"),
            "__turn": (ret.isin("up", "strong_up") & F.coalesce(delay(ret).isin("down", "strong_down"), F.lit(False))).cast("int"),
            "__row": F.row_number().over(by_ticker()),
        }
    )
    made: dict[str, Column] = {}
    for w in windows:
        seen = F.collect_list("__clean").over(rows(w))
        before = F.collect_list("__clean").over(by_ticker().rowsBetween(-(w - 1), -1))
        n = F.size(seen)

        entropy = _entropy(seen)
        full = F.col("__row") >= w
        made[f"alpha_kline_state_entropy_{w}d"] = F.when(full & (n >= 2), div(entropy, F.ln(F.least(n, F.lit(240)))))
        made[f"alpha_kline_bull_volume_ngram_{w}d"] = F.when(full, F.avg("__bull").over(rows(w)))
        made[f"alpha_kline_reversal_transition_{w}d"] = F.when(full, F.sum("__turn").over(rows(w - 1)) / (w - 1))
        made[f"alpha_kline_path_similarity_{w}d"] = F.when(full & F.col("__clean").isNotNull(), div(F.size(F.filter(before, lambda x: x == F.col("__clean"))), F.size(before)))
    return out.withColumns(made).drop("__clean", "__bull", "__turn", "__row")


def top_tokens(tokens: DataFrame, most: int = 24) -> DataFrame:
    """The most frequent whole tokens; ties in alphabetical order."""
    rows_ = tokens.where(~F.col("kline_token").contains(MISSING)).groupBy("kline_token").agg(F.count("*").alias("n"))
    return rows_.orderBy(F.col("n").desc(), "kline_token").limit(most)


def pattern_events(states: DataFrame, tokens: list[str] = ()) -> dict[str, Column]:
    """Named events on a row: 16 states, 25 return transitions, 63 pairs of states and the tokens given.

    An event is null where a state it needs is missing, or the row before for a transition.
    """
    names = {k: f"kline_{k}_state" for k in STATES}
    out: dict[str, Column] = {}

    def event(valid: Column, hit: Column) -> Column:
        return F.when(valid, hit.cast("double"))

    for k, values in STATES.items():
        for v in values:
            out[f"{k}_{v}"] = event(F.col(names[k]) != MISSING, F.col(names[k]) == v)
    r, before = F.col(names["return"]), delay(names["return"])
    for a in RETURN_STATES:
        for b in RETURN_STATES:
            out[f"{a}_to_{b}"] = event((r != MISSING) & before.isNotNull() & (before != MISSING), (before == a) & (r == b))
    for x, y in (("return", "volume"), ("return", "close_location"), ("range", "close_location"), ("range", "volume")):
        for a in STATES[x]:
            for b in STATES[y]:
                p, q = F.col(names[x]), F.col(names[y])
                out[f"{x}_{a}_{y}_{b}"] = event((p != MISSING) & (q != MISSING), (p == a) & (q == b))
    for t in tokens:
        out["token_" + t.replace("|", "_")] = event(F.col("kline_token") != MISSING, F.col("kline_token") == t)
    return out


def event_shares(states: DataFrame, events: dict[str, Column], windows: tuple[int, ...] = WINDOWS) -> tuple[DataFrame, list[str]]:
    """Adds the rolling share of each event, over max(5, w // 2) rows that aren't null at least."""
    out = states.withColumns({f"__{k}": e for k, e in events.items()})
    made = {f"{k}_{w}": rolling(F.avg, f"__{k}", w, max(5, w // 2)) for k in events for w in windows}
    return out.withColumns(made).drop(*[f"__{k}" for k in events]), list(made)


def discovery(bars: DataFrame, pool: DataFrame, windows: tuple[int, ...] = WINDOWS, horizon: int = 5, most_tokens: int = 24, min_coverage: float = 0.35, pool_columns: tuple[str, ...] = POOL) -> DataFrame:
    """Scores of all pattern candidates: IC, IC orthogonal to the pool, and a verdict, best first."""
    from .labels import add_forward_return

    states = add_states(bars)
    tokens = [r.kline_token for r in top_tokens(states, most_tokens).collect()]
    labelled = add_forward_return(states, horizon, "label")
    shares, names = event_shares(labelled, pattern_events(states, tokens), windows)
    long = shares.unpivot(["ticker", "date", "label"], names, "factor", "value")
    base = evaluate.profile(long).where(F.col("coverage") >= min_coverage).select("factor", "coverage", "active_days", "median_daily_unique")
    orth = evaluate.ic_stats(evaluate.orthogonal_daily_ic(long, pool, list(pool_columns))).select("factor", F.col("mean_ic").alias("ic_orth"), F.col("ic_ir").alias("orth_ir"))
    out = base.join(evaluate.ic_stats(evaluate.daily_ic(long)), "factor", "left").join(orth, "factor", "left")
    zero = F.lit(0.0)
    rate = evaluate.directional_rate(F.col("mean_ic"), F.col("positive_ic_rate"))
    out = out.withColumn("directional_rate", rate)
    score = F.abs(F.coalesce("ic_orth", zero)) + 0.05 * F.abs(F.coalesce("orth_ir", zero)) + 0.25 * F.abs(F.coalesce("mean_ic", zero)) + 0.05 * F.greatest(F.coalesce("directional_rate", F.lit(0.5)) - 0.5, zero)
    strength, good = F.abs(F.coalesce("ic_orth", zero)), F.coalesce("directional_rate", zero)
    verdict = (
        F.when((strength >= 0.015) & (F.abs("orth_ir") > 0) & (good >= 0.55) & (F.col("coverage") >= 0.5), PATTERN_VERDICTS[0])
        .when((strength >= 0.01) & (F.abs("orth_ir") > 0) & (good >= 0.52) & (F.col("coverage") >= 0.35), PATTERN_VERDICTS[1])
        .when(strength >= 0.005, PATTERN_VERDICTS[2])
        .otherwise(PATTERN_VERDICTS[3])
    )
    return out.withColumn("discovery_score", score).withColumn("verdict", verdict).orderBy(F.col("discovery_score").desc_nulls_last(), "factor")
