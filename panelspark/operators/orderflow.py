"""Order flow: order lifecycles, minute features, quality gates, coverage, forward returns and state screens.

All functions take every stock and day at once, keyed by (wind_code, date); nothing loops over stock-days.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import div, div0

KEYS = ["wind_code", "date"]
MINUTE = ["wind_code", "date", "minute"]
TOLERANCE = 1e-9
#: Terminal states in the order in which they are tried (the last is the default), and session bounds.
TERMINAL_STATES = ("OVER_ACCOUNTED", "FULLY_FILLED", "FULLY_CANCELED", "PARTIAL_FILLED_CANCELED", "PARTIAL_OPEN", "UNFILLED_OPEN")
OPENING_MS, CLOSING_MS = 34_200_000, 53_820_000


def clean_code(x: str | Column) -> Column:
    """Trimmed upper case without NUL characters; null for nothing."""
    x = F.col(x) if isinstance(x, str) else x
    return F.nullif(F.upper(F.trim(F.regexp_replace(x.cast("string"), "\\x00", ""))), F.lit(""))


def to_ms(time: str | Column) -> Column:
    """HHMMSSmmm as an integer to milliseconds since midnight; null if it isn't a number."""
    t = (F.col(time) if isinstance(time, str) else time).try_cast("long")
    hour, minute, second = F.floor(t / 10_000_000), F.floor(t / 100_000) % 100, F.floor(t / 1000) % 100
    return (hour * 3_600_000 + minute * 60_000 + second * 1000 + t % 1000).cast("long")


def with_clock(df: DataFrame, time: str = "time") -> DataFrame:
    """Adds time_ms, minute and session."""
    out = df.withColumn("time_ms", to_ms(time))
    session = F.when(F.col("time_ms") < OPENING_MS, "opening_auction").when(F.col("time_ms") >= CLOSING_MS, "closing_auction").otherwise("continuous")
    return out.withColumn("minute", F.floor(F.col("time_ms") / 60_000).cast("int")).withColumn("session", session)


def session_of(minute: Column) -> Column:
    return F.when(minute < 570, "opening_auction").when(minute >= 897, "closing_auction").otherwise("continuous")


def references(trades: DataFrame) -> DataFrame:
    """One row for each order that a trade names: (..., ex_order_id, side)."""
    sides = F.array(F.struct(F.col("ask_order_id").cast("long").alias("ex_order_id"), F.lit("S").alias("side")), F.struct(F.col("bid_order_id").cast("long").alias("ex_order_id"), F.lit("B").alias("side")))
    out = trades.withColumn("__r", F.explode(sides)).withColumn("ex_order_id", F.col("__r.ex_order_id")).withColumn("ref_side", F.col("__r.side")).drop("__r")
    return out.where(F.col("ex_order_id").isNotNull() & (F.col("ex_order_id") != 0))


def _events(trades: DataFrame, cancel_code: str) -> DataFrame:
    return with_clock(trades).withColumn("is_cancel", F.coalesce(clean_code("trade_code") == cancel_code, F.lit(False))).withColumn("flag", clean_code("bs_flag"))


def lifecycle(orders: DataFrame, trades: DataFrame, price_scale: float = 10_000.0, cancel_code: str = "C") -> DataFrame:
    """One row for each order: what was filled and cancelled, when, by whom, and how it ended.

    A fill without a flag counts as passive for both orders.
    """
    base = with_clock(orders).withColumns({"ex_order_id": F.col("ex_order_id").cast("long"), "side": clean_code("order_code"), "price_raw": F.col("price"), "price_scaled": F.col("price") / price_scale, "submitted_volume": F.col("volume").cast("double")}).drop("volume")
    refs = references(_events(trades, cancel_code))
    fill, cancel = ~F.col("is_cancel"), F.col("is_cancel")
    aggressor = fill & F.coalesce(F.col("ref_side") == F.col("flag"), F.lit(False))
    v, t = F.col("volume").cast("double"), F.col("time_ms")
    sums = refs.groupBy(*KEYS, "ex_order_id").agg(
        F.sum(F.when(fill, v)).alias("filled_volume"),
        F.count_if(fill).alias("filled_event_count"),
        F.min(F.when(fill, t)).alias("first_filled_time_ms"),
        F.max(F.when(fill, t)).alias("last_filled_time_ms"),
        F.sum(F.when(aggressor, v)).alias("aggressor_filled_volume"),
        F.sum(F.when(fill & ~aggressor, v)).alias("passive_filled_volume"),
        F.sum(F.when(cancel, v)).alias("canceled_volume"),
        F.count_if(cancel).alias("canceled_event_count"),
        F.min(F.when(cancel, t)).alias("first_canceled_time_ms"),
        F.max(F.when(cancel, t)).alias("last_canceled_time_ms"),
    )
    out = base.join(sums, [*KEYS, "ex_order_id"], "left")
    out = out.fillna(0.0, ["filled_volume", "aggressor_filled_volume", "passive_filled_volume", "canceled_volume"]).fillna(0, ["filled_event_count", "canceled_event_count"])
    out = out.withColumn("accounted_volume", F.col("filled_volume") + F.col("canceled_volume"))
    out = out.withColumn("remaining_volume", F.col("submitted_volume") - F.col("accounted_volume"))
    left, filled, gone = F.col("remaining_volume"), F.col("filled_volume"), F.col("canceled_volume")
    over, full, void, part, open_, none = TERMINAL_STATES
    state = (
        F.when(left < -TOLERANCE, over)
        .when((F.abs(left) <= TOLERANCE) & (filled > 0) & (gone <= TOLERANCE), full)
        .when((F.abs(left) <= TOLERANCE) & (gone > 0) & (filled <= TOLERANCE), void)
        .when((F.abs(left) <= TOLERANCE) & (filled > 0) & (gone > 0), part)
        .when((left > TOLERANCE) & (F.col("accounted_volume") > 0), open_)
        .otherwise(none)
    )
    out = out.withColumns(
        {
            "fill_ratio": div0("filled_volume", "submitted_volume"),
            "cancel_ratio": div0("canceled_volume", "submitted_volume"),
            "aggressor_fill_ratio": div0("aggressor_filled_volume", "filled_volume"),
            "first_event_time_ms": F.least("first_filled_time_ms", "first_canceled_time_ms"),
            "last_event_time_ms": F.greatest("last_filled_time_ms", "last_canceled_time_ms"),
            "is_terminal_observed": F.abs(left) <= TOLERANCE,
            "terminal_state": state,
        }
    )
    out = out.withColumn("terminal_time_ms", F.when(F.col("is_terminal_observed"), F.col("last_event_time_ms")))
    out = out.withColumn("lifetime_ms", (F.col("terminal_time_ms") - t).cast("double"))
    return out.withColumn("observed_lifetime_lower_bound_ms", (F.coalesce("last_event_time_ms", t) - t).cast("double"))


def aggressors(trades: DataFrame, life: DataFrame, cancel_code: str = "C") -> DataFrame:
    """Fills with aggressor_side and its source: the flag, else the later of both orders (ties and unknown ones: null)."""
    fills = _events(trades, cancel_code).where(~F.col("is_cancel"))
    first = life.groupBy(*KEYS, "ex_order_id").agg(F.min_by("time_ms", F.struct("time_ms", "order_id")).alias("t"))
    for c in ("ask", "bid"):
        one = first.select(*KEYS, F.col("ex_order_id").alias(f"{c}_order_id"), F.col("t").alias(f"{c}_ms"))
        fills = fills.withColumn(f"{c}_order_id", F.col(f"{c}_order_id").cast("long")).join(one, [*KEYS, f"{c}_order_id"], "left")
    known = F.col("flag").isin("B", "S")
    later = F.when(F.col("bid_ms") > F.col("ask_ms"), "B").when(F.col("ask_ms") > F.col("bid_ms"), "S")
    side = F.when(known, F.col("flag")).otherwise(later)
    known = F.coalesce(known, F.lit(False))
    source = F.when(known, "bs_flag").when(later.isNotNull(), "order_time").otherwise("unknown")
    return fills.withColumn("aggressor_side", side).withColumn("aggressor_side_source", source).withColumn("bs_flag_observed", known)


def minute_features(life: DataFrame, trades: DataFrame, quotes: DataFrame | None = None, price_scale: float = 10_000.0, cancel_code: str = "C") -> DataFrame:
    """The minute table: submissions, trades, cancels and quotes, each aggregated once, then put side by side."""
    v = F.col("submitted_volume")

    def when(side: str, x: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("side") == side, x)), F.lit(0.0))

    states = [F.count_if(F.col("terminal_state") == s).alias(f"state_{s.lower()}_count") for s in TERMINAL_STATES]
    submit = life.groupBy(*MINUTE).agg(
        F.min_by("session", F.struct("time_ms", "ex_order_id")).alias("session"),
        F.count("*").alias("submit_order_count"),
        F.sum(v).alias("submit_volume"),
        F.sum(F.col("price_scaled") * v).alias("submit_notional"),
        F.sum("filled_volume").alias("submit_filled_volume"),
        F.sum("canceled_volume").alias("submit_canceled_volume"),
        F.sum("remaining_volume").alias("submit_remaining_volume"),
        F.avg(F.col("is_terminal_observed").cast("double")).alias("submit_terminal_observed_rate"),
        F.avg(v).alias("submit_mean_order_volume"),
        F.max(v).alias("submit_max_order_volume"),
        F.avg("lifetime_ms").alias("submit_mean_lifetime_ms"),
        F.avg("observed_lifetime_lower_bound_ms").alias("submit_mean_lifetime_lower_bound_ms"),
        F.count_if(F.col("terminal_state").endswith("_OPEN")).alias("submit_open_order_count"),
        when("B", v).alias("submit_buy_volume"),
        when("S", v).alias("submit_sell_volume"),
        F.count_if(F.col("side") == "B").alias("submit_buy_order_count"),
        F.count_if(F.col("side") == "S").alias("submit_sell_order_count"),
        div0(F.sum(v * v), F.sum(v) * F.sum(v)).alias("submit_order_hhi"),
        *states,
    )
    fills = aggressors(trades, life, cancel_code)
    w = F.col("volume").cast("double")

    def of(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(c, w)), F.lit(0.0))

    traded = fills.groupBy(*MINUTE).agg(
        F.count("*").alias("trade_count"),
        F.sum(w).alias("trade_volume"),
        F.sum(F.col("price") / price_scale * w).alias("trade_notional"),
        of(F.col("flag").isNull()).alias("trade_missing_bs_flag_volume"),
        of(F.col("aggressor_side_source") == "order_time").alias("trade_inferred_aggressor_volume"),
        of(F.col("aggressor_side").isNull()).alias("trade_unresolved_aggressor_volume"),
        F.avg(F.col("bs_flag_observed").cast("double")).alias("trade_bs_flag_observed_rate"),
        of(F.col("aggressor_side") == "B").alias("trade_active_buy_volume"),
        of(F.col("aggressor_side") == "S").alias("trade_active_sell_volume"),
    )
    traded = traded.withColumn("trade_vwap_scaled", div0("trade_notional", "trade_volume"))
    cancels = _events(trades, cancel_code).where("is_cancel")
    canceled = cancels.groupBy(*MINUTE).agg(
        F.count("*").alias("event_cancel_count"),
        F.sum(w).alias("event_cancel_volume"),
        of(F.col("bid_order_id") != 0).alias("event_cancel_buy_volume"),
        of(F.col("ask_order_id") != 0).alias("event_cancel_sell_volume"),
    )
    parts = [submit, traded, canceled]
    if quotes is not None:
        parts.append(quote_minutes(quotes, price_scale))
    # one union of tagged rows and one aggregation instead of a chain of outer joins
    names = [c for p in parts for c in p.columns if c not in MINUTE]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    out = rows.groupBy(*MINUTE).agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])
    zero = [c for c in names if c.endswith(("_count", "_volume", "_notional", "_hhi", "_ticks")) or c.startswith("state_")]
    out = out.fillna(0, zero).withColumn("session", F.coalesce("session", session_of(F.col("minute"))))

    def balance(a: str, b: str) -> Column:
        return div0(F.col(a) - F.col(b), F.col(a) + F.col(b))

    return out.withColumns(
        {
            "submit_buy_sell_imbalance": balance("submit_buy_volume", "submit_sell_volume"),
            "submit_fill_ratio": div0("submit_filled_volume", "submit_volume"),
            "submit_cancel_ratio": div0("submit_canceled_volume", "submit_volume"),
            "submit_open_ratio": div0("submit_remaining_volume", "submit_volume"),
            "submit_top_order_share": div0("submit_max_order_volume", "submit_volume"),
            "trade_active_imbalance": balance("trade_active_buy_volume", "trade_active_sell_volume"),
            "cancel_buy_sell_imbalance": balance("event_cancel_buy_volume", "event_cancel_sell_volume"),
        }
    )


def quote_minutes(quotes: DataFrame, price_scale: float = 10_000.0) -> DataFrame:
    rows = with_clock(quotes)
    last = F.max_by("price", F.struct("time_ms", "cum_volume"))
    return rows.groupBy(*MINUTE).agg(
        F.count("*").alias("quote_ticks"),
        F.sum(F.col("volume").cast("double")).alias("quote_tick_volume"),
        F.max(F.col("cum_volume").cast("double")).alias("quote_cum_volume"),
        (last / price_scale).alias("quote_last_price_scaled"),
    )


def _hits(trades: DataFrame, orders: DataFrame, column: str) -> DataFrame:
    """``trades`` with whether ``column`` names an order of the same stock and day."""
    ids = orders.select(*KEYS, F.col("ex_order_id").cast("long").alias(column)).where(F.col(column) != 0).distinct().withColumn("hit", F.lit(True))
    return trades.withColumn(column, F.col(column).cast("long")).join(ids, [*KEYS, column], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def hit_rates(orders: DataFrame, trades: DataFrame, cancel_code: str = "C", keys: list[str] = KEYS) -> DataFrame:
    """(*keys, ask_fill_hit_rate, bid_fill_hit_rate, cancel_hit_rate); a cancel is looked up by whichever id it has."""
    events = _events(trades, cancel_code)
    reference = F.coalesce(F.nullif(F.col("ask_order_id").cast("long"), F.lit(0).cast("long")), F.nullif(F.col("bid_order_id").cast("long"), F.lit(0).cast("long")))
    out = None
    for name, rows, column in (("ask_fill", events.where(~F.col("is_cancel")), "ask_order_id"), ("bid_fill", events.where(~F.col("is_cancel")), "bid_order_id"), ("cancel", events.where("is_cancel").withColumn("__ref", reference), "__ref")):
        one = _hits(rows, orders, column).groupBy(*keys).agg(F.avg(F.col("hit").cast("double")).alias(f"{name}_hit_rate"))
        out = one if out is None else out.join(one, keys, "full_outer")
    return out


def quality(orders: DataFrame, trades: DataFrame, life: DataFrame, cancel_code: str = "C") -> DataFrame:
    """Counts, hit rates and volumes of each stock and day."""
    made = life.groupBy(*KEYS).agg(
        F.count("*").alias("orders"),
        F.count_if(F.col("remaining_volume") < -TOLERANCE).alias("negative_remaining_orders"),
        F.count_if(F.col("is_terminal_observed")).alias("terminal_observed_orders"),
        F.count_if(~F.col("is_terminal_observed")).alias("open_orders"),
        *[F.sum(f"{c}_volume").alias(f"{c}_volume") for c in ("submitted", "filled", "canceled", "remaining")],
    )
    events = _events(trades, cancel_code).groupBy(*KEYS).agg(F.count("*").alias("trades"), F.count_if(~F.col("is_cancel")).alias("fill_trades"), F.count_if(F.col("is_cancel")).alias("cancel_events"))
    return made.join(events, KEYS, "full_outer").join(hit_rates(orders, trades, cancel_code), KEYS, "full_outer")


def quote_reconciliation(trades: DataFrame, quotes: DataFrame, cancel_code: str = "C") -> DataFrame:
    """Traded volume against the quotes' volumes of each stock and day."""
    fills = _events(trades, cancel_code).where(~F.col("is_cancel")).groupBy(*KEYS).agg(F.sum(F.coalesce(F.col("volume").cast("double"), F.lit(0.0))).alias("trade_fill_volume"))
    cum = F.coalesce(F.col("cum_volume").cast("double"), F.lit(0.0))
    w = Window.partitionBy(*KEYS).orderBy("time_ms", "cum_volume")
    rows = with_clock(quotes).withColumn("__c", cum)
    rows = rows.withColumn("__d", F.greatest(F.col("__c") - F.coalesce(F.lag("__c").over(w), F.lit(0.0)), F.lit(0.0)))
    made = rows.groupBy(*KEYS).agg(
        F.count("*").alias("quote_rows"),
        F.max("__c").alias("quote_final_cum_volume"),
        F.sum(F.greatest(F.coalesce(F.col("volume").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("quote_positive_tick_volume"),
        F.sum("__d").alias("quote_positive_cum_diff_volume"),
    )
    out = fills.join(made, KEYS, "full_outer").fillna(0.0, ["trade_fill_volume", "quote_final_cum_volume", "quote_positive_tick_volume", "quote_positive_cum_diff_volume"]).fillna(0, ["quote_rows"])
    gap = F.col("trade_fill_volume") - F.col("quote_final_cum_volume")
    return out.withColumns({"trade_quote_volume_diff": gap, "trade_quote_volume_diff_abs": F.abs(gap), "trade_quote_volume_diff_ratio": div(F.abs(gap), "trade_fill_volume")})


_RATIOS = ("submit_fill_ratio", "submit_cancel_ratio", "submit_open_ratio")
_BALANCES = ("submit_buy_sell_imbalance", "trade_active_imbalance", "cancel_buy_sell_imbalance")
_CRITICAL = ("submit_volume", "submit_fill_ratio", "submit_cancel_ratio", "submit_open_ratio", "trade_volume", "event_cancel_volume")


def minute_quality(life: DataFrame, trades: DataFrame, minutes: DataFrame, quotes: DataFrame | None = None, tolerance: float = TOLERANCE, cancel_code: str = "C") -> DataFrame:
    """Accounting gates of each stock and day: closure of volumes, bounds, nulls, and a status."""

    def outside(names: tuple[str, ...], low: float, high: float) -> Column:
        return sum((F.count_if((F.col(c) < low - tolerance) | (F.col(c) > high + tolerance)) for c in names), F.lit(0))

    a = life.groupBy(*KEYS).agg(
        *[F.sum(f"{c}_volume").alias(f"l_{c}") for c in ("submitted", "filled", "canceled", "remaining")],
        F.avg(F.col("is_terminal_observed").cast("double")).alias("terminal_observed_rate"),
        F.count_if(F.col("remaining_volume") < -tolerance).alias("negative_remaining_orders"),
    )
    e = _events(trades, cancel_code).groupBy(*KEYS).agg(F.sum(F.when(~F.col("is_cancel"), F.col("volume"))).alias("e_fill"), F.sum(F.when(F.col("is_cancel"), F.col("volume"))).alias("e_cancel"))
    m = minutes.groupBy(*KEYS).agg(
        F.count("*").alias("minute_rows"),
        *[F.sum(c).alias(f"m_{c}") for c in ("submit_volume", "submit_filled_volume", "submit_canceled_volume", "submit_remaining_volume", "trade_volume", "event_cancel_volume")],
        outside(_RATIOS, 0.0, 1.0).alias("ratio_out_of_bounds"),
        outside(_BALANCES, -1.0, 1.0).alias("imbalance_out_of_bounds"),
        sum((F.count_if(F.col(c).isNull()) for c in _CRITICAL), F.lit(0)).alias("critical_nan_count"),
        F.sum("trade_missing_bs_flag_volume").alias("missing_bs_flag_volume"),
        F.sum("trade_inferred_aggressor_volume").alias("inferred_aggressor_volume"),
        F.sum("trade_unresolved_aggressor_volume").alias("unresolved_aggressor_volume"),
        *[F.count_if(F.col("session") == s).alias(f"{s}_minutes") for s in ("opening_auction", "continuous", "closing_auction")],
        *[F.max(f"submit_{c}").alias(f"max_submit_{c}") for c in ("open_ratio", "cancel_ratio", "order_hhi")],
    )
    out = m.join(a, KEYS, "left").join(e, KEYS, "left").fillna(0.0, ["l_submitted", "l_filled", "l_canceled", "l_remaining", "e_fill", "e_cancel"]).fillna(0, ["negative_remaining_orders"])
    closes = {"submit_volume": ("l_submitted", "submit_volume"), "submit_filled": ("l_filled", "submit_filled_volume"), "submit_canceled": ("l_canceled", "submit_canceled_volume"), "submit_remaining": ("l_remaining", "submit_remaining_volume"), "trade_volume": ("e_fill", "trade_volume"), "cancel_event_volume": ("e_cancel", "event_cancel_volume")}
    out = out.withColumns({f"{k}_diff_abs": F.abs(F.col(x) - F.col(f"m_{y}")) for k, (x, y) in closes.items()})
    if quotes is None:
        out = out.withColumn("quote_trade_volume_diff_abs", F.lit(None).cast("double"))
    else:
        gap = quote_reconciliation(trades, quotes, cancel_code).select(*KEYS, F.col("trade_quote_volume_diff_abs").alias("quote_trade_volume_diff_abs"))
        out = out.join(gap, KEYS, "left")
    worst = F.greatest(*[F.col(f"{k}_diff_abs") for k in closes], F.coalesce("quote_trade_volume_diff_abs", F.lit(0.0)))
    failures = F.col("negative_remaining_orders") + F.col("ratio_out_of_bounds") + F.col("imbalance_out_of_bounds") + F.col("critical_nan_count") + (worst > tolerance).cast("int")
    out = out.withColumn("failure_count", failures).withColumn("warning_count", (F.col("unresolved_aggressor_volume") > tolerance).cast("int"))
    status = F.when(F.col("failure_count") > 0, "fail").when(F.col("warning_count") > 0, "review").otherwise("pass")
    out = out.withColumn("gate_status", status).withColumn("unresolved_aggressor_ratio", div0("unresolved_aggressor_volume", "missing_bs_flag_volume"))
    return out.drop(*[c for c in out.columns if c.startswith(("l_", "m_", "e_"))])


def coverage(orders: DataFrame, trades: DataFrame, cancel_code: str = "C") -> DataFrame:
    """(date, ...): rows, stocks by exchange, stocks of one stream only, and hit rates over stocks with orders."""

    def stream(df: DataFrame, name: str) -> DataFrame:
        code = F.col("wind_code")
        return df.groupBy("date").agg(
            F.count("*").alias(f"{name}_rows"),
            F.count_distinct(code).alias(f"{name}_stocks"),
            F.count_distinct(F.when(code.endswith(".SZ"), code)).alias(f"{name}_sz_stocks"),
            F.count_distinct(F.when(code.endswith(".SH"), code)).alias(f"{name}_sh_stocks"),
        )

    a, b = (df.select(*KEYS).distinct() for df in (orders, trades))
    sides = a.withColumn("o", F.lit(1)).join(b.withColumn("t", F.lit(1)), KEYS, "full_outer").groupBy("date").agg(F.count_if(F.col("o").isNotNull() & F.col("t").isNotNull()).alias("common_stocks"), F.count_if(F.col("t").isNull()).alias("order_only_stocks"), F.count_if(F.col("o").isNull()).alias("trade_only_stocks"))
    kept = trades.join(a, KEYS, "left_semi")
    out = stream(orders, "order").join(stream(trades, "trade"), "date", "full_outer").join(sides, "date", "full_outer")
    return out.join(hit_rates(orders, kept, cancel_code, ["date"]), "date", "left")


def forward_returns(minutes: DataFrame, horizons: tuple[int, ...] = (1, 3, 5), price: str = "quote_last_price_scaled") -> DataFrame:
    """Adds future_return_{h}m: to the row exactly h minutes later, if it is in continuous trading; null otherwise.

    Raises when the job runs if a minute occurs twice.
    """
    w = Window.partitionBy(*KEYS).orderBy("minute")
    n = F.count("*").over(Window.partitionBy(*MINUTE))
    out = minutes.withColumn("minute", F.when(n > 1, F.raise_error(F.lit("duplicate minutes")).cast("int")).otherwise(F.col("minute")))
    at = F.when((F.col("session") == "continuous") & (F.col(price) > 0), F.col(price))
    made = {}
    for h in horizons:
        later = F.max(at).over(w.rangeBetween(h, h))
        made[f"future_return_{h}m"] = F.when(F.col(price) > 0, div(later, price) - 1)
    return out.withColumns(made)


def state_screen(df: DataFrame, state: str = "hmm_state", horizons: tuple[int, ...] = (1, 3, 5)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary by state and horizon, the same by stock and day, spread of the best over the worst state)."""
    names = [f"future_return_{h}m" for h in horizons if f"future_return_{h}m" in df.columns]
    if not names:
        raise ValueError("no forward returns: call forward_returns first")
    long = df.unpivot([*KEYS, state], names, "h", "r").withColumn("horizon_min", F.regexp_extract("h", r"(\d+)m$", 1).cast("int"))
    r = F.col("r")
    summary = long.groupBy(state, "horizon_min").agg(
        F.count(r).alias("n"),
        (F.avg(r) * 10_000).alias("mean_ret_bps"),
        (F.stddev_samp(r) * 10_000).alias("std_ret_bps"),
        F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))).alias("pos_rate"),
    )
    summary = summary.withColumn("se_bps", F.col("std_ret_bps") / F.sqrt(F.nullif("n", F.lit(0).cast("long")))).withColumn("t", div("mean_ret_bps", "se_bps"))
    cells = long.groupBy(*KEYS, state, "horizon_min").agg(F.count(r).alias("n"), (F.avg(r) * 10_000).alias("mean_ret_bps"))
    m = F.col("mean_ret_bps")
    there = summary.where("n > 0")
    # ties go to the smallest state
    best = Window.partitionBy("horizon_min").orderBy(m.desc(), state)
    worst = Window.partitionBy("horizon_min").orderBy(m, state)
    ranked = there.withColumn("b", F.row_number().over(best)).withColumn("w", F.row_number().over(worst))

    def pick(c: str, at: str) -> Column:
        return F.max(F.when(F.col(at) == 1, F.col(c)))

    spread = ranked.groupBy("horizon_min").agg(
        pick(state, "b").alias("top_state"), pick("mean_ret_bps", "b").alias("top_mean_ret_bps"), pick("n", "b").alias("top_n"), pick(state, "w").alias("bottom_state"), pick("mean_ret_bps", "w").alias("bottom_mean_ret_bps"), pick("n", "w").alias("bottom_n")
    )
    return summary, cells, spread.withColumn("spread_bps", F.col("top_mean_ret_bps") - F.col("bottom_mean_ret_bps"))


def run_lengths(labels: DataFrame, state: str = "hmm_state") -> DataFrame:
    """(wind_code, date, run, state, length): runs of one state in minute order."""
    w = Window.partitionBy(*KEYS).orderBy("minute")
    new = F.coalesce((F.col(state) != F.lag(state).over(w)).cast("int"), F.lit(1))
    rows = labels.withColumn("__new", new).withColumn("run", F.sum("__new").over(w))
    return rows.groupBy(*KEYS, "run", state).agg(F.count("*").alias("length"))


def shares(labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(wind_code, date, cluster, minutes, share)."""
    n = labels.groupBy(*KEYS, cluster).agg(F.count("*").alias("minutes"))
    return n.withColumn("share", F.col("minutes") / F.sum("minutes").over(Window.partitionBy(*KEYS)))
