"""DuckDB SQL for the registered queries, written from the definitions.  Doubles are rounded last, without negative zeros."""

from __future__ import annotations

from ..operators import factors, kline, latent, orderflow, regimes

_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
BARS = f"""bars AS (
  SELECT CAST(s_nationkey AS INTEGER) AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
    first(l_extendedprice / l_quantity ORDER BY {_ORDER}) AS open, max(l_extendedprice / l_quantity) AS high,
    min(l_extendedprice / l_quantity) AS low, last(l_extendedprice / l_quantity ORDER BY {_ORDER}) AS close,
    sum(l_quantity) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) AS vwap
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
T = "PARTITION BY ticker ORDER BY date"


def r(x: str, name: str, digits: int = 6) -> str:
    return f"ROUND({x}, {digits}) + 0.0 AS {name}"


def rs(names, digits: int = 6) -> str:
    return ", ".join(r(n, n, digits) for n in names)


def w(n: int) -> str:
    return f"OVER ({T} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN COUNT({x}) {w(n)} >= {least or n} THEN {agg}({x}) {w(n)} END"


def lag(x: str, n: int = 1) -> str:
    return f"LAG({x}, {n}) OVER ({T})"


def change(x: str, n: int = 1) -> str:
    return f"({x} / NULLIF({lag(x, n)}, 0) - 1)"


def ts_rank(x: str, n: int) -> str:
    seen = f"list({x}) {w(n)}"
    return f"CASE WHEN COUNT({x}) {w(n)} >= {n} AND {x} IS NOT NULL THEN (len(list_filter({seen}, lambda v: v < {x})) + (len(list_filter({seen}, lambda v: v = {x})) + 1) / 2.0) / {n} END"


def corr(x: str, y: str, n: int) -> str:
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"CASE WHEN COUNT({a}) {w(n)} >= {n} THEN covar_samp({x}, {y}) {w(n)} / NULLIF(stddev_samp({a}) {w(n)} * stddev_samp({b}) {w(n)}, 0) END"


def avg_rank(x: str, keys: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN RANK() OVER (PARTITION BY {keys} ORDER BY {x} NULLS LAST) + (COUNT(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0 END"


def pct_rank(x: str, keys: str = "date") -> str:
    return f"({avg_rank(x, keys)}) / NULLIF(COUNT({x}) OVER (PARTITION BY {keys}), 0)"


def zscore(x: str) -> str:
    return f"({x} - AVG({x}) OVER (PARTITION BY date)) / NULLIF(STDDEV_SAMP({x}) OVER (PARTITION BY date), 0)"


def bucket(x: str, q: str, keys: str) -> str:
    n = f"COUNT({x}) OVER (PARTITION BY {keys})"
    place = f"(ROW_NUMBER() OVER (PARTITION BY {keys}, {x} IS NULL ORDER BY {x}, ticker) - 1)"
    return f"CASE WHEN {x} IS NOT NULL THEN CAST(GREATEST(COALESCE(CEIL(CAST({place} * {q} AS DOUBLE) / NULLIF({n} - 1, 0)), 1), 1) AS INTEGER) - 1 END"


def _decay(x: str, n: int) -> str:
    return "(" + " + ".join(f"{lag(x, n - 1 - k) if k < n - 1 else x} * {k + 1}" for k in range(n)) + f") / {n * (n + 1) / 2}"


_SPREAD = "NULLIF(high - low, 0)"
FACTORS = f"""{BARS}, f1 AS (
  SELECT *, {change("close")} AS ret_1d, open / NULLIF({lag("close")}, 0) - 1 AS overnight_gap, (close - open) / NULLIF(open, 0) AS intraday_return,
    {_SPREAD} AS daily_range, (high - low) - LAG(high - low) OVER ({T}) AS range_delta, {_decay("vwap", 10)} AS vwap_decay,
    -{change("close")} AS reversal_1d, {change("close", 5)} AS momentum_5d, {change("close", 21)} AS momentum_21d, {change("close", 63)} AS momentum_63d,
    (volume - ({roll("AVG", "volume", 21)})) / NULLIF({roll("STDDEV_SAMP", "volume", 21)}, 0) AS volume_z_21d, close * volume AS dollar_volume,
    (high - close) / {_SPREAD} AS close_to_high, (close - low) / {_SPREAD} AS close_to_low, close / NULLIF(vwap, 0) - 1 AS vwap_gap,
    close / NULLIF({roll("MAX", "high", 21)}, 0) - 1 AS alpha_price_to_21d_high, close / NULLIF({roll("AVG", "close", 21)}, 0) - 1 AS alpha_ma_gap_21d,
    ({roll("AVG", "volume", 5)}) / NULLIF({roll("AVG", "volume", 21)}, 0) - 1 AS alpha_volume_trend_5_21d
  FROM bars), f2 AS (
  SELECT *, ABS(ret_1d) / NULLIF(dollar_volume, 0) AS illiquidity, {roll("STDDEV_SAMP", "ret_1d", 21)} AS volatility_21d, -({roll("STDDEV_SAMP", "ret_1d", 21)}) AS alpha_low_volatility_21d,
    -({ts_rank("range_delta", 9)}) AS alpha_range_ts_rank_9, -({ts_rank("overnight_gap", 5)}) AS alpha_overnight_gap_reversal_5,
    {ts_rank("intraday_return", 5)} AS alpha_intraday_strength_5, {ts_rank("close_to_low", 5)} AS alpha_close_position_5,
    -((high - low) / NULLIF({roll("AVG", "daily_range", 21)}, 0) - 1) AS alpha_range_compression_21d,
    -(({roll("STDDEV_SAMP", "ret_1d", 5)}) / NULLIF({roll("STDDEV_SAMP", "ret_1d", 21)}, 0) - 1) AS alpha_volatility_contraction_21d,
    ({roll("AVG", "intraday_return", 21)}) / NULLIF({roll("STDDEV_SAMP", "intraday_return", 21)}, 0) AS alpha_intraday_quality_21d,
    ({roll("AVG", "overnight_gap", 21)}) / NULLIF({roll("STDDEV_SAMP", "overnight_gap", 21)}, 0) AS alpha_gap_pressure_21d
  FROM f1), f3 AS (
  SELECT *, ret_1d - AVG(ret_1d) OVER (PARTITION BY date) AS market_residual_ret_1d, {pct_rank("open")} AS open_rank, {pct_rank("close")} AS close_rank,
    {pct_rank("volume")} AS volume_rank, open - vwap_decay AS vwap_distance
  FROM f2), f AS (
  SELECT *, -({pct_rank("vwap_distance")}) AS alpha_vwap_reversion_10, -({roll("AVG", "illiquidity", 21)}) AS alpha_liquidity_quality_21d,
    -({corr("open_rank", "volume_rank", 10)}) AS alpha_open_volume_corr_10, -({corr("close_rank", "volume_rank", 21)}) AS alpha_volume_price_divergence_21,
    {roll("SUM", "market_residual_ret_1d", 21)} AS alpha_residual_momentum_21d, -({roll("SUM", "market_residual_ret_1d", 5)}) AS alpha_residual_reversal_5d
  FROM f3)"""


def _future(h: int) -> str:
    return f"LEAD(close, {h}) OVER ({T}) / NULLIF(close, 0) - 1"


def _long(h: int = 5, names=("momentum_5d", "reversal_1d", "volatility_21d", "close_to_low", "vwap_gap")) -> str:
    rows = " UNION ALL ".join(f"SELECT ticker, date, '{n}' AS factor, ROUND({n}, 10) AS value, ROUND(label, 10) AS label FROM lab" for n in names)
    return f"{FACTORS}, lab AS (SELECT *, {_future(h)} AS label FROM f), long AS ({rows}), pairs AS (SELECT * FROM long WHERE value IS NOT NULL AND label IS NOT NULL)"


def _spearman(source: str, keys: str) -> str:
    ranked = f"SELECT {keys}, {avg_rank('value', keys)} AS x, {avg_rank('label', keys)} AS y FROM {source}"
    return f"SELECT {keys}, COUNT(*) AS n, covar_samp(x, y) / NULLIF(stddev_samp(x) * stddev_samp(y), 0) AS ic FROM ({ranked}) GROUP BY {keys}"


def _ic(h: int = 5, **k) -> str:
    return f"{_long(h, **k)}, ic AS (SELECT factor, date, ROUND(ic, 12) AS ic FROM ({_spearman('pairs', 'factor, date')}) WHERE n >= 2 AND ic IS NOT NULL)"


_STATS = "SELECT factor, AVG(ic) AS mean_ic, STDDEV_SAMP(ic) AS ic_std, AVG(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS positive_ic_rate, COUNT(*) AS days, CASE WHEN STDDEV_SAMP(ic) = 0 THEN 0.0 ELSE AVG(ic) / STDDEV_SAMP(ic) END AS ic_ir FROM ic GROUP BY factor"
_STAT_COLUMNS = f"factor, {rs(['mean_ic', 'ic_std', 'positive_ic_rate', 'ic_ir'])}, days"


def _buckets(h: int) -> str:
    return f"""{_long(h)}, sized AS (SELECT *, COUNT(*) OVER d AS n, MIN(value) OVER d AS lo, MAX(value) OVER d AS hi FROM pairs WINDOW d AS (PARTITION BY factor, date)),
  buckets AS (SELECT ticker, date, factor, value, label, {bucket("value", "5", "factor, date")} AS quantile FROM sized WHERE n >= 5 AND lo < hi)"""


def _held() -> str:
    n = "COUNT(*) OVER (PARTITION BY factor, date, quantile)"
    return f"""{_buckets(1)}, held AS (SELECT factor, date, ticker, CASE WHEN quantile = 4 THEN 'long' ELSE 'short' END AS side,
    CASE WHEN quantile = 4 THEN 1.0 ELSE -1.0 END / {n} AS weight, label FROM buckets WHERE quantile IN (0, 4))"""


def _daily() -> str:
    def side(c: str) -> str:
        b = f"COALESCE(LAG({c}) OVER (PARTITION BY factor ORDER BY date), [])"
        both = f"len(list_intersect({c}, {b}))"
        union = f"(len({c}) + len({b}) - {both})"
        return f"(CAST(len({c}) + len({b}) - 2 * {both} AS DOUBLE) / GREATEST({union}, 1))"

    return f"""{_held()}, sets AS (SELECT factor, date, list(ticker) FILTER (side = 'long') AS l, list(ticker) FILTER (side = 'short') AS s FROM held GROUP BY factor, date),
  turn AS (SELECT factor, date, ({side("l")} + {side("s")}) / 2 AS turnover FROM sets),
  bench AS (SELECT date, AVG(label) AS benchmark_return FROM (SELECT DISTINCT ticker, date, label FROM long WHERE label IS NOT NULL) GROUP BY date),
  legs AS (SELECT factor, date, SUM(CASE WHEN side = 'long' THEN weight * label ELSE 0 END) AS long_return, SUM(CASE WHEN side = 'short' THEN -weight * label ELSE 0 END) AS short_leg_return,
    COUNT(*) FILTER (side = 'long') AS top_count, COUNT(*) FILTER (side = 'short') AS bottom_count FROM held GROUP BY factor, date),
  daily AS (SELECT *, long_return - short_leg_return - cost AS spread_return, long_return - benchmark_return AS long_excess_return
    FROM (SELECT *, turnover * 5.0 / 10000 AS cost FROM legs JOIN turn USING (factor, date) LEFT JOIN bench USING (date)))"""


def _compounded(x: str, name: str, digits: int = 6) -> str:
    return r(f"SIGN({x}) * LN(1 + ABS({x}))", name, digits)


def _metrics(column: str) -> str:
    run = "OVER (PARTITION BY factor ORDER BY date ROWS UNBOUNDED PRECEDING)"
    return f"""(SELECT factor, COUNT(*) AS periods, product(1 + x) - 1 AS total_return, AVG(x) * 252 AS annualized_return,
    COALESCE(STDDEV_SAMP(x), 0) * sqrt(252) AS annualized_volatility, AVG(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate,
    COALESCE(STDDEV_SAMP(CASE WHEN x < 0 THEN x END), 0) * sqrt(252) AS downside_volatility,
    CASE WHEN COALESCE(STDDEV_SAMP(x), 0) = 0 THEN 0.0 ELSE AVG(x) * 252 / (STDDEV_SAMP(x) * sqrt(252)) END AS information_ratio, MIN(dd) AS max_drawdown,
    COALESCE(AVG(x) * 252 / NULLIF(ABS(MIN(dd)), 0), 0) AS calmar
    FROM (SELECT factor, x, equity / MAX(equity) {run} - 1 AS dd FROM (SELECT factor, date, {column} AS x, product(1 + {column}) {run} AS equity FROM daily WHERE {column} IS NOT NULL)) GROUP BY factor)"""


_KLINE = f"""{BARS}, k0 AS (SELECT *, ROUND({change("close")}, 10) AS kr, ROUND((high - low) / NULLIF({lag("close")}, 0), 10) AS ks,
    ROUND((volume - ({roll("AVG", "volume", 21)})) / NULLIF({roll("STDDEV_SAMP", "volume", 21)}, 0), 10) AS kv, ROUND((close - low) / {_SPREAD}, 10) AS kl FROM bars)"""


def _state(x: str, edges, names) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'missing' " + " ".join(f"WHEN {x} <= {e} THEN '{n}'" for e, n in zip(edges, names, strict=False)) + f" ELSE '{names[-1]}' END"


_KLINE += f""", k AS (SELECT *, kline_return_state || '|' || kline_range_state || '|' || kline_volume_state || '|' || kline_close_location_state AS kline_token FROM (
  SELECT *, {_state("kr", kline.RETURN_EDGES, kline.RETURN_STATES)} AS kline_return_state, {_state("ks", kline.RANGE_EDGES, kline.RANGE_STATES)} AS kline_range_state,
    {_state("kv", kline.VOLUME_EDGES, kline.VOLUME_STATES)} AS kline_volume_state, {_state("kl", kline.LOCATION_EDGES, kline.LOCATION_STATES)} AS kline_close_location_state FROM k0))"""


def _clock(key: str) -> str:
    s = f"(33300 + ({key}) * 37 % 20700)"
    return f"CAST({s} // 3600 * 10000000 + {s} % 3600 // 60 * 100000 + {s} % 60 * 1000 AS BIGINT)"


def _time(x: str = "time") -> str:
    return f"({x} // 10000000 * 3600000 + {x} // 100000 % 100 * 60000 + {x} // 1000 % 100 * 1000 + {x} % 1000)"


_SESSION = "CASE WHEN time_ms < 34200000 THEN 'opening_auction' WHEN time_ms >= 53820000 THEN 'closing_auction' ELSE 'continuous' END"
STREAMS = f"""size AS (SELECT l_orderkey AS ex_order_id, SUM(l_quantity) AS lines, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS price FROM lineitem GROUP BY 1),
  o AS (SELECT *, {_time()} AS time_ms FROM (SELECT printf('%06d.', c_nationkey) || CASE WHEN c_nationkey % 2 = 0 THEN 'SZ' ELSE 'SH' END AS wind_code, CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) AS date,
    {_clock("o_orderkey")} AS time, o_orderkey AS ex_order_id, CASE WHEN o_orderkey % 2 = 0 THEN 'B' ELSE 'S' END AS side, ROUND(price) AS price, lines + 10 * (o_orderkey % 3) AS volume
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN size ON ex_order_id = o_orderkey)),
  t0 AS (SELECT o.wind_code, o.date, {_clock("l_orderkey + l_linenumber + l_partkey % 7")} AS time, l_returnflag = 'R' AS is_cancel,
    CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_suppkey % 2 = 0 THEN 'B' ELSE 'S' END AS flag, ROUND(l_extendedprice / l_quantity * 100) AS price, l_quantity AS volume,
    l_orderkey AS own, CASE WHEN l_returnflag = 'R' OR l_partkey % 4 = 0 THEN 0 ELSE l_orderkey + 1 - 2 * (l_partkey % 2) END AS other FROM lineitem JOIN o ON l_orderkey = ex_order_id),
  t AS (SELECT *, {_time()} AS time_ms, {_time()} // 60000 AS minute, CASE WHEN own % 2 = 0 THEN other ELSE own END AS ask, CASE WHEN own % 2 = 0 THEN own ELSE other END AS bid FROM t0),
  q AS (SELECT wind_code, date, time, time_ms, minute, MAX(price) AS price, SUM(volume) AS volume, SUM(SUM(volume)) OVER (PARTITION BY wind_code, date ORDER BY time) AS cum_volume FROM t WHERE NOT is_cancel GROUP BY 1, 2, 3, 4, 5),
  refs AS (SELECT wind_code, date, ask AS ex_order_id, 'S' AS s, is_cancel, flag, volume, time_ms FROM t WHERE ask <> 0 UNION ALL SELECT wind_code, date, bid, 'B', is_cancel, flag, volume, time_ms FROM t WHERE bid <> 0),
  sums AS (SELECT wind_code, date, ex_order_id, SUM(volume) FILTER (NOT is_cancel) AS fv, COUNT(*) FILTER (NOT is_cancel) AS fc, MIN(time_ms) FILTER (NOT is_cancel) AS f0, MAX(time_ms) FILTER (NOT is_cancel) AS f1,
    SUM(volume) FILTER (NOT is_cancel AND COALESCE(s = flag, FALSE)) AS av, SUM(volume) FILTER (is_cancel) AS cv, COUNT(*) FILTER (is_cancel) AS cc, MIN(time_ms) FILTER (is_cancel) AS c0, MAX(time_ms) FILTER (is_cancel) AS c1 FROM refs GROUP BY 1, 2, 3),
  l1 AS (SELECT o.*, {_SESSION} AS session, time_ms // 60000 AS minute, price / 10000.0 AS price_scaled, o.volume AS submitted_volume, COALESCE(fv, 0) AS filled_volume, COALESCE(cv, 0) AS canceled_volume, COALESCE(av, 0) AS aggressor_filled_volume,
    COALESCE(fv, 0) - COALESCE(av, 0) AS passive_filled_volume, COALESCE(fc, 0) AS filled_event_count, COALESCE(cc, 0) AS canceled_event_count, LEAST(f0, c0) AS first_event_time_ms, GREATEST(f1, c1) AS last_event_time_ms
    FROM o LEFT JOIN sums USING (wind_code, date, ex_order_id)),
  life AS (SELECT *, submitted_volume - filled_volume - canceled_volume AS remaining_volume, submitted_volume - filled_volume - canceled_volume = 0 AS closed, CASE WHEN submitted_volume - filled_volume - canceled_volume = 0 THEN last_event_time_ms - time_ms END AS lifetime_ms,
    COALESCE(last_event_time_ms, time_ms) - time_ms AS observed_lifetime_lower_bound_ms,
    CASE WHEN submitted_volume < filled_volume + canceled_volume THEN 'OVER_ACCOUNTED' WHEN submitted_volume = filled_volume AND filled_volume > 0 THEN 'FULLY_FILLED' WHEN submitted_volume = canceled_volume AND canceled_volume > 0 THEN 'FULLY_CANCELED'
      WHEN submitted_volume = filled_volume + canceled_volume AND submitted_volume > 0 THEN 'PARTIAL_FILLED_CANCELED' WHEN filled_volume + canceled_volume > 0 THEN 'PARTIAL_OPEN' ELSE 'UNFILLED_OPEN' END AS terminal_state FROM l1),
  fills AS (SELECT t.*, CASE WHEN flag IS NOT NULL THEN flag WHEN b.time_ms > a.time_ms THEN 'B' WHEN a.time_ms > b.time_ms THEN 'S' END AS aggressor_side,
    CASE WHEN flag IS NOT NULL THEN 'bs_flag' WHEN b.time_ms <> a.time_ms THEN 'order_time' ELSE 'unknown' END AS aggressor_side_source
    FROM t LEFT JOIN o a ON a.wind_code = t.wind_code AND a.date = t.date AND a.ex_order_id = ask LEFT JOIN o b ON b.wind_code = t.wind_code AND b.date = t.date AND b.ex_order_id = bid WHERE NOT is_cancel)"""
_M = "wind_code, date, minute"
_STATE_COUNTS = ", ".join(f"COUNT(*) FILTER (terminal_state = '{s}') AS state_{s.lower()}_count" for s in orderflow.TERMINAL_STATES)


def _balance(a: str, b: str) -> str:
    return f"COALESCE(({a} - {b}) / NULLIF({a} + {b}, 0), 0)"


_SUBMIT = ["submit_volume", "submit_notional", "submit_filled_volume", "submit_canceled_volume", "submit_remaining_volume", "submit_max_order_volume", "submit_buy_volume", "submit_sell_volume", "submit_order_hhi"]
_TRADE = ["trade_volume", "trade_notional", "trade_missing_bs_flag_volume", "trade_inferred_aggressor_volume", "trade_unresolved_aggressor_volume", "trade_active_buy_volume", "trade_active_sell_volume"]
_CANCEL = ["event_cancel_volume", "event_cancel_buy_volume", "event_cancel_sell_volume"]
_COUNTS = ["submit_order_count", "submit_open_order_count", "submit_buy_order_count", "submit_sell_order_count", *(f"state_{s.lower()}_count" for s in orderflow.TERMINAL_STATES), "trade_count", "event_cancel_count", "quote_ticks"]
_NULLED = ["submit_terminal_observed_rate", "submit_mean_lifetime_ms", "submit_mean_lifetime_lower_bound_ms", "trade_bs_flag_observed_rate", "trade_vwap_scaled", "quote_last_price_scaled"]
_ZEROED = [*_SUBMIT, "submit_mean_order_volume", *_TRADE, *_CANCEL, "quote_tick_volume", "quote_cum_volume"]
_RATIOS = {
    "submit_buy_sell_imbalance": _balance("submit_buy_volume", "submit_sell_volume"),
    "submit_fill_ratio": "COALESCE(submit_filled_volume / NULLIF(submit_volume, 0), 0)",
    "submit_cancel_ratio": "COALESCE(submit_canceled_volume / NULLIF(submit_volume, 0), 0)",
    "submit_open_ratio": "COALESCE(submit_remaining_volume / NULLIF(submit_volume, 0), 0)",
    "submit_top_order_share": "COALESCE(submit_max_order_volume / NULLIF(submit_volume, 0), 0)",
    "trade_active_imbalance": _balance("trade_active_buy_volume", "trade_active_sell_volume"),
    "cancel_buy_sell_imbalance": _balance("event_cancel_buy_volume", "event_cancel_sell_volume"),
}
MINUTES = f"""{STREAMS}, ms AS (SELECT {_M}, COUNT(*) AS submit_order_count, SUM(submitted_volume) AS submit_volume, SUM(price_scaled * submitted_volume) AS submit_notional, SUM(filled_volume) AS submit_filled_volume, SUM(canceled_volume) AS submit_canceled_volume,
    SUM(remaining_volume) AS submit_remaining_volume, AVG(CAST(closed AS INTEGER)) AS submit_terminal_observed_rate, AVG(submitted_volume) AS submit_mean_order_volume, MAX(submitted_volume) AS submit_max_order_volume,
    AVG(lifetime_ms) AS submit_mean_lifetime_ms, AVG(observed_lifetime_lower_bound_ms) AS submit_mean_lifetime_lower_bound_ms, COUNT(*) FILTER (terminal_state LIKE '%\\_OPEN' ESCAPE '\\') AS submit_open_order_count,
    COALESCE(SUM(submitted_volume) FILTER (side = 'B'), 0) AS submit_buy_volume, COALESCE(SUM(submitted_volume) FILTER (side = 'S'), 0) AS submit_sell_volume, COUNT(*) FILTER (side = 'B') AS submit_buy_order_count, COUNT(*) FILTER (side = 'S') AS submit_sell_order_count,
    SUM(submitted_volume * submitted_volume) / (SUM(submitted_volume) * SUM(submitted_volume)) AS submit_order_hhi, {_STATE_COUNTS} FROM life GROUP BY {_M}),
  mt AS (SELECT {_M}, COUNT(*) AS trade_count, SUM(volume) AS trade_volume, SUM(price / 10000.0 * volume) AS trade_notional, COALESCE(SUM(volume) FILTER (flag IS NULL), 0) AS trade_missing_bs_flag_volume,
    COALESCE(SUM(volume) FILTER (aggressor_side_source = 'order_time'), 0) AS trade_inferred_aggressor_volume, COALESCE(SUM(volume) FILTER (aggressor_side IS NULL), 0) AS trade_unresolved_aggressor_volume,
    AVG(CASE WHEN flag IS NULL THEN 0.0 ELSE 1.0 END) AS trade_bs_flag_observed_rate, COALESCE(SUM(volume) FILTER (aggressor_side = 'B'), 0) AS trade_active_buy_volume, COALESCE(SUM(volume) FILTER (aggressor_side = 'S'), 0) AS trade_active_sell_volume,
    SUM(price / 10000.0 * volume) / SUM(volume) AS trade_vwap_scaled FROM fills GROUP BY {_M}),
  mc AS (SELECT {_M}, COUNT(*) AS event_cancel_count, SUM(volume) AS event_cancel_volume, COALESCE(SUM(volume) FILTER (bid <> 0), 0) AS event_cancel_buy_volume, COALESCE(SUM(volume) FILTER (ask <> 0), 0) AS event_cancel_sell_volume FROM t WHERE is_cancel GROUP BY {_M}),
  mq AS (SELECT {_M}, COUNT(*) AS quote_ticks, SUM(volume) AS quote_tick_volume, MAX(cum_volume) AS quote_cum_volume, last(price ORDER BY time_ms) / 10000.0 AS quote_last_price_scaled FROM q GROUP BY {_M}),
  m0 AS (SELECT {_M}, {", ".join(f"COALESCE({c}, 0) AS {c}" for c in [*_COUNTS, *_ZEROED] if c != "submit_mean_order_volume")}, COALESCE(submit_mean_order_volume, 0) AS submit_mean_order_volume, {", ".join(_NULLED)},
    CASE WHEN minute < 570 THEN 'opening_auction' WHEN minute >= 897 THEN 'closing_auction' ELSE 'continuous' END AS session
    FROM ms FULL JOIN mt USING ({_M}) FULL JOIN mc USING ({_M}) FULL JOIN mq USING ({_M})),
  m AS (SELECT *, {", ".join(f"{x} AS {n}" for n, x in _RATIOS.items())} FROM m0)"""


def _forward() -> str:
    at = "MAX(CASE WHEN session = 'continuous' AND quote_last_price_scaled > 0 THEN quote_last_price_scaled END)"
    cols = ", ".join(f"CASE WHEN quote_last_price_scaled > 0 THEN {at} OVER (PARTITION BY wind_code, date ORDER BY minute RANGE BETWEEN {h} FOLLOWING AND {h} FOLLOWING) / quote_last_price_scaled - 1 END AS future_return_{h}m" for h in (1, 3, 5))
    return f"{MINUTES}, fr AS (SELECT *, CAST(trade_count % 3 AS INTEGER) AS hmm_state, {cols} FROM m WHERE quote_ticks > 0)"


def _screen() -> str:
    rows = " UNION ALL ".join(f"SELECT wind_code, date, hmm_state, {h} AS horizon_min, future_return_{h}m AS ret FROM fr" for h in (1, 3, 5))
    return f"""{_forward()}, sl AS ({rows}), sc AS (SELECT hmm_state, horizon_min, COUNT(ret) AS n, AVG(ret) * 10000 AS mean_ret_bps, STDDEV_SAMP(ret) * 10000 AS std_ret_bps, AVG(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) AS pos_rate FROM sl GROUP BY 1, 2)"""


def _hit(name: str, where: str, column: str, keys: str) -> str:
    on = "x.wind_code = t.wind_code AND x.date = t.date AND x.ex_order_id = " + column
    return f"(SELECT {', '.join('t.' + k for k in keys.split(', '))}, AVG(CASE WHEN x.ex_order_id IS NOT NULL AND {column} <> 0 THEN 1.0 ELSE 0.0 END) AS {name}_hit_rate FROM t LEFT JOIN o x ON {on} WHERE {where} GROUP BY ALL)"


def _hits(keys: str) -> str:
    parts = [_hit("ask_fill", "NOT is_cancel", "ask", keys), _hit("bid_fill", "NOT is_cancel", "bid", keys), _hit("cancel", "is_cancel", "CASE WHEN ask <> 0 THEN ask ELSE bid END", keys)]
    return " FULL JOIN ".join(f"{p} h{i}" + (f" USING ({keys})" if i else "") for i, p in enumerate(parts))


def sql() -> dict[str, str]:
    out: dict[str, str] = {}

    def put(name: str, ctes: str, select: str) -> None:
        out[f"q_{name}"] = f"WITH {ctes} {select}"

    bars = ["open", "high", "low", "close", "volume", "vwap"]
    put("bars_week", BARS, f"SELECT ticker, date, {rs(bars)} FROM bars")
    out["q_bars_user_day"] = f"""SELECT ticker, date, {rs(bars[:5])} FROM (SELECT user_id AS ticker, CAST(ts AS DATE) AS date, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"""
    put("delay_delta", BARS, f"SELECT ticker, date, {r(lag('close', 2), 'delay_2')}, {r('close - ' + lag('close', 3), 'delta_3')} FROM bars")
    put("rolling", BARS, f"SELECT ticker, date, {r(roll('AVG', 'close', 5), 'mean_5')}, {r(roll('STDDEV_SAMP', 'close', 5), 'std_5')}, {r(roll('MAX', 'high', 5), 'max_5')}, {r(corr('close', 'volume', 10), 'corr_10')} FROM bars")
    put("ts_rank", BARS, f"SELECT ticker, date, {r(ts_rank('close', 9), 'ts_rank_9')} FROM bars")
    delta = f"(close - {lag('close')})"
    put("decay_linear", BARS, f"SELECT ticker, date, {r(_decay('vwap', 10), 'decay_10')}, {r(f'SIGN({delta}) * POW(ABS({delta}), 0.5)', 'power')} FROM bars")
    q05, q95 = (f"quantile_cont(close, {p}) OVER (PARTITION BY date)" for p in (0.05, 0.95))
    put("cross_section", BARS, f"SELECT ticker, date, {r(pct_rank('close'), 'rank')}, {r(zscore('volume'), 'zscore')}, {r(f'GREATEST(LEAST(close, {q95}), {q05})', 'clipped')} FROM bars")
    for name, some in (("base", factors.FACTORS[:10]), ("formula", factors.FACTORS[10:21]), ("path", [*factors.FACTORS[21:], *factors.HELPERS])):
        put(f"factors_{name}", FACTORS, f"SELECT ticker, date, {rs(some)} FROM f")
    pair = ("momentum_5d", "dollar_volume")
    ranked = ", ".join(f"{r(pct_rank(c), c + '_rank')}, {r(zscore(c), c + '_zscore')}" for c in pair)
    put("factor_ranks", f"{FACTORS}, g AS (SELECT ticker, date, ROUND(momentum_5d, 10) AS momentum_5d, dollar_volume FROM f)", f"SELECT ticker, date, {ranked} FROM g")
    specs = ", ".join("('{}', '{}', '{}', {}, {}, {}, {})".format(x.name, x.category, x.formula, x.lookback, x.stage, x.enabled, x.expected_direction) for x in factors.REGISTRY if x.enabled)
    out["q_registry"] = f"SELECT name, category, formula, CAST(lookback AS BIGINT) AS lookback, CAST(stage AS BIGINT) AS stage, enabled, CAST(expected_direction AS BIGINT) AS expected_direction FROM (VALUES {specs}) t(name, category, formula, lookback, stage, enabled, expected_direction)"
    labelled = f"{BARS}, x AS (SELECT *, {_future(5)} AS r FROM bars)"
    n = "COUNT(r) OVER (PARTITION BY date)"
    five = bucket("r", "5", "date")
    for name, e in (("return", "r"), ("rank", pct_rank("r")), ("zscore", zscore("r")), ("quantile", f"CASE WHEN {n} >= 2 THEN {bucket('r', f'LEAST({n}, 5)', 'date')} END"), ("top_bottom", f"CASE WHEN {n} >= 5 AND ({five}) IN (0, 4) THEN {five} END")):
        put(f"label_{name}", labelled, f"SELECT ticker, date, {r(f'CAST({e} AS DOUBLE)', 'label')} FROM x")
    put("daily_ic", _ic(), f"SELECT factor, date, {r('ic', 'ic')} FROM ic")
    put("ic_momentum_5d", _ic(names=("momentum_5d",)), f"SELECT {_STAT_COLUMNS} FROM ({_STATS})")
    put("ic_report", f"{_ic()}, pooled AS ({_spearman('pairs', 'factor')})", f"SELECT {_STAT_COLUMNS}, {r('ic', 'overall_rank_corr')} FROM ({_STATS}) LEFT JOIN (SELECT factor, ic FROM pooled) USING (factor)")
    by_q = f"{_buckets(5)}, byq AS (SELECT factor, date, quantile, AVG(label) AS mean_return, COUNT(*) AS n FROM buckets GROUP BY ALL)"
    put("quantile_returns", by_q, f"SELECT factor, date, quantile, {r('mean_return', 'mean_return')}, n FROM byq")
    put("monotonicity", f"{by_q}, mq AS (SELECT factor, CAST(quantile AS DOUBLE) AS value, ROUND(AVG(mean_return), 12) AS label FROM byq GROUP BY ALL)", f"SELECT factor, {r('COALESCE(ic, 0)', 'monotonicity')} FROM ({_spearman('mq', 'factor')})")
    gammas = ", ".join(f"SUM(dm * l{k}) AS g{k}" for k in range(6))
    lags = ", ".join(f"LAG(dm, {k}) OVER (PARTITION BY factor ORDER BY date) AS l{k}" for k in range(6))
    extra = " + ".join(f"2 * (1 - {k} / 6.0) * COALESCE(g{k}, 0) / n" for k in range(1, 6))
    put("newey_west", f"{_ic()}, d AS (SELECT factor, date, ic - AVG(ic) OVER (PARTITION BY factor) AS dm, ic FROM ic), e AS (SELECT *, {lags} FROM d), g AS (SELECT factor, COUNT(*) AS n, AVG(ic) AS mean, {gammas} FROM e GROUP BY factor)", f"SELECT factor, {r('mean / sqrt(CASE WHEN s > 0 THEN s ELSE g0 / n END / n)', 'nw_t')} FROM (SELECT *, g0 / n + {extra} AS s FROM g)")
    put("yearly_agreement", f"{_ic()}, y AS (SELECT factor, year(date) AS y, AVG(ic) AS m FROM ic GROUP BY 1, 2)", f"SELECT factor, {r('AVG(CASE WHEN (m >= 0) = (a >= 0) THEN 1.0 ELSE 0.0 END)', 'yearly_agreement')}, COUNT(*) AS years FROM (SELECT *, AVG(m) OVER (PARTITION BY factor) AS a FROM y) GROUP BY factor")
    day = "OVER (PARTITION BY factor, date)"
    orth = f"""{_long(names=('momentum_5d', 'close_to_low'))}, z AS (SELECT p.*, f.reversal_1d AS z FROM pairs p JOIN f USING (ticker, date) WHERE f.reversal_1d IS NOT NULL),
      e AS (SELECT ticker, date, factor, label, COUNT(*) {day} AS n, ROUND(value - AVG(value) {day} - COALESCE(covar_samp(value, z) {day} / NULLIF(var_samp(z) {day}, 0), 0) * (z - AVG(z) {day}), 10) AS value FROM z), e5 AS (SELECT * FROM e WHERE n >= 5)"""
    put("orth_ic_small_pool", orth, f"SELECT factor, date, {r('ic', 'ic')} FROM ({_spearman('e5', 'factor, date')}) WHERE ic IS NOT NULL")
    put("weights", _held(), f"SELECT factor, date, ticker, side, {r('weight', 'weight')}, {r('label', 'label')} FROM held")
    put("turnover", _daily(), f"SELECT factor, date, {r('turnover', 'turnover')} FROM turn")
    put("benchmark", _daily(), f"SELECT date, {r('benchmark_return', 'benchmark_return')} FROM bench")
    run = "OVER (PARTITION BY factor ORDER BY date ROWS UNBOUNDED PRECEDING)"
    put("backtest_returns", _daily(), f"SELECT factor, date, {rs(['long_return', 'short_leg_return', 'turnover', 'benchmark_return', 'cost', 'spread_return', 'long_excess_return'])}, top_count, bottom_count, {', '.join(_compounded(f'product(1 + {c}) {run} - 1', 'cumulative_' + c) for c in ('long_return', 'spread_return', 'benchmark_return', 'long_excess_return'))} FROM daily")
    put("drawdown", _daily(), f"SELECT factor, date, {_compounded('equity', 'equity')}, {_compounded(f'(equity / MAX(equity) {run} - 1)', 'drawdown')} FROM (SELECT factor, date, product(1 + long_excess_return) {run} AS equity FROM daily WHERE long_excess_return IS NOT NULL)")
    catalog_products = {"total_return", "max_drawdown", "calmar", "excess_total_return", "excess_max_drawdown", "long_total_return", "benchmark_total_return", "long_excess_total_return"}
    main = ["total_return", "annualized_return", "annualized_volatility", "hit_rate", "downside_volatility", "information_ratio", "max_drawdown", "calmar"]
    metrics = f"""SELECT a.*, benchmark_beta, benchmark_correlation, x.total_return AS excess_total_return, x.information_ratio AS excess_information_ratio, x.max_drawdown AS excess_max_drawdown, long_total_return, benchmark_total_return, long_excess_total_return, average_turnover, average_cost
      FROM {_metrics('spread_return')} a JOIN {_metrics('long_excess_return')} x USING (factor) JOIN (SELECT factor, covar_samp(long_return, benchmark_return) / NULLIF(var_samp(benchmark_return), 0) AS benchmark_beta, covar_samp(long_return, benchmark_return) / NULLIF(stddev_samp(long_return) * stddev_samp(benchmark_return), 0) AS benchmark_correlation,
      product(1 + long_return) - 1 AS long_total_return, product(1 + benchmark_return) - 1 AS benchmark_total_return, product(1 + long_excess_return) - 1 AS long_excess_total_return, AVG(turnover) AS average_turnover, AVG(cost) AS average_cost FROM daily GROUP BY factor) USING (factor)"""
    more = ["benchmark_beta", "benchmark_correlation", "excess_total_return", "excess_information_ratio", "excess_max_drawdown", "long_total_return", "benchmark_total_return", "long_excess_total_return", "average_turnover", "average_cost"]
    put("backtest_metrics", _daily(), f"SELECT factor, periods, {', '.join(_compounded(c, c, 5) if c in catalog_products else r(c, c, 5) for c in [*main, *more])} FROM ({metrics})")
    profile = """SELECT factor, SUM(there) * 1.0 / SUM(n) AS coverage, COUNT(*) FILTER (u >= 5) AS active_days, CAST(median(u) AS DOUBLE) AS median_daily_unique, SUM(a) / SUM(there) AS mean_abs
      FROM (SELECT factor, date, COUNT(*) AS n, COUNT(value) AS there, COUNT(DISTINCT value) AS u, SUM(ABS(value)) AS a FROM long GROUP BY 1, 2) GROUP BY factor"""
    put("factor_profile", _long(), f"SELECT factor, {rs(['coverage', 'median_daily_unique', 'mean_abs'])}, active_days FROM ({profile})")
    put("discovery", _ic(), f"SELECT factor, {rs(['coverage', 'median_daily_unique', 'mean_abs', 'mean_ic', 'ic_std', 'ic_ir', 'positive_ic_rate'])}, active_days, days, {r('ABS(mean_ic) + 0.25 * ABS(ic_ir) + 0.1 * ABS(positive_ic_rate - 0.5)', 'discovery_score')} FROM ({profile}) LEFT JOIN ({_STATS}) USING (factor)")
    states = ["kline_return_state", "kline_range_state", "kline_volume_state", "kline_close_location_state", "kline_token"]
    put("kline_states", _KLINE, f"SELECT ticker, date, {', '.join(states)} FROM k")
    put("kline_top_tokens", _KLINE, "SELECT kline_token, COUNT(*) AS n FROM k WHERE kline_token NOT LIKE '%missing%' GROUP BY 1 ORDER BY n DESC, kline_token LIMIT 24")
    seq = f"""{_KLINE}, k1 AS (SELECT *, CASE WHEN kline_token NOT LIKE '%missing%' THEN kline_token END AS clean, ROW_NUMBER() OVER ({T}) AS rn,
      CASE WHEN kline_return_state IN ('up', 'strong_up') AND kline_volume_state IN ('high', 'extreme') THEN 1.0 ELSE 0.0 END AS bull,
      CASE WHEN kline_return_state IN ('up', 'strong_up') AND {lag('kline_return_state')} IN ('down', 'strong_down') THEN 1 ELSE 0 END AS turn FROM k)"""
    shown = []
    for d in (20, 60):
        seq += f""", k{d} AS (SELECT *, list_filter(list(clean) {w(d)}, lambda x: x IS NOT NULL) AS seen{d}, list_filter(list(clean) OVER ({T} ROWS BETWEEN {d - 1} PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL) AS hist{d},
      AVG(bull) {w(d)} AS bv{d}, SUM(turn) {w(d - 1)} / {d - 1}.0 AS rt{d} FROM k{1 if d == 20 else 20})"""
        part = f"(len(list_filter(seen{d}, lambda y: y = x)) * 1.0 / len(seen{d}))"
        entropy = f"-list_sum(list_transform(list_distinct(seen{d}), lambda x: {part} * ln({part}))) / ln(LEAST(len(seen{d}), 240))"
        similar = f"len(list_filter(hist{d}, lambda x: x = clean)) * 1.0 / NULLIF(len(hist{d}), 0)"
        shown += [
            r(f"CASE WHEN rn >= {d} AND len(seen{d}) >= 2 THEN {entropy} END", f"alpha_kline_state_entropy_{d}d"),
            r(f"CASE WHEN rn >= {d} THEN bv{d} END", f"alpha_kline_bull_volume_ngram_{d}d"),
            r(f"CASE WHEN rn >= {d} THEN rt{d} END", f"alpha_kline_reversal_transition_{d}d"),
            r(f"CASE WHEN rn >= {d} AND clean IS NOT NULL THEN {similar} END", f"alpha_kline_path_similarity_{d}d"),
        ]
    put("kline_sequences", seq, f"SELECT ticker, date, {', '.join(shown)} FROM k60")
    events = {
        "return_up_20": "CASE WHEN kline_return_state <> 'missing' THEN CAST(kline_return_state = 'up' AS INTEGER) END",
        "up_to_down_20": f"CASE WHEN kline_return_state <> 'missing' AND {lag('kline_return_state')} <> 'missing' THEN CAST({lag('kline_return_state')} = 'up' AND kline_return_state = 'down' AS INTEGER) END",
        "return_up_volume_normal_20": "CASE WHEN kline_return_state <> 'missing' AND kline_volume_state <> 'missing' THEN CAST(kline_return_state = 'up' AND kline_volume_state = 'normal' AS INTEGER) END",
    }
    put("kline_event_share", f"{_KLINE}, ev AS (SELECT ticker, date, {', '.join(f'{e} AS {k}' for k, e in events.items())} FROM k)", f"SELECT ticker, date, {', '.join(r(roll('AVG', k, 20, 10), k) for k in events)} FROM ev")
    raw = {"a": change("close"), "b": f"(open / NULLIF({lag('close')}, 0) - 1)", "c": "(close / NULLIF(open, 0) - 1)", "d": f"(high - low) / NULLIF({lag('close')}, 0)", "e": "ln(1 + volume)", "g": change("close", 5)}

    def z(x: str) -> str:
        return f"CASE WHEN COUNT({x}) {w(21)} >= 7 THEN GREATEST(LEAST(({x} - AVG({x}) {w(21)}) / NULLIF(STDDEV_SAMP({x}) {w(21)}, 0), 4), -4) END"

    def only(x: str, name: str) -> str:
        return r(f"CASE WHEN {x} IS NOT NULL THEN {z(x)} END", name)

    seen = dict(zip("abcde", latent.OBSERVATIONS[:5], strict=True))
    put("latent_observations", f"{BARS}, x AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in raw.items())} FROM bars)", f"SELECT ticker, date, {', '.join(only(k, nm) for k, nm in seen.items())}, {r(f'(close - low) / {_SPREAD} * 2 - 1', 'latent_close_location')}, {only('g', 'latent_trend_5d_z')} FROM x")
    life = ["price_scaled", "submitted_volume", "filled_volume", "canceled_volume", "aggressor_filled_volume", "passive_filled_volume", "remaining_volume"]
    put("l3_lifecycle", STREAMS, f"""SELECT wind_code, date, ex_order_id, side, session, {rs(life)}, filled_event_count, canceled_event_count, {r('COALESCE(filled_volume / NULLIF(submitted_volume, 0), 0)', 'fill_ratio')}, {r('COALESCE(canceled_volume / NULLIF(submitted_volume, 0), 0)', 'cancel_ratio')},
      {r('COALESCE(aggressor_filled_volume / NULLIF(filled_volume, 0), 0)', 'aggressor_fill_ratio')}, first_event_time_ms, last_event_time_ms, CAST(lifetime_ms AS DOUBLE) AS lifetime_ms, CAST(observed_lifetime_lower_bound_ms AS DOUBLE) AS observed_lifetime_lower_bound_ms, terminal_state FROM life""")
    put("l3_terminal_states", STREAMS, "SELECT terminal_state, COUNT(*) AS orders FROM life GROUP BY 1")
    put("l3_quality", STREAMS, f"""SELECT wind_code, date, orders, negative_remaining_orders, terminal_observed_orders, open_orders, {rs(['submitted_volume', 'filled_volume', 'canceled_volume', 'remaining_volume'])}, trades, fill_trades, cancel_events, {rs(['ask_fill_hit_rate', 'bid_fill_hit_rate', 'cancel_hit_rate'])}
      FROM (SELECT wind_code, date, COUNT(*) AS orders, COUNT(*) FILTER (remaining_volume < 0) AS negative_remaining_orders, COUNT(*) FILTER (closed) AS terminal_observed_orders, COUNT(*) FILTER (NOT closed) AS open_orders, SUM(submitted_volume) AS submitted_volume, SUM(filled_volume) AS filled_volume, SUM(canceled_volume) AS canceled_volume, SUM(remaining_volume) AS remaining_volume FROM life GROUP BY 1, 2)
      FULL JOIN (SELECT wind_code, date, COUNT(*) AS trades, COUNT(*) FILTER (NOT is_cancel) AS fill_trades, COUNT(*) FILTER (is_cancel) AS cancel_events FROM t GROUP BY 1, 2) USING (wind_code, date) FULL JOIN ({'SELECT * FROM ' + _hits('wind_code, date')}) USING (wind_code, date)""")
    put("semi_join_hits", STREAMS, f"SELECT wind_code, date, {rs(['ask_fill_hit_rate', 'bid_fill_hit_rate', 'cancel_hit_rate'])} FROM {_hits('wind_code, date')}")
    put("l3_quote_recon", STREAMS, f"""SELECT wind_code, date, {r('fv', 'trade_fill_volume')}, quote_rows, {rs(['quote_final_cum_volume', 'quote_positive_tick_volume', 'quote_positive_cum_diff_volume'])}, {r('fv - quote_final_cum_volume', 'trade_quote_volume_diff')}, {r('ABS(fv - quote_final_cum_volume)', 'trade_quote_volume_diff_abs')}, {r('ABS(fv - quote_final_cum_volume) / NULLIF(fv, 0)', 'trade_quote_volume_diff_ratio')}
      FROM (SELECT wind_code, date, SUM(volume) AS fv FROM t WHERE NOT is_cancel GROUP BY 1, 2) FULL JOIN (SELECT wind_code, date, COUNT(*) AS quote_rows, MAX(cum_volume) AS quote_final_cum_volume, SUM(volume) AS quote_positive_tick_volume, SUM(GREATEST(d, 0)) AS quote_positive_cum_diff_volume FROM (SELECT *, cum_volume - COALESCE(LAG(cum_volume) OVER (PARTITION BY wind_code, date ORDER BY time_ms), 0) AS d FROM q) GROUP BY 1, 2) USING (wind_code, date)""")

    def stream(x: str, name: str) -> str:
        return f"(SELECT date, COUNT(*) AS {name}_rows, COUNT(DISTINCT wind_code) AS {name}_stocks, COUNT(DISTINCT wind_code) FILTER (wind_code LIKE '%.SZ') AS {name}_sz_stocks, COUNT(DISTINCT wind_code) FILTER (wind_code LIKE '%.SH') AS {name}_sh_stocks FROM {x} GROUP BY 1)"

    put("l3_coverage", STREAMS, f"""SELECT * REPLACE ({rs(['ask_fill_hit_rate', 'bid_fill_hit_rate', 'cancel_hit_rate'])}) FROM {stream('o', 'order')} FULL JOIN {stream('t', 'trade')} USING (date)
      FULL JOIN (SELECT date, COUNT(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS common_stocks, COUNT(*) FILTER (b IS NULL) AS order_only_stocks, COUNT(*) FILTER (a IS NULL) AS trade_only_stocks FROM (SELECT DISTINCT wind_code, date, 1 AS a FROM o) FULL JOIN (SELECT DISTINCT wind_code, date, 1 AS b FROM t) USING (wind_code, date) GROUP BY 1) USING (date)
      LEFT JOIN (SELECT * FROM {_hits('date')}) USING (date)""")
    put("l3_aggressor", STREAMS, "SELECT aggressor_side_source, aggressor_side, COUNT(*) AS fills, SUM(volume) AS volume FROM fills GROUP BY 1, 2")
    put("l3_minute", MINUTES, f"SELECT wind_code, date, CAST(minute AS INTEGER) AS minute, session, {', '.join(_COUNTS)}, {rs([c for c in [*_ZEROED, *_NULLED, *_RATIOS] if c != 'trade_vwap_scaled'])}, {r('trade_vwap_scaled * (1 + 1e-11)', 'trade_vwap_scaled')} FROM m")
    diffs = ", ".join(f"{r(f'ABS({a} - {b})', k + '_diff_abs')}" for k, a, b in (("submit_volume", "ls", "m1"), ("submit_filled", "lf", "m2"), ("submit_canceled", "lc", "m3"), ("submit_remaining", "lr", "m4"), ("trade_volume", "tf", "m5"), ("cancel_event_volume", "tc", "m6")))
    bad = " + ".join(f"COUNT(*) FILTER ({c} < -1e-9 OR {c} > 1 + 1e-9)" for c in ("submit_fill_ratio", "submit_cancel_ratio", "submit_open_ratio"))
    off = " + ".join(f"COUNT(*) FILTER ({c} < -1 - 1e-9 OR {c} > 1 + 1e-9)" for c in ("submit_buy_sell_imbalance", "trade_active_imbalance", "cancel_buy_sell_imbalance"))
    put("l3_minute_quality", MINUTES, f"""SELECT wind_code, date, minute_rows, {r('tor', 'terminal_observed_rate')}, neg AS negative_remaining_orders, {diffs}, {r('ABS(tf - qv)', 'quote_trade_volume_diff_abs')}, ratio_out_of_bounds, imbalance_out_of_bounds, CAST(0 AS BIGINT) AS critical_nan_count, {rs(['missing_bs_flag_volume', 'inferred_aggressor_volume', 'unresolved_aggressor_volume'])},
      opening_auction_minutes, continuous_minutes, closing_auction_minutes, {rs(['max_submit_open_ratio', 'max_submit_cancel_ratio', 'max_submit_order_hhi'])}, CAST(fc AS BIGINT) AS failure_count, CAST(wc AS INTEGER) AS warning_count, CASE WHEN fc > 0 THEN 'fail' WHEN wc > 0 THEN 'review' ELSE 'pass' END AS gate_status, {r('COALESCE(unresolved_aggressor_volume / NULLIF(missing_bs_flag_volume, 0), 0)', 'unresolved_aggressor_ratio')}
      FROM (SELECT *, neg + ratio_out_of_bounds + imbalance_out_of_bounds + CAST(GREATEST(ABS(ls - m1), ABS(lf - m2), ABS(lc - m3), ABS(lr - m4), ABS(tf - m5), ABS(tc - m6), COALESCE(ABS(tf - qv), 0)) > 1e-9 AS INTEGER) AS fc, CAST(unresolved_aggressor_volume > 1e-9 AS INTEGER) AS wc FROM
      (SELECT * REPLACE (COALESCE(ls, 0) AS ls, COALESCE(lf, 0) AS lf, COALESCE(lc, 0) AS lc, COALESCE(lr, 0) AS lr, COALESCE(tf, 0) AS tf, COALESCE(tc, 0) AS tc, COALESCE(neg, 0) AS neg) FROM
      (SELECT wind_code, date, COUNT(*) AS minute_rows, SUM(submit_volume) AS m1, SUM(submit_filled_volume) AS m2, SUM(submit_canceled_volume) AS m3, SUM(submit_remaining_volume) AS m4, SUM(trade_volume) AS m5, SUM(event_cancel_volume) AS m6, {bad} AS ratio_out_of_bounds, {off} AS imbalance_out_of_bounds,
        SUM(trade_missing_bs_flag_volume) AS missing_bs_flag_volume, SUM(trade_inferred_aggressor_volume) AS inferred_aggressor_volume, SUM(trade_unresolved_aggressor_volume) AS unresolved_aggressor_volume, COUNT(*) FILTER (session = 'opening_auction') AS opening_auction_minutes, COUNT(*) FILTER (session = 'continuous') AS continuous_minutes, COUNT(*) FILTER (session = 'closing_auction') AS closing_auction_minutes,
        MAX(submit_open_ratio) AS max_submit_open_ratio, MAX(submit_cancel_ratio) AS max_submit_cancel_ratio, MAX(submit_order_hhi) AS max_submit_order_hhi FROM m GROUP BY 1, 2)
      LEFT JOIN (SELECT wind_code, date, SUM(submitted_volume) AS ls, SUM(filled_volume) AS lf, SUM(canceled_volume) AS lc, SUM(remaining_volume) AS lr, AVG(CAST(closed AS INTEGER)) AS tor, COUNT(*) FILTER (remaining_volume < 0) AS neg FROM life GROUP BY 1, 2) USING (wind_code, date)
      LEFT JOIN (SELECT wind_code, date, SUM(volume) FILTER (NOT is_cancel) AS tf, SUM(volume) FILTER (is_cancel) AS tc FROM t GROUP BY 1, 2) USING (wind_code, date)
      LEFT JOIN (SELECT wind_code, date, MAX(cum_volume) AS qv FROM q GROUP BY 1, 2) USING (wind_code, date)))""")
    put("l3_forward_returns", _forward(), f"SELECT wind_code, date, CAST(minute AS INTEGER) AS minute, {rs([f'future_return_{h}m' for h in (1, 3, 5)])} FROM fr")
    se = "std_ret_bps / sqrt(NULLIF(n, 0))"
    put("l3_state_screen", _screen(), f"SELECT hmm_state, horizon_min, n, {rs(['mean_ret_bps', 'std_ret_bps', 'pos_rate'], 4)}, {r(se, 'se_bps', 4)}, {r(f'mean_ret_bps / NULLIF({se}, 0)', 't', 4)} FROM sc")
    put("l3_state_spread", _screen(), f"SELECT a.horizon_min, a.hmm_state AS top_state, {r('a.mean_ret_bps', 'top_mean_ret_bps', 4)}, a.n AS top_n, b.hmm_state AS bottom_state, {r('b.mean_ret_bps', 'bottom_mean_ret_bps', 4)}, b.n AS bottom_n, {r('a.mean_ret_bps - b.mean_ret_bps', 'spread_bps', 4)} FROM (SELECT * FROM sc WHERE n > 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY horizon_min ORDER BY mean_ret_bps DESC, hmm_state) = 1) a JOIN (SELECT * FROM sc WHERE n > 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY horizon_min ORDER BY mean_ret_bps, hmm_state) = 1) b USING (horizon_min)")
    runs = f"{_forward()}, rr AS (SELECT wind_code, date, minute, hmm_state, CASE WHEN LAG(hmm_state) OVER (PARTITION BY wind_code, date ORDER BY minute) = hmm_state THEN 0 ELSE 1 END AS new FROM fr), r2 AS (SELECT *, SUM(new) OVER (PARTITION BY wind_code, date ORDER BY minute) AS run FROM rr)"
    put("l3_run_lengths", runs, "SELECT wind_code, date, CAST(run AS BIGINT) AS run, hmm_state, COUNT(*) AS length FROM r2 GROUP BY ALL")
    put("l3_cluster_share", _forward(), f"SELECT wind_code, date, hmm_state AS cluster, COUNT(*) AS minutes, {r('COUNT(*) * 1.0 / SUM(COUNT(*)) OVER (PARTITION BY wind_code, date)', 'share')} FROM fr GROUP BY 1, 2, 3")
    shards = f"{BARS}, old AS (SELECT ticker, date, close FROM bars WHERE year(date) <= 1998), new AS (SELECT ticker, date, close + 1 AS close FROM bars WHERE year(date) >= 1998)"
    put("upsert_latest", shards, f"SELECT ticker, date, {r('close', 'close')} FROM (SELECT * FROM new UNION ALL SELECT * FROM old ANTI JOIN new USING (ticker, date)) WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'")
    put("missing_window", shards, "SELECT ticker, first_date, last_date, first_date <= DATE '1995-01-02' AND last_date >= DATE '1999-06-30' AS covered, CASE WHEN first_date <= DATE '1995-01-02' AND last_date >= DATE '1999-06-30' THEN NULL WHEN first_date <= DATE '1995-01-02' THEN last_date + 1 ELSE DATE '1995-01-02' END AS missing_start FROM (SELECT ticker, MIN(date) AS first_date, MAX(date) AS last_date FROM old GROUP BY 1)")
    put("set_overlap", shards, "SELECT CASE WHEN a.ticker IS NULL THEN 'new_only' WHEN b.ticker IS NULL THEN 'old_only' ELSE 'common' END AS side, ticker FROM (SELECT DISTINCT ticker FROM old WHERE ticker < 15) a FULL JOIN (SELECT DISTINCT ticker FROM new WHERE ticker > 8) b USING (ticker)")
    put("training_frame", FACTORS, f"SELECT ticker, date, {rs(['momentum_5d', 'dollar_volume', 'future_return_5d'])} FROM (SELECT ticker, date, {lag('momentum_5d')} AS momentum_5d, {lag('dollar_volume')} AS dollar_volume, {_future(5)} AS future_return_5d FROM f) WHERE future_return_5d IS NOT NULL")
    put("walk_forward_splits", f"{BARS}, d AS (SELECT date, ROW_NUMBER() OVER (ORDER BY date) - 1 AS i, COUNT(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)), s AS (SELECT UNNEST(range(0, (SELECT MAX(n) FROM d) - 125 + 1, 20)) AS a)", "SELECT CAST(a // 20 AS INTEGER) AS fold, (SELECT date FROM d WHERE i = a) AS train_start, (SELECT date FROM d WHERE i = a + 99) AS train_end, (SELECT date FROM d WHERE i = a + 105) AS test_start, (SELECT date FROM d WHERE i = a + 124) AS test_end FROM s WHERE a + 125 <= (SELECT MAX(n) FROM d)")
    z_of = {c: "ln(1 + GREATEST({}, 0))" if c in regimes.LOG_FEATURES else "{}" for c in regimes.FEATURES}
    filled = ", ".join(f"COALESCE({c}, median({c}) OVER (), 0) AS {c}" for c in z_of)
    low = ", ".join(f"quantile_cont({c}, 0.01) AS a_{c}, quantile_cont({c}, 0.99) AS b_{c}" for c in z_of)
    values = ", ".join(f"{e.format(f'GREATEST(LEAST({c}, b_{c}), a_{c})')} AS v_{c}" for c, e in z_of.items())
    zs = ", ".join(r(f"(v_{c} - AVG(v_{c}) OVER ()) / COALESCE(NULLIF(STDDEV_POP(v_{c}) OVER (), 0), 1)", f"z_{c}", 5) for c in z_of)
    put("l3_standardize", f"{MINUTES}, mf AS (SELECT wind_code, date, minute, {filled} FROM m), lim AS (SELECT {low} FROM mf), v AS (SELECT wind_code, date, minute, {values} FROM mf, lim)", f"SELECT wind_code, date, CAST(minute AS INTEGER) AS minute, {zs} FROM v")
    return out
