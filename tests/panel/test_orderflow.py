import pytest
from pyspark.sql import functions as F

from panelspark.operators import orderflow

ORDERS = "wind_code string, date int, time long, order_id long, ex_order_id long, order_code string, price double, volume double"
TRADES = "wind_code string, date int, time long, trade_id long, trade_code string, bs_flag string, price double, volume double, ask_order_id long, bid_order_id long"


def frames(spark):
    orders = spark.createDataFrame([("000001.SZ", 1, 93000000, 1, 101, "B", 100000.0, 1000.0), ("000001.SZ", 1, 93001000, 101, 202, "S", 100000.0, 600.0), ("000001.SZ", 1, 93002000, 3, 303, "S", 101000.0, 500.0)], ORDERS)
    trades = spark.createDataFrame([("000001.SZ", 1, 93001500, 1, "0", "B", 100000.0, 600.0, 202, 101), ("000001.SZ", 1, 93030000, 2, "C", "\x00", 0.0, 400.0, 0, 101)], TRADES)
    return orders, trades


def test_lifecycle(spark):
    orders, trades = frames(spark)
    got = {r.ex_order_id: r for r in orderflow.lifecycle(orders, trades).collect()}
    a = got[101]
    assert (a.terminal_state, a.filled_volume, a.canceled_volume, a.remaining_volume, a.aggressor_filled_volume) == ("PARTIAL_FILLED_CANCELED", 600, 400, 0, 600)
    assert a.lifetime_ms == 30000 and got[202].terminal_state == "FULLY_FILLED" and got[202].passive_filled_volume == 600
    assert got[303].terminal_state == "UNFILLED_OPEN" and got[303].lifetime_ms is None and got[303].observed_lifetime_lower_bound_ms == 0


def test_minutes_and_gates(spark):
    orders, trades = frames(spark)
    life = orderflow.lifecycle(orders, trades)
    quotes = spark.createDataFrame([("000001.SZ", 1, 93001500, 100000.0, 600.0, 600.0)], "wind_code string, date int, time long, price double, volume double, cum_volume double")
    minutes = orderflow.minute_features(life, trades, quotes)
    m = minutes.first()
    assert (m.minute, m.submit_volume, m.submit_buy_volume, m.submit_sell_volume, m.submit_filled_volume, m.submit_canceled_volume, m.submit_remaining_volume) == (570, 2100, 1000, 1100, 1200, 400, 500)
    assert m.trade_volume == 600 and m.event_cancel_volume == 400 and m.event_cancel_buy_volume == 400
    assert abs(m.submit_order_hhi - (1000**2 + 600**2 + 500**2) / 2100**2) < 1e-12
    assert abs(m.submit_buy_sell_imbalance + 100 / 2100) < 1e-12 and m.trade_active_imbalance == 1.0
    gate = orderflow.minute_quality(life, trades, minutes, quotes).first()
    assert gate.gate_status == "pass" and gate.submit_volume_diff_abs == 0 and gate.quote_trade_volume_diff_abs == 0
    broken = orderflow.minute_quality(life, trades, minutes.withColumn("submit_fill_ratio", F.lit(1.5)), quotes).first()
    assert broken.gate_status == "fail" and broken.ratio_out_of_bounds == 1


def test_aggressor_is_the_later_order(spark):
    orders, trades = frames(spark)
    unflagged = trades.where("trade_code = '0'").withColumn("bs_flag", F.lit(None).cast("string"))
    life = orderflow.lifecycle(orders, unflagged)
    row = orderflow.aggressors(unflagged, life).first()
    assert (row.aggressor_side, row.aggressor_side_source) == ("S", "order_time")
    m = orderflow.minute_features(life, unflagged).first()
    assert (m.trade_missing_bs_flag_volume, m.trade_inferred_aggressor_volume, m.trade_unresolved_aggressor_volume, m.trade_active_sell_volume) == (600, 600, 0, 600)


def test_forward_returns_skip_gaps_and_auctions(spark):
    rows = [("a", 1, 600, "continuous", 10.0), ("a", 1, 601, "continuous", 11.0), ("a", 1, 603, "continuous", 12.0), ("a", 1, 604, "closing_auction", 13.0)]
    df = spark.createDataFrame(rows, "wind_code string, date int, minute int, session string, quote_last_price_scaled double")
    got = {r.minute: (r.future_return_1m, r.future_return_3m) for r in orderflow.forward_returns(df, (1, 3)).collect()}
    assert got[600] == (pytest.approx(0.1), pytest.approx(0.2)) and got[601] == (None, None) and got[603] == (None, None)
    with pytest.raises(Exception, match="duplicate"):
        orderflow.forward_returns(df.unionByName(df)).collect()
