"""Money of a back-test rounds by the value of the double, as its SQL does."""

import datetime as dt

import duckdb

from tapeline.operators.backtest import Rules, backtest_summary


def test_a_double_just_below_a_half_is_rounded_down(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    bars = spark.createDataFrame([("600000", d) for d in days], "symbol string, trade_date date").selectExpr(
        "*", *[f"cast(10 as decimal(12,4)) as {c}" for c in ("open", "high", "low", "close")], "1000L as volume", "cast(10000 as decimal(24,2)) as amount"
    )
    # 344240.63485 is 344240.63484999997... as a double; flat bars give no signal, so it stays the final capital
    capital = "344240.63485"
    (row,) = backtest_summary(bars, Rules(capital=capital)).collect()
    assert row.trade_count == 0
    assert row.final_capital == duckdb.sql(f"select round({capital}::double, 4)").fetchall()[0][0] == 344240.6348
