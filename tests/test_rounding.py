"""Doubles round by their own value, as the SQL's do, where shortest digits show a half that the value isn't."""

import duckdb

from tapeline.operators.ledger import marked
from tapeline.queries import rounded

#: As doubles, some are just below a half of the seventh digit, some above it, some so close that the product with 10^6 is one.
HALVES = [262.3133405, 256.8674675, 257.8031185, 129.7140365, 521.5251215, 0.1234565, 2.0000005, 5.0166945, -262.3133405, -129.7140365, 0.0, None]


def test_indicators_round_as_the_sql_does(spark):
    values = spark.createDataFrame([(i, x) for i, x in enumerate(HALVES)], "i int, x double")
    got = {r.i: r.x for r in values.select("i", *rounded("x")).collect()}
    assert got == {i: duckdb.execute("select round(?::double, 6)", [x]).fetchall()[0][0] for i, x in enumerate(HALVES)}
    assert got[0] == 262.31334


def test_rates_of_positions_round_as_the_sql_does(spark):
    held = spark.range(1, 200).selectExpr("format_string('%06d', id) as symbol", "100 as quantity", "cast(32 as decimal(18,4)) as average_cost", "cast(32 + id / 10000 as decimal(18,4)) as latest_price")
    rows = marked(held.drop("latest_price"), held).collect()
    want = {r.symbol: duckdb.execute("select round(?::double / 3200, 8)", [float(r.unrealized_pnl)]).fetchall()[0][0] for r in rows}
    assert {r.symbol: r.pnl_rate for r in rows} == want
    assert want["000003"] == 9.37e-06  # 0.03 / 3200 is a little less than 0.000009375
