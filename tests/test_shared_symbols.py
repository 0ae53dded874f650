"""Suppliers whose keys give one symbol: no bar of any of them is lost, and results don't depend on how rows come."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    """Bars of keys such as 1238, 1239, 12388 and 12389, which are all one symbol, and of 1273 and 12713, which have the same bars."""
    path = str(tmp_path_factory.mktemp("shared") / "lineitem.parquet")
    rows = spark.read.parquet(f"{DIR}/lineitem.parquet")
    own = rows.withColumn("l_suppkey", F.when(F.col("l_orderkey") % 2 == 0, F.col("l_suppkey") + 1230).otherwise(F.col("l_suppkey") + 12380))
    twice = rows.where("l_suppkey = 3").withColumn("l_suppkey", F.explode(F.array(F.lit(1273), F.lit(12713))))
    own.unionByName(twice.withColumn("l_suppkey", F.col("l_suppkey").cast("long"))).withColumn("l_suppkey", F.col("l_suppkey").cast(rows.schema["l_suppkey"].dataType)).write.parquet(path)
    return path


def from_sql(shared, sql):
    with duckdb.connect() as c:
        c.execute(f"create view lineitem as select * from read_parquet('{shared}/*.parquet')")
        for t in ("supplier", "orders"):
            c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
        found = c.execute(sql)
        return [x[0] for x in found.description], found.fetchall()


@pytest.mark.parametrize("name", ["bars_normalized", "bars_normalized_amount_only"])
def test_no_bar_of_a_shared_symbol_is_lost(spark, shared, name):
    got = entry.queries()[name](spark, shared.rsplit("/", 1)[0])
    columns, want = from_sql(shared, entry.oracle_sql()[name])
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)
    assert len({r[:3] for r in want}) < len(want)
    assert len(set(want)) < len(want)  # equal bars of two keys are two


PRICES = ("close", "high", "low", "open", "volume", "amount")
OF_BARS = ["analysis_metrics", "atr_simple", "atr_wilder", "averages_of_history", "avg_amount20", "backtest_exits", "backtest_signals", "backtest_summary", "backtest_trades", "bars_as_of"]


def in_whole_order(sql):
    """The SQL with an order for bars of one symbol and day, which it leaves open."""
    falling = sql.replace("partition by symbol order by trade_date desc", "partition by symbol order by TIED desc, " + ", ".join(f"{c} desc" for c in PRICES))
    rising = falling.replace("partition by symbol order by trade_date", "partition by symbol order by trade_date, " + ", ".join(PRICES))
    return rising.replace("TIED", "trade_date").replace("max_by(close, trade_date)", "max_by(close, row(trade_date, close))")


def plain(row):
    return tuple(x if x is None or isinstance(x, (str, bool)) or not hasattr(x, "__float__") else round(float(x), 6) + 0.0 for x in row)


@pytest.mark.parametrize("name", OF_BARS)
def test_bars_of_one_day_have_an_order(spark, shared, name):
    got = entry.queries()[name](spark, shared.rsplit("/", 1)[0])
    columns, want = from_sql(shared, in_whole_order(entry.oracle_sql()[name]))
    assert sorted((plain(r) for r in got.select(*columns).collect()), key=repr) == sorted(map(plain, want), key=repr)
    assert want


def test_upsert_keeps_every_bar_of_a_shared_symbol(spark, shared):
    """A bar whose symbol and day several suppliers have takes each one's new close, as the SQL's join does."""
    got = entry.queries()["bars_upsert"](spark, shared.rsplit("/", 1)[0])
    columns, want = from_sql(shared, in_whole_order(entry.oracle_sql()["bars_upsert"]))
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)
    assert len({r[:2] for r in want}) < len(want)


def test_corrections(spark):
    from tapeline.operators.merge import correct

    base = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3), (None, "d", 4)], "k int, x string, y int")
    delta = spark.createDataFrame([(1, "p"), (1, None), (3, "q"), (None, "r")], "k int, x string")
    got = sorted(map(tuple, correct(base, delta, ["k"]).collect()), key=repr)
    assert got == sorted([(1, "p", 1), (1, None, 1), (1, "p", 2), (1, None, 2), (2, "c", 3), (3, "q", None), (None, "d", 4), (None, "r", None)], key=repr)
    assert sorted(map(tuple, correct(base, delta.where("false"), ["k"]).collect()), key=repr) == sorted(map(tuple, base.collect()), key=repr)
