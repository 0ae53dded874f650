"""Bars in buckets of symbols, and risk events of a stream of ticks against the same ticks as a table."""

import datetime
import random
from decimal import Decimal

from pyspark.sql import functions as F

from tapeline.operators import ledger, market, risk
from tapeline.operators.indicators import with_indicators
from tapeline.operators.normalize import normalize_universe
from tapeline.plans.scan import scan
from tapeline.sources import files
from tapeline.sources.fixtures import bars, order_feed, raw_universe
from tapeline.streaming import risk as stream

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_clustered_bars_need_no_shuffle(spark, tmp_path):
    own = bars(spark, SF)
    files.write_clustered(own, "clustered_bars", f"file://{tmp_path}/bars", buckets=5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table = spark.table("clustered_bars")
        for made in (with_indicators, lambda x: market.bars_tail(x, 50), market.latest_bars):
            text = plan(made(table))
            assert "Exchange" not in text and "Exchange" in plan(made(own)), text
        scanned = scan(table, normalize_universe(raw_universe(spark, SF)))
        assert "hashpartitioning(symbol" not in plan(scanned).split("rank_no")[-1] or plan(scanned).count("Exchange hashpartitioning(symbol") < plan(scan(own, normalize_universe(raw_universe(spark, SF)))).count("Exchange hashpartitioning(symbol")
        assert len(table.inputFiles()) == 5
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    columns = ["symbol", "rank_no", "score", "eligible", "latest_close"]
    assert same(scanned.select(columns), scan(own, normalize_universe(raw_universe(spark, SF))).select(columns))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema)
    spark.sql("drop table clustered_bars")  # the files stay
    again = files.open_clustered(spark, "opened_bars", f"file://{tmp_path}/bars", schema, 5)
    assert same(again, own)
    spark.sql("drop table opened_bars")


def test_months_in_several_files(spark, tmp_path):
    files.write_bars(bars(spark, SF), f"{tmp_path}/months", files=4)
    got = files.read_bars(spark, f"{tmp_path}/months")
    assert got.count() == bars(spark, SF).count() and got.where("month = '1995-06'").inputFiles()


def held(spark):
    p = Decimal
    rows = [(1, "A", p(10), p(10), p("9.5"), p("11"), None), (2, "A", p(8), p(12), p("7"), p("20"), p("0.1")), (1, "B", p(5), p(5), None, None, None), (3, "C", p(1), p(1), p(2), None, None)]
    return spark.createDataFrame(rows, "account_id long, symbol string, average_cost decimal(18,4), highest_price decimal(18,4), stop_loss decimal(18,4), target_price decimal(18,4), trailing_pct decimal(8,4)")


def test_stream_of_ticks(spark, tmp_path):
    """Late and repeated ticks, restarts, and events resolved in between."""
    rng = random.Random(6)
    start = datetime.datetime(2024, 3, 1, 9)
    ticks = [(rng.choice("ABX"), Decimal(rng.randint(400, 1300)) / 100, start + datetime.timedelta(minutes=rng.randint(0, 4000))) for _ in range(400)]
    kind = "symbol string, price decimal(18,4), tick_time timestamp"
    source, out, checkpoint = f"{tmp_path}/ticks", f"{tmp_path}/events", f"{tmp_path}/checkpoint"
    want = risk.check_ticks(spark.createDataFrame(ticks, kind), held(spark)).drop("resolved")
    assert want.count() > 10 and want.select("event_type").distinct().count() == 3
    resolved = None
    for i in range(4):  # files of ticks in no order of time, with repeats of earlier ones
        part = ticks[100 * i : 100 * i + 100] + rng.sample(ticks[: 100 * i + 1], min(20, 100 * i + 1))
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
        query = stream.stream_risk(spark.readStream.schema(kind).parquet(source), held(spark), out, checkpoint)
        query.awaitTermination()
        if i == 1:
            resolved = {r.event_key for r in stream.read_events(spark, out).orderBy("event_key").limit(3).collect()}
            assert stream.read_events(spark, out).where("resolved").isEmpty()
            stream.resolve_events(spark.createDataFrame([(k,) for k in resolved], "event_key string"), out)
    got = stream.read_events(spark, out)
    assert same(got.drop("resolved").select(want.columns), want)
    assert {r.event_key for r in got.where("resolved").collect()} == resolved


def test_merged_events_stay_resolved(spark):
    one = spark.createDataFrame([("k", 1, "A", "STOP_LOSS", "HIGH", "m", Decimal(5), Decimal(6), datetime.datetime(2024, 1, 2), True)], stream.EVENT)
    late = one.withColumns({"event_time": F.lit(datetime.datetime(2024, 1, 1)), "current_price": F.lit(4).cast("decimal(18,4)"), "resolved": F.lit(False)})
    new = one.withColumns({"event_time": F.lit(datetime.datetime(2024, 1, 3)), "current_price": F.lit(3).cast("decimal(18,4)"), "resolved": F.lit(False)})
    assert [(r.current_price, r.resolved) for r in stream.merge_events(one, late).collect()] == [(Decimal(5), True)]
    assert [(r.current_price, r.resolved) for r in stream.merge_events(one, new).collect()] == [(Decimal(3), True)]


def test_ticks_as_the_check_of_a_day(spark):
    """A tick a position is what the check of that day gives."""
    fills = ledger.replay(order_feed(spark, SF))
    marked = ledger.marked(ledger.positions(fills), market.latest_bars(bars(spark, SF))).where("not missing")
    levels = marked.withColumns({"stop_loss": F.col("average_cost") * 0.95, "target_price": F.col("average_cost") * 1.08, "highest_price": F.col("average_cost") * 1.2, "trailing_pct": F.lit(None).cast("decimal(8,4)")})
    day = F.lit("2024-01-05").cast("timestamp")
    ticks = marked.select("symbol", F.col("last_price").alias("price")).distinct().withColumn("tick_time", day)
    got = risk.check_ticks(ticks, levels).select("event_key", "event_type", "trigger_price")
    want = risk.check_risk(levels, F.to_date(day)).select("event_key", "event_type", "trigger_price")
    assert got.count() > 0 and same(got, want)
