"""Hand-made cases: branches that the derived tables don't reach, and operators without SQL."""

import datetime
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeline.operators import backtest, ledger, market, merge, normalize, risk, score, strategy
from tapeline.operators.indicators import latest, with_exact_indicators, with_indicators
from tapeline.sources import files
from tapeline.streaming import incremental

DAY = datetime.date(2024, 1, 1)
SCHEMA = "symbol string, trade_date date, open decimal(12,4), high decimal(12,4), low decimal(12,4), close decimal(12,4), volume bigint, amount decimal(24,2), turnover_rate decimal(10,4), adjust_type string"


def day(i):
    return DAY + datetime.timedelta(days=i)


def d(x):
    return Decimal(str(round(x, 4)))


def bars_of(spark, **symbols):
    """symbol=[(open, high, low, close), ...]"""
    rows = [(s, day(i), *map(d, row), 1_000_000 + 20_000 * i, Decimal(10**8), Decimal(2), "QFQ") for s, data in symbols.items() for i, row in enumerate(data)]
    return spark.createDataFrame(rows, SCHEMA)


def flat(n, price=10.0):
    return [(price, price, price, price)] * n


def rising(n=70):
    return [(c, c + 0.2, c - 0.2, c) for c in (10 + 0.08 * i for i in range(n))]


def test_rising_bars_give_a_signal(spark):
    row = strategy.multifactor_signals(bars_of(spark, A=rising(), B=rising(60))).collect()
    assert [r.symbol for r in row] == ["A"] and row[0].score >= 55 and "中短期趋势向上" in row[0].reasons


def test_indicators_against_pandas(spark):
    data = [(c, c * 1.02, c * 0.97, c) for c in (10 + (i * 37 % 11) * 0.3 + i * 0.01 for i in range(140))]
    got = {r.n: r for r in with_indicators(bars_of(spark, A=data)).collect()}
    df = pd.DataFrame(data, columns=["open", "high", "low", "close"]).round(4)
    diff = df.close.diff()
    gain, loss = diff.clip(lower=0), -diff.clip(upper=0)
    mean = lambda s: s.ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    rsi = (100 - 100 / (1 + mean(gain) / mean(loss))).fillna(100)
    before = df.close.shift(1)
    atr = mean(pd.concat([df.high - df.low, (df.high - before).abs(), (df.low - before).abs()], axis=1).max(axis=1))
    macd = df.close.ewm(span=12, adjust=False).mean() - df.close.ewm(span=26, adjust=False).mean()
    hist = macd - macd.ewm(span=9, adjust=False).mean()
    for n in range(140):
        assert got[n].rsi14 == pytest.approx(rsi[n]) and got[n].macd_hist == pytest.approx(hist[n], abs=1e-9)
        assert got[n].atr14 == (pytest.approx(atr[n]) if n >= 13 else None)


def test_rsi_edges(spark):
    bars = bars_of(spark, A=flat(15), B=rising(15), C=rising(14))
    got = {r.symbol: r.rsi for r in latest(with_exact_indicators(bars)).collect()}
    assert got == {"A": 100, "B": 100, "C": None}
    assert {r.rsi14 for r in with_indicators(bars).collect()} == {100.0}


def test_score_branches(spark):
    fields = {
        "close": 10.0, "ma5": 10.0, "ma10": 10.0, "ma20": 10.0, "ma60": 10.0, "rsi14": 40.0, "return5": 0.0, "return20": 0.0, "volume_ratio20": 1.0, "atr_pct": 6.0, "volatility20": 1.0, "drawdown20": -5.0,
        "macd_hist": 0.0, "prev_hist": 0.0, "turnover_rate": 0.0, "breakout20": False, "avg_amount20": 1e8, "day_return": 0.0, "limit_ups": 0,
    }
    cases = {
        "base": ({}, 45), "over": ({"rsi14": 79.0}, 37), "low": ({"rsi14": 30.0}, 40), "hot": ({"return20": 26.0}, 38), "flood": ({"volume_ratio20": 3.6}, 40), "trend": ({"close": 12.0, "ma20": 11.0}, 65),
        "fall": ({"close": 9.0, "ma20": 9.5}, 35), "atr": ({"atr_pct": 5.5}, 48), "wild": ({"atr_pct": 7.5}, 35), "limits": ({"limit_ups": 2, "day_return": 9.5}, 45),
    }
    rows = [tuple((fields | change | {"symbol": k}).values()) for k, (change, _) in cases.items()]
    got = {r.symbol: r for r in score.score_latest(spark.createDataFrame(rows, [*fields, "symbol"])).collect()}
    assert {k: r.score for k, r in got.items()} == {k: want for k, (_, want) in cases.items()}
    assert got["wild"].risk_level == "HIGH" and "ATR波动超过7%" in got["wild"].filter_reasons and "近20日涨幅超过25%，追高风险较大" in got["hot"].filter_reasons
    assert {"最新交易日接近涨停，不宜追价", "近5日出现多次涨停，短线波动过大"} <= set(got["limits"].filter_reasons)
    assert got["base"].bearish == ["价格尚未形成清晰的中期多头排列"] and got["trend"].bearish == [score.DEFAULT_BEARISH]


def test_backtest_branches(spark):
    lead = flat(20) + [(10.5, 10.5, 10.5, 10.5)]  # the signal closes above the mean
    tail = flat(9, 10.6)
    days = {
        "both": (10.0, 11.0, 9.0, 10.0), "take": (10.0, 11.0, 9.9, 10.9), "trail": (10.0, 10.7, 9.6, 10.2), "hold": (10.6, 10.6, 10.6, 10.6), "dear": (300.0, 300.0, 300.0, 300.0),
    }
    bars = bars_of(spark, **{k: [*lead, v, *(tail if k != "dear" else flat(9, 300.0))] for k, v in days.items()}, short=rising(29))
    got = {(r.symbol, r.n): r for r in backtest.backtest_trades(bars).collect()}
    assert {k: got[k, 20].reason for k in ("both", "take", "trail", "hold")} == {"both": "STOP_LOSS", "take": "TAKE_PROFIT", "trail": "TRAILING_STOP", "hold": "MAX_HOLD"}
    assert got["both", 20].exit_price == Decimal("9.5") and got["take", 20].exit_price == Decimal("10.8") and got["take", 20].exit_date == got["take", 20].entry_date
    assert got["take", 20].quantity == 2000 and ("dear", 20) not in got
    summary = {r.symbol: r for r in backtest.backtest_summary(bars).collect()}
    assert "short" not in summary and summary["dear"].trade_count == 0 and summary["dear"].profit_loss_ratio == 0
    assert summary["take"].win_rate == 1.0 and summary["take"].profit_loss_ratio == pytest.approx(float(got["take", 20].pnl))
    assert [r.symbol for r in backtest.failed_symbols(spark.createDataFrame([("short",), ("none",), ("take",)], "symbol string"), bars).orderBy("symbol").collect()] == ["none", "short"]


def test_normalize_bars(spark):
    rows = [("A", "sina", str(day(i)), "10", "11", "9", "10", "100", "0.5", i) for i in range(80)]
    rows += [("A", "sina", str(day(79)), "10", "11", "9", "10.5", "100", "0.5", 99), ("A", "sina", "bad", "10", "11", "9", "10", "100", "0.5", 1), ("A", "sina", str(day(200)), "x", "11", "9", "10", "100", "0.5", 1)]
    rows += [("B", "other", str(day(i)), "10", "11", "9", "10", "100", "0.5", i) for i in range(79)]
    raw = spark.createDataFrame(rows, "symbol string, provider string, `日期` string, `开盘` string, high string, low string, close string, volume string, turnover string, seq int")
    got = normalize.normalize_bars(raw, sequence="seq").collect()
    assert len(got) == 80 and {r.symbol for r in got} == {"A"} and {r.turnover_rate for r in got} == {50.0} and {r.amount for r in got} == {0.0}
    assert max(got, key=lambda r: r.trade_date).close == 10.5
    with pytest.raises(ValueError, match="low"):
        normalize.normalize_bars(raw.drop("low"), sequence="seq")
    tencent = raw.drop("volume").withColumn("amount", F.lit("7")).withColumn("provider", F.lit("tencent"))
    assert {(r.volume, r.amount) for r in normalize.normalize_bars(tencent, sequence="seq").collect()} == {(7.0, 0.0)}


def test_normalize_universe(spark):
    raw = spark.createDataFrame([(" 1.0", "平安"), ("600001", "*ST x"), ("600002", "y退"), ("600003", " "), ("300001", "z"), ("abc", "q"), ("600003", None)], "`代码` string, `名称` string")
    got = {r.symbol: r for r in normalize.normalize_universe(raw).collect()}
    assert set(got) == {"000001", "600001", "600002", "600003"}
    assert got["600001"].is_st and got["600002"].is_st and not got["600002"].is_active and got["600003"].name == "600003" and got["000001"].exchange == "SZ"
    assert [r.symbol for r in normalize.active_universe(normalize.normalize_universe(raw)).collect()] == ["000001", "600003"]


def test_universe_headers(spark):
    """The first known header counts, in the order of the list; both a code and a name are needed."""
    raw = spark.createDataFrame([("600001", "600002", "600003", "a", "b")], "`代码` string, `A股代码` string, `证券代码` string, `A股简称` string, `名称` string")
    assert [(r.symbol, r.name) for r in normalize.normalize_universe(raw).collect()] == [("600003", "a")]
    assert [(r.symbol, r.name) for r in normalize.normalize_universe(raw.drop("证券代码", "A股简称")).collect()] == [("600002", "b")]
    for gone in (["名称", "A股简称"], ["代码", "A股代码", "证券代码"]):
        with pytest.raises(ValueError, match="codes or names"):
            normalize.normalize_universe(raw.drop(*gone))
    with pytest.raises(ValueError, match="left"):
        normalize.require_rows(normalize.normalize_universe(raw.where("false")))


def test_long_tails(spark):
    data = [(c, c, c, c) for c in (10 + (i * 37 % 11) * 0.3 for i in range(3000))]
    got = latest(with_indicators(bars_of(spark, A=data, B=flat(3000)), 3000)).orderBy("symbol").collect()
    close = pd.Series([x[3] for x in data]).round(4)
    macd = close.ewm(span=12, adjust=False).mean() - close.ewm(span=26, adjust=False).mean()
    assert got[0].macd_hist == pytest.approx((macd - macd.ewm(span=9, adjust=False).mean()).iloc[-1], abs=1e-9)
    assert got[1].ema12 == pytest.approx(10) and got[1].macd_hist == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError, match="3000"):
        with_indicators(bars_of(spark, A=flat(2)), 3001)


def test_position_highs(spark):
    """A holding that was closed and opened anew counts from its second opening on."""
    rows = [(1, 1, "A", "BUY", 100, d(20), day(0)), (2, 1, "A", "SELL", 100, d(11), day(2)), (3, 1, "A", "BUY", 100, d(12), day(3)), (4, 1, "A", "BUY", 100, d(13.5), day(4)), (5, 1, "Z", "BUY", 100, d(7), day(1))]
    fills = ledger.replay(spark.createDataFrame(rows, ORDER))
    bars = bars_of(spark, A=[(c, c, c, c) for c in (30, 29, 28, 12, 13, 14, 13)])
    got = {r.symbol: (r.opened, r.highest_price) for r in ledger.position_highs(fills, bars).collect()}
    assert got == {"A": (day(3), d(14)), "Z": (day(1), d(7))}


ORDER = "order_id long, account_id long, symbol string, side string, quantity int, price decimal(18,4), trade_date date"


def test_ledger_by_hand(spark):
    rows = [(1, 1, "A", "BUY", 1000, d(10), day(0)), (2, 1, "A", "SELL", 500, d(11), day(0)), (3, 1, "A", "BUY", 1000, d(12), day(1)), (4, 1, "A", "SELL", 1000, d(13), day(2)), (5, 1, "A", "SELL", 1000, d(13), day(3)), (6, 1, "A", "BUY", 150, d(1), day(4)), (7, 1, "A", "BUY", 100, d(0), day(4))]
    orders = spark.createDataFrame(rows, ORDER)
    got = {r.order_id: r for r in ledger.replay(orders).collect()}
    assert [got[i].status for i in range(1, 8)] == ["FILLED", "OVERSELL", "FILLED", "FILLED", "FILLED", "BAD_LOT", "BAD_PRICE"]
    # 10000 + 5 + 0.1, then 12000 + 5 + 0.12
    assert got[1].net == Decimal("10005.10") and got[1].average_cost == Decimal("10.0051") and got[3].average_cost == Decimal("11.0051")
    assert got[4].net == Decimal("13000") - Decimal("5") - Decimal("6.50") - Decimal("0.13") and got[4].realized == got[4].net - Decimal("11005.10")
    assert got[5].held == 0 and got[5].average_cost == 0 and ledger.positions(ledger.replay(orders)).count() == 0
    cash = ledger.cash_flow(ledger.replay(orders), "50000").first()
    assert cash.cash == 50000 - got[1].net - got[3].net + got[4].net + got[5].net


def test_purchase_gate(spark):
    """One request for each way to be refused, and one that may stand."""
    cash = spark.createDataFrame([(1, d(1000))], "account_id long, cash decimal(20,2)")
    held = spark.createDataFrame([(1, "A", d(100)), (1, "B", d(300))], "account_id long, symbol string, market_value decimal(20,2)")
    order = "order_id long, account_id long, symbol string, side string, quantity int, gross decimal(20,2), net decimal(20,2), status string"
    rows = [(1, 1, "C", "BUY", 100, d(90), d(95), "PENDING_CONFIRM"), (2, 1, "A", "SELL", 100, d(90), d(85), "PENDING_CONFIRM"), (3, 1, "D", "BUY", 100, d(90), d(95), "FILLED")]
    frozen = ledger.with_freezes(spark.createDataFrame(rows, order))
    assert [(r.frozen_amount, r.frozen_quantity) for r in frozen.orderBy("order_id").collect()] == [(95, 0), (0, 100), (0, 0)]
    assert ledger.available_cash(cash, frozen).first().available_cash == 905
    wanted = [("A", 906, 906), ("C", 10, 15), ("D", 10, 15), ("B", 10, 15), ("A", 180, 185), ("A", 181, 186)]
    requests = spark.createDataFrame([(i, 1, s, "BUY", 100, d(g), d(n), "NEW") for i, (s, g, n) in enumerate(wanted)], order)
    got = {r.order_id: r.refused for r in ledger.gate_purchases(requests, cash, held, frozen, max_positions=3).collect()}
    assert got == {0: "NO_CASH", 1: "PENDING", 2: "MAX_POSITIONS", 3: "MAX_WEIGHT", 4: None, 5: "MAX_WEIGHT"}
    assert ledger.gate_purchases(requests, cash, held, frozen, max_positions=4).where("order_id = 2").first().refused is None


def test_equity_curve(spark):
    rows = [(1, 1, "A", "BUY", 100, d(20), day(0)), (2, 1, "Z", "BUY", 100, d(5), day(2)), (3, 1, "A", "SELL", 100, d(11), day(3))]
    fills = ledger.replay(spark.createDataFrame(rows, ORDER))
    bars = bars_of(spark, A=[(c, c, c, c) for c in (20, 21, 22, 23)])
    got = ledger.equity_curve(fills, bars, "10000").collect()
    # bought for 2005.02, Z has no bars and counts at its cost
    assert [(r.trade_date, r.market_value, r.positions) for r in got] == [(day(0), 2000, 1), (day(2), d(2200) + d(505.01), 2), (day(3), d(505.01), 1)]
    assert [r.total_asset for r in got] == [r.cash + r.market_value for r in got] and got[0].total_return == pytest.approx(-0.000502)


def test_plans_view_and_metrics(spark):
    plans = spark.createDataFrame([(1, "A", "ACTIVE"), (2, "B", "CLOSED"), (3, "A", "CLOSED")], "plan_id long, symbol string, status string")
    latest_ = spark.createDataFrame([("A", d(3), day(1))], "symbol string, latest_price decimal(18,4), latest_date date")
    view = lambda **k: sorted((r.plan_id, r.latest_price) for r in market.plans_view(plans, latest_, **k).collect())
    assert view(n=2) == [(2, None), (3, d(3))] and view(status="active") == [(1, d(3))] and len(view(status=" ")) == len(view(status="all")) == 3
    columns = "metrics string, return_5_pct decimal(18,4), return_20_pct decimal(18,4), rsi14 decimal(18,4), atr14_pct decimal(18,4), volume_ratio20 decimal(18,4), breakout20 boolean"
    rows = [('{"return5Pct": 1.5, "rsi14": 40, "breakout20": true}', None, None, d(50), None, None, None), ('{"return5Pct": 1.5', None, None, None, None, None, None), (None, d(2), None, None, None, None, False)]
    got = market.fill_from_metrics(spark.createDataFrame(rows, columns)).collect()
    assert [(r.return_5_pct, r.rsi14, r.breakout20) for r in got] == [(d(1.5), 50, True), (None, None, None), (2, None, False)]


def test_cancellations(spark):
    orders = spark.createDataFrame([(1, 7, "PENDING_CONFIRM", Decimal(5), 100), (2, 7, "FILLED", Decimal(5), 100), (3, 8, "PENDING_CONFIRM", Decimal(5), 100)], "order_id long, plan_id long, status string, frozen_amount decimal(20,2), frozen_quantity int")
    plans = spark.createDataFrame([(7, "ACTIVE"), (8, "OPEN")], "plan_id long, status string")
    new, left = ledger.cancel_plans(plans, orders, spark.createDataFrame([(7,)], "plan_id long"))
    assert {r.plan_id: r.status for r in new.collect()} == {7: "CANCELLED", 8: "OPEN"}
    assert {r.order_id: (r.status, r.frozen_quantity) for r in left.collect()} == {1: ("CANCELLED", 0), 2: ("FILLED", 100), 3: ("PENDING_CONFIRM", 100)}


def test_risk_events_and_resolution(spark):
    kind = "account_id long, symbol string, last_price decimal(18,4), average_cost decimal(18,4), highest_price decimal(18,4), stop_loss decimal(18,4), target_price decimal(18,4), trailing_pct decimal(8,4)"
    rows = [(1, "A", d(9), d(10), d(12), d(9), d(8.5), None), (1, "B", None, d(10), None, None, None, None), (1, "C", d(10), d(10), d(10), None, None, None)]
    events = risk.check_risk(spark.createDataFrame(rows, kind), F.lit("2024-01-01"))
    assert {(r.symbol, r.event_type) for r in events.collect()} == {("A", "STOP_LOSS"), ("A", "TAKE_PROFIT"), ("A", "TRAILING_STOP"), ("B", "DATA_MISSING")}
    done = risk.resolve(events, events.where("symbol = 'B'"))
    again = merge.upsert_keeping(done, events, ["event_key"], {"resolved": False})
    assert {r.event_key: r.resolved for r in again.collect()} == {r.event_key: r.resolved for r in done.collect()} and again.where("resolved").count() == 1


def test_merges(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, o int")
    delta = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, o int")
    rows = lambda df: sorted((r.k, r.v) for r in df.collect())
    assert rows(merge.upsert(base, delta, ["k"], "o")) == [(1, "a"), (2, "y"), (3, "z")]
    assert [k for k, _ in rows(merge.insert_absent(base, delta, ["k"]))] == [1, 2, 3]
    assert rows(merge.replace_where(base, F.col("k") == 2, delta.where("k = 3"))) == [(1, "a"), (3, "z")]


def test_tasks_and_failures(spark):
    tasks = spark.createDataFrame([(1, "COMPLETED", True), (2, "COMPLETED", False), (3, "RUNNING", True)], "id int, status string, official boolean")
    assert market.latest_official(tasks).first().id == 1 and market.latest_official(tasks.where("not official")).first().id == 2 and market.latest_task(tasks).first().id == 3
    failures = spark.createDataFrame([(1, "A", None, 0, False), (1, "B", "n", 0, True), (2, "A", None, 0, False)], "task_id int, symbol string, name string, retry_count int, resolved boolean")
    assert [r.symbol for r in market.retry_symbols(failures, 1).collect()] == ["A"]
    after = market.after_retry(failures, spark.createDataFrame([("A",), ("B",)], "symbol string"), 1)
    assert {(r.task_id, r.symbol): (r.retry_count, r.resolved) for r in after.collect()} == {(1, "A"): (1, True), (1, "B"): (0, True), (2, "A"): (0, False)}
    named = market.failures_with_names(failures, spark.createDataFrame([("A", "Alpha")], "symbol string, name string")).collect()
    assert [(r.symbol, r.name) for r in named] == [("A", "Alpha"), ("A", "Alpha"), ("B", "n")]


def test_history(spark):
    stored, fetched = bars_of(spark, A=rising(40)), bars_of(spark, A=rising(60))
    fresh = market.history(stored, fetched, "A", 30, day(41))
    stale = market.history(stored, fetched, "A", 30, day(60))
    assert fresh.agg(F.max("trade_date")).first()[0] == day(39) and stale.agg(F.max("trade_date")).first()[0] == day(59) and stale.count() == 30


def test_files(spark, tmp_path):
    bars = bars_of(spark, A=rising(5))
    files.write_csv_cache(bars, f"{tmp_path}/csv", "one")
    (tmp_path / "csv" / "bad.csv").write_text("symbol,trade_date,open,high,low,close,volume,amount,turnover_rate,adjust_type,data_source\nA,no,x,1,1,1,1,1,1,QFQ,one\n")
    assert files.read_csv_cache(spark, f"{tmp_path}/csv").count() == 5
    files.write_bars(bars, f"{tmp_path}/bars")
    plan = files.read_bars(spark, f"{tmp_path}/bars").where("month = '2024-01' and symbol = 'A'").select("close")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "PushedFilters: [IsNotNull(symbol), EqualTo(symbol,A)]" in plan


def test_stream_of_bars(spark, tmp_path):
    first, second = bars_of(spark, A=rising(5)), bars_of(spark, A=[(1.0, 1.0, 1.0, 1.0)] * 7)
    run = lambda: incremental.stream_bars(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    first.coalesce(1).write.parquet(f"{tmp_path}/in")
    run()
    second.where(F.col("trade_date") > F.lit(day(3))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    got = {r.trade_date: r.close for r in incremental.read_bars(spark, f"{tmp_path}/out", first.schema).collect()}
    assert len(got) == 7 and got[day(3)] == d(10.24) and got[day(4)] == got[day(6)] == 1
    counted = incremental.update_counters(first, second, spark.createDataFrame([("A",), ("Z",)], "symbol string")).orderBy("symbol").collect()
    assert [(r.bars, r.inserted_bars, r.failed) for r in counted] == [(7, 2, False), (0, 0, True)]


def test_ohlc_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "value")
    events.write.parquet(f"{tmp_path}/events")
    stream = incremental.ohlc(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"), late="1 hour")
    query = stream.writeStream.format("memory").queryName("ohlc_rows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(spark.table("ohlc_rows").collect()) == sorted(incremental.ohlc(events).collect())


def test_numbers_in_texts_round_as_printf(spark):
    from tapeline.functions.prices import shown, signed_percent

    values = [0.125, 0.375, 2.675, 1234567.005, -0.001, -3.125, 70.25, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", shown(F.col("x"), 2).alias("two"), shown(F.col("x"), 1).alias("one"), signed_percent(F.col("x")).alias("signed"))
    assert [tuple(r) for r in df.collect()] == [(v, f"{v:.2f}", f"{v:.1f}", f"{v:+.2f}%") for v in values]
