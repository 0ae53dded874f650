"""The ledger in event order: rules one by one, constant memory of folds, and the stream against the table."""

import datetime
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeline.operators import events as E
from tapeline.operators.folds import fold_sorted
from tapeline.sources.fixtures import account_events

SF = "/root/testdata/sf0.001"
DAY = datetime.date(2024, 1, 2)


def run(*events):
    """Outcomes of events given as (day, kind, values)."""
    account = E.Account()
    none = dict.fromkeys(("order_id", "plan_id", "symbol", "side", "quantity", "price", "latest", "stop_loss", "target_price", "weight"))
    return [account.apply(none | {"account_id": 1, "seq": i, "day": DAY + datetime.timedelta(day), "kind": kind} | values)[0] for i, (day, kind, values) in enumerate(events)]


def buy(i, symbol="600001", quantity=1000, price=100_000, **more):
    return {"order_id": i, "symbol": symbol, "side": "buy", "quantity": quantity, "price": price} | more


def sell(i, symbol="600001", quantity=1000, price=110_000):
    return {"order_id": i, "symbol": symbol, "side": "SELL", "quantity": quantity, "price": price}


def test_plan_life():
    plan = {"plan_id": 5, "symbol": "600001", "price": 100_000, "weight": 1000, "stop_loss": 95_000, "target_price": None}
    got = run((0, "PLAN", plan), (0, "PLAN", plan | {"plan_id": 6}), (0, "PLAN_ORDER", {"plan_id": 5, "order_id": 1}), (0, "CANCEL", {"order_id": 1}), (1, "PLAN_ORDER", {"plan_id": 5, "order_id": 2}),
              (1, "PLAN", plan | {"plan_id": 7}), (2, "CONFIRM", {"order_id": 2}), (2, "CANCEL_PLAN", {"plan_id": 5}), (3, "ORDER", sell(3, quantity=10_000)), (3, "CONFIRM", {"order_id": 3}), (3, "PLAN", plan | {"plan_id": 8}))
    assert [r["plan_status"] for r in got] == ["ACTIVE", "ACTIVE", "ORDER_CREATED", "ACTIVE", "ORDER_CREATED", "ORDER_CREATED", "OPEN", "OPEN", None, "CLOSED", "ACTIVE"]
    assert [r["reason"] for r in got] == [None, "KNOWN", None, None, None, "KNOWN", None, "PLAN_STATE", None, None, None] and got[1]["plan_id"] == 5
    assert got[2]["quantity"] == 10_000 and got[9]["realized"] > 0 and got[-1]["positions"] == 0 and got[-1]["frozen_cash"] == 0


def test_cancelled_plan_takes_its_order():
    got = run((0, "PLAN", {"plan_id": 5, "symbol": "600001", "price": 0, "weight": 0}), (0, "PLAN_ORDER", {"plan_id": 5, "order_id": 9, "latest": 50_000}), (0, "CANCEL_PLAN", {"plan_id": 5}), (0, "CONFIRM", {"order_id": 9}))
    assert got[1]["price"] == 50_000 and got[1]["quantity"] == 40_000 and got[1]["reason"] is None  # the first positive price, the default weight
    assert got[1]["frozen_cash"] > 0 and got[2]["frozen_cash"] == 0 and got[2]["also_cancelled"] == "9" and got[2]["plan_status"] == "CANCELLED" and got[3]["reason"] == "NOT_PENDING"


def test_gates_at_the_moment():
    fill = lambda i, s: [(0, "ORDER", buy(i, s)), (0, "CONFIRM", {"order_id": i})]
    five = [x for i in range(4) for x in fill(i, f"60000{i}")]
    got = run(*five, (0, "ORDER", buy(10, "600009")), (0, "ORDER", buy(11, "600008")), (0, "ORDER", buy(12, "600009")), (0, "CANCEL", {"order_id": 10}), (0, "ORDER", buy(13, "600008")), (0, "ORDER", buy(14, "600000", 20_000)), (0, "ORDER", sell(15, "600001")), (1, "ORDER", sell(16, "600001")), (1, "ORDER", sell(17, "600001", 100)), (1, "CANCEL", {"order_id": 16}), (1, "ORDER", sell(18, "600001", 100)))
    assert [r["reason"] for r in got[8:]] == [None, "MAX_POSITIONS", "PENDING", None, None, "MAX_WEIGHT", "OVERSELL", None, "OVERSELL", None, None]
    poor = run((0, "ORDER", buy(1, quantity=19_000)), (0, "ORDER", buy(2, "600002", 19_000)), (0, "ORDER", buy(3, "600003", 19_000)), (0, "ORDER", buy(4, "600004", 19_000)), (0, "ORDER", buy(5, "600005", 19_000)), (0, "ORDER", buy(6, "600006", 19_000)))
    assert [r["reason"] for r in poor] == [None] * 5 + ["NO_CASH"]


def test_state_holds_what_is_live():
    account = E.Account()
    none = dict.fromkeys(("order_id", "plan_id", "symbol", "side", "quantity", "price", "latest", "stop_loss", "target_price", "weight"))
    for i in range(3000):
        kind, more = [("PLAN", {"plan_id": i, "symbol": "600001", "price": 100_000, "weight": 500}), ("PLAN_ORDER", {"plan_id": i - 1, "order_id": i}), ("CANCEL_PLAN", {"plan_id": i - 2})][i % 3]
        account.apply(none | {"account_id": 1, "seq": i, "day": DAY, "kind": kind} | more)
    assert len(account.plans) == len(account.orders) == len(account.positions) == 0 and account.frozen == 0


def test_fold_of_a_long_key(spark):
    """A million rows of one key: the fold's process keeps its size, and the rows come in order."""

    def step(state, row):
        import resource

        if row["id"] <= state[0]:
            raise ValueError("out of order")
        state[0], state[1] = row["id"], state[1] + row["id"]
        peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        return [{"id": row["id"], "total": state[1], "peak": peak}] if row["id"] % 200_000 == 199_999 else []

    rows = spark.range(1_000_000).withColumn("k", F.lit(1)).repartition(7)
    schema = {"id": ("long", pa.int64()), "total": ("long", pa.int64()), "peak": ("long", pa.int64())}
    got = sorted(fold_sorted(rows, ["k"], ["id"], lambda _: [-1, 0], step, schema).collect())
    assert [r.total for r in got] == [n * (n + 1) // 2 for n in range(199_999, 1_000_000, 200_000)]
    assert got[-1].peak - got[0].peak < 20_000, "the process grew with the key"


def rows_of(df):
    columns = sorted(df.columns)
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("seed", [1])
def test_stream_equals_table(spark, tmp_path, seed):
    from tapeline.streaming.ledger import stream_ledger

    events = account_events(spark, SF).where("account_id < 3").cache()
    want = rows_of(E.ledger_in_order(events))
    held, source, out, checkpoint = events.collect(), f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    last = max(r.seq for r in held)
    rng = random.Random(seed)
    cuts = [0, *sorted(rng.sample(range(last), 4)), last]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # a restart for each part, some events delivered again
        part = [r for r in held if a < r.seq <= b or a - 5 < r.seq <= a]
        rng.shuffle(part)
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        query = stream_ledger(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    assert rows_of(spark.read.parquet(out)) == want
