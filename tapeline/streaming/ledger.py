"""The ledger in event order over a stream: each account's live state is kept in Spark's state store, from batch to batch and over restarts."""

from __future__ import annotations

from dataclasses import astuple

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor

from ..operators.events import CAPITAL, MAX_POSITIONS, MAX_WEIGHT, OUTCOME, Account, Order, Plan, Position, scaled, unscaled

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MONEY = "cash long, frozen long, realized long, fees long, seq long"
_MAPS = {
    "plans": (Plan, "id long", "symbol string, status string, price long, weight long, stop_loss long, target_price long"),
    "orders": (Order, "id long", "symbol string, side string, quantity long, price long, plan_id long"),
    "positions": (Position, "symbol string", "quantity long, free long, cost long, price long, highest long, bought date, plan_id long, stop_loss long, target_price long"),
}


class Ledger(StatefulProcessor):
    """An ``Account`` for each key; plans, waiting orders and positions are a map each, of which only changed entries are written."""

    def __init__(self, limits: tuple[int, int, int]):
        self.limits = limits

    def init(self, handle) -> None:
        self.money = handle.getValueState("money", _MONEY)
        self.maps = {name: handle.getMapState(name, key, value) for name, (_, key, value) in _MAPS.items()}

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        account = Account(*self.limits)
        if self.money.exists():
            account.cash, account.frozen, account.realized, account.fees, account.seq = self.money.get()
        before = {}
        for name, (kind, *_) in _MAPS.items():
            entries = {k[0]: tuple(v) for k, v in self.maps[name].iterator()}
            before[name] = entries
            getattr(account, name).update((k, kind(*v)) for k, v in entries.items())
        for event in sorted((r.asDict() for r in rows), key=lambda r: r["seq"]):
            for outcome in account.apply(event):
                yield Row(**{c: outcome[c] for c in OUTCOME})
        self.money.update((account.cash, account.frozen, account.realized, account.fees, account.seq))
        for name, old in before.items():
            new = {k: astuple(v) for k, v in getattr(account, name).items()}
            for k in old.keys() - new.keys():
                self.maps[name].removeKey((k,))
            for k, v in new.items():
                if old.get(k) != v:
                    self.maps[name].updateValue((k,), v)

    def close(self) -> None:
        pass


def stream_ledger(events: DataFrame, capital: int = CAPITAL, max_positions: int = MAX_POSITIONS, max_weight: int = MAX_WEIGHT) -> DataFrame:
    """As ``events.ledger_in_order``, over a stream: outcomes of every event, in append mode.

    Events of an account may come in any order inside a micro-batch, but not after a later one of an earlier micro-batch: those, and
    events that are delivered again, have no outcome. The state is bounded by the account's limits. The session's state store becomes
    RocksDB's, which map states need.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    shape = ", ".join(f"{name} {kind}" for name, (kind, _) in OUTCOME.items())
    processor = Ledger((capital, max_positions, max_weight))
    found = scaled(events).groupBy("account_id").transformWithState(statefulProcessor=processor, outputStructType=shape, outputMode="Append", timeMode="None")
    return unscaled(found)
