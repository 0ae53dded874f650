"""The ledger in event order: what an account's plans, orders, positions and cash become, event by event.

Events of an account are a sequence: plans are made, orders are created by hand or from a plan, confirmed, cancelled, plans are cancelled and
prices are marked. An order waits until it is confirmed; till then a purchase freezes its amount and fees and a sale its shares, and
every gate is judged against the state at that moment. The state holds what is live only, plans, waiting orders and positions, so it is
bounded by the limits of an account and not by its history. The same ``Account`` runs over a table (``ledger_in_order``, a fold of sorted
partitions) and over a stream (``streaming.ledger``, keyed state).

Money counts in cents and prices in ten-thousandths here, as integers, so all arithmetic is exact; columns become decimals again outside.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold_sorted

# States of plans and orders, and the settings' defaults (rates in hundred-thousandths, weights in ten-thousandths).
ACTIVE, ORDER_CREATED, OPEN, CLOSED = "ACTIVE", "ORDER_CREATED", "OPEN", "CLOSED"
PENDING, FILLED, CANCELLED = "PENDING_CONFIRM", "FILLED", "CANCELLED"
COMMISSION, LEAST_COMMISSION, STAMP, TRANSFER = 30, 500, 50, 1
CAPITAL, MAX_POSITIONS, MAX_WEIGHT = 100_000_000, 5, 2000

EVENT = "account_id long, seq long, day date, kind string, order_id long, plan_id long, symbol string, side string, quantity int, price decimal(18,4), latest decimal(18,4), stop_loss decimal(18,4), target_price decimal(18,4), weight decimal(8,4)"
_SCALED = {"price": 10_000, "latest": 10_000, "stop_loss": 10_000, "target_price": 10_000, "weight": 10_000}
_MONEY = ("net", "realized", "cash", "frozen_cash", "market_value", "realized_pnl", "total_fees")
OUTCOME = {
    **{c: ("long", pa.int64()) for c in ("account_id", "seq")}, "day": ("date", pa.date32()), "kind": ("string", pa.string()), **{c: ("long", pa.int64()) for c in ("order_id", "plan_id")}, "symbol": ("string", pa.string()),
    **{c: ("string", pa.string()) for c in ("reason", "order_status", "plan_status", "also_cancelled")}, **{c: ("long", pa.int64()) for c in ("quantity", "price", *_MONEY, "positions")},
}


def half_up(value: int, unit: int) -> int:
    """value / unit, rounded half away from zero."""
    whole = (2 * abs(value) + unit) // (2 * unit)
    return whole if value >= 0 else -whole


def amount(price: int, quantity: int) -> int:
    return half_up(price * quantity, 100)


def fees(side: str, gross: int) -> int:
    stamp = half_up(gross * STAMP, 100_000) if side == "SELL" else 0
    return max(half_up(gross * COMMISSION, 100_000), LEAST_COMMISSION) + stamp + half_up(gross * TRANSFER, 100_000)


@dataclass
class Plan:
    symbol: str
    status: str
    price: int
    weight: int
    stop_loss: int | None
    target_price: int | None


@dataclass
class Order:
    symbol: str
    side: str
    quantity: int
    price: int
    plan_id: int | None

    @property
    def gross(self) -> int:
        return amount(self.price, self.quantity)

    @property
    def net(self) -> int:
        cost = fees(self.side, self.gross)
        return self.gross + cost if self.side == "BUY" else self.gross - cost


@dataclass
class Position:
    quantity: int
    free: int
    cost: int
    price: int
    highest: int
    bought: date
    plan_id: int | None
    stop_loss: int | None
    target_price: int | None


class Account:
    """One account's live state; ``apply`` takes an event and tells what came of it."""

    def __init__(self, cash: int = CAPITAL, max_positions: int = MAX_POSITIONS, max_weight: int = MAX_WEIGHT):
        self.cash, self.frozen, self.realized, self.fees, self.seq = cash, 0, 0, 0, None
        self.max_positions, self.max_weight = max_positions, max_weight
        self.plans: dict[int, Plan] = {}
        self.orders: dict[int, Order] = {}
        self.positions: dict[str, Position] = {}

    def market_value(self) -> int:
        return sum(amount(p.price, p.quantity) for p in self.positions.values())

    def waiting(self, symbol: str, side: str) -> list[Order]:
        return [o for o in self.orders.values() if o.symbol == symbol and o.side == side]

    def apply(self, e: dict) -> list[dict]:
        """The outcome of an event, one row; none if the event or a later one was seen before, so a repeated delivery changes nothing."""
        if self.seq is not None and e["seq"] <= self.seq:
            return []
        self.seq = e["seq"]
        for symbol, own in self.positions.items():
            if own.bought < e["day"]:  # shares bought on a day are free from the next one on, but for those in waiting sales
                own.free = own.quantity - sum(o.quantity for o in self.waiting(symbol, "SELL"))
        done = {c: e[c] for c in ("account_id", "seq", "day", "kind", "order_id", "plan_id", "symbol", "quantity", "price")}
        done |= {"net": 0, "realized": 0, "reason": None, "order_status": None, "also_cancelled": ""}
        done["reason"] = {"PLAN": self._plan, "ORDER": self._order, "PLAN_ORDER": self._plan_order, "CONFIRM": self._confirm, "CANCEL": self._cancel, "CANCEL_PLAN": self._cancel_plan, "MARK": self._mark}[e["kind"]](e, done)
        plan = self.plans.get(done["plan_id"])
        self._forget(done["plan_id"], plan)
        return [
            done | {"plan_status": plan and plan.status, "cash": self.cash, "frozen_cash": self.frozen, "market_value": self.market_value(), "realized_pnl": self.realized, "total_fees": self.fees, "positions": len(self.positions)}
        ]

    def _forget(self, plan_id, plan):
        """A plan that ended goes, once no order and no position names it."""
        if plan and plan.status in (CLOSED, CANCELLED) and not any(x.plan_id == plan_id for x in (*self.orders.values(), *self.positions.values())):
            del self.plans[plan_id]

    def _plan(self, e, done):
        live = [i for i, p in self.plans.items() if p.symbol == e["symbol"] and p.status in (ACTIVE, ORDER_CREATED, OPEN)]
        if live:
            done["plan_id"] = max(live)
            return "KNOWN"
        self.plans[e["plan_id"]] = Plan(e["symbol"], ACTIVE, e["price"] or 0, e["weight"] or 0, e["stop_loss"], e["target_price"])

    def _order(self, e, done):
        side = (e["side"] or "").upper()
        if side not in ("BUY", "SELL"):
            return "BAD_SIDE"
        if (e["quantity"] or 0) <= 0 or e["quantity"] % 100:
            return "BAD_LOT"
        if (e["price"] or 0) <= 0:
            return "BAD_PRICE"
        order = Order(e["symbol"], side, e["quantity"], e["price"], e["plan_id"])
        done["net"] = order.net
        refused = self._gate(order) if side == "BUY" else self._reserve(order)
        if refused:
            return refused
        if side == "BUY":
            self.frozen += order.net
        self.orders[e["order_id"]] = order
        done["order_status"] = PENDING

    def _gate(self, order) -> str | None:
        """Why a purchase may not be ordered now."""
        waiting = self.waiting(order.symbol, "BUY")
        if self.cash - self.frozen < order.net:
            return "NO_CASH"
        if waiting:
            return "PENDING"
        if order.symbol not in self.positions and len(self.positions.keys() | {o.symbol for o in self.orders.values() if o.side == "BUY"}) >= self.max_positions:
            return "MAX_POSITIONS"
        own = self.positions.get(order.symbol)
        if 10_000 * ((amount(own.price, own.quantity) if own else 0) + order.gross) > (self.cash + self.market_value()) * self.max_weight:
            return "MAX_WEIGHT"

    def _reserve(self, order) -> str | None:
        own = self.positions.get(order.symbol)
        if not own:
            return "NO_POSITION"
        if own.free < order.quantity:
            return "OVERSELL"
        own.free -= order.quantity

    def _plan_order(self, e, done):
        plan = self.plans.get(e["plan_id"])
        done |= {"quantity": None, "price": None}  # until the order is one
        if not plan:
            return "NO_PLAN"
        done["symbol"] = plan.symbol
        if plan.status not in (ACTIVE, ORDER_CREATED):
            return "PLAN_STATE"
        price = e["price"] if e["price"] is not None else plan.price if plan.price > 0 else e["latest"]
        if price is None:
            return "NO_PRICE"
        quantity = e["quantity"]
        if (quantity or 0) <= 0:
            asset = self.cash + self.market_value()
            quantity = asset * (plan.weight if plan.weight > 0 else self.max_weight) // (100 * price) // 100 * 100 if price > 0 else 0
            if price > 0 and quantity < 100:
                return "BELOW_LOT"
        done |= {"price": price, "quantity": quantity}
        refused = self._order(e | {"symbol": plan.symbol, "side": "BUY", "quantity": quantity, "price": price}, done)
        if not refused:
            plan.status = ORDER_CREATED
        return refused

    def _confirm(self, e, done):
        order = self.orders.get(e["order_id"])
        if not order:
            return "NOT_PENDING"
        own, net = self.positions.get(order.symbol), order.net
        done |= {"plan_id": order.plan_id, "symbol": order.symbol, "quantity": order.quantity, "price": order.price, "net": net, "order_status": PENDING}
        if order.side == "BUY":
            if self.cash < net:
                return "NO_CASH"
            plan = self.plans.get(order.plan_id)
            old = own or Position(0, 0, 0, order.price, 0, e["day"], None, None, None)
            self.positions[order.symbol] = Position(
                old.quantity + order.quantity, old.free, half_up(old.cost * old.quantity + 100 * net, old.quantity + order.quantity), order.price, max(old.highest, order.price), e["day"],
                old.plan_id if order.plan_id is None else order.plan_id, plan.stop_loss if plan and plan.stop_loss is not None else old.stop_loss, plan.target_price if plan and plan.target_price is not None else old.target_price,
            )
            self.cash -= net
            self.frozen = max(0, self.frozen - net)
            if plan:
                plan.status = OPEN
        else:
            if not own:
                return "NO_POSITION"
            if own.quantity < order.quantity:
                return "OVERSELL"
            done["plan_id"] = own.plan_id
            done["realized"] = half_up(100 * net - own.cost * order.quantity, 100)
            self.cash += net
            self.realized += done["realized"]
            own.quantity -= order.quantity
            own.free, own.price = min(own.free, own.quantity), order.price
            if not own.quantity:
                del self.positions[order.symbol]
                if own.plan_id in self.plans:
                    self.plans[own.plan_id].status = CLOSED
        self.fees += abs(net - order.gross)
        del self.orders[e["order_id"]]
        done["order_status"] = FILLED

    def _cancel(self, e, done):
        order = self.orders.pop(e["order_id"], None)
        if not order:
            return "NOT_PENDING"
        done |= {"plan_id": order.plan_id, "symbol": order.symbol, "quantity": order.quantity, "price": order.price, "order_status": CANCELLED}
        own, plan = self.positions.get(order.symbol), self.plans.get(order.plan_id)
        if order.side == "BUY":
            self.frozen = max(0, self.frozen - order.net)
        elif own:
            own.free = min(own.quantity, own.free + order.quantity)
        if plan and plan.status == ORDER_CREATED:
            plan.status = ACTIVE

    def _cancel_plan(self, e, done):
        plan = self.plans.get(e["plan_id"])
        done["symbol"] = plan and plan.symbol
        if not plan or plan.status not in (ACTIVE, ORDER_CREATED):
            return "PLAN_STATE"
        own = sorted(i for i, o in self.orders.items() if o.plan_id == e["plan_id"])
        for i in own:
            self._cancel({"order_id": i}, {})
        done["also_cancelled"] = ",".join(map(str, own))
        plan.status = CANCELLED

    def _mark(self, e, done):
        own = self.positions.get(e["symbol"])
        if not own:
            return "NO_POSITION"
        own.price, own.highest = e["price"], max(own.highest, e["price"])


def scaled(events: DataFrame) -> DataFrame:
    """Events with prices and weights as integers."""
    return events.withColumns({c: (F.col(c) * unit).cast("long") for c, unit in _SCALED.items()} | {"quantity": F.col("quantity").cast("long")})


def unscaled(found: DataFrame) -> DataFrame:
    """Outcomes with money and prices as decimals, and the total asset."""
    cents = lambda c: (F.col(c).cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(20,2)")
    df = found.withColumns({c: cents(c) for c in _MONEY} | {"price": (F.col("price").cast("decimal(18,0)") * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(18,4)"), "quantity": F.col("quantity").cast("int"), "positions": F.col("positions").cast("int")})
    return df.withColumn("total_asset", (F.col("cash") + F.col("market_value")).cast("decimal(20,2)"))


def ledger_in_order(events: DataFrame, capital: int = CAPITAL, max_positions: int = MAX_POSITIONS, max_weight: int = MAX_WEIGHT) -> DataFrame:
    """The outcome of every event, applied in order of (account_id, seq), with the account's state after it.

    Kinds: PLAN (a plan for a symbol: price is its upper entry; KNOWN if a live plan exists), ORDER, PLAN_ORDER (price and quantity from
    the plan where null), CONFIRM, CANCEL, CANCEL_PLAN, MARK (a new price of a position). reason is null for what was done; otherwise why
    nothing changed. also_cancelled lists the waiting orders that went with a plan. A plan that was cancelled or closed is no more once nothing names it.
    """
    return unscaled(fold_sorted(scaled(events), ["account_id"], ["seq"], lambda _: Account(capital, max_positions, max_weight), Account.apply, OUTCOME))


def order_states(outcomes: DataFrame) -> DataFrame:
    """account_id, order_id, status of every order that was ever accepted: that of its last event, or CANCELLED with its plan."""
    own = outcomes.where("order_status is not null").select("account_id", "order_id", "seq", F.col("order_status").alias("status"))
    gone = outcomes.where("also_cancelled <> ''").select("account_id", F.explode(F.split("also_cancelled", ",").cast("array<bigint>")).alias("order_id"), "seq", F.lit(CANCELLED).alias("status"))
    return own.unionByName(gone).groupBy("account_id", "order_id").agg(F.max_by("status", "seq").alias("status"))


def plan_states(outcomes: DataFrame) -> DataFrame:
    """account_id, plan_id, symbol, status of every plan: that of the last event which concerned it."""
    own = outcomes.where("plan_status is not null")
    return own.groupBy("account_id", "plan_id").agg(F.max_by("symbol", "seq").alias("symbol"), F.max_by("plan_status", "seq").alias("status"))


def daily_snapshots(outcomes: DataFrame, capital: str = "1000000") -> DataFrame:
    """A row for each account and day with events, as its last event of the day left it: cash, frozen_cash, available_cash, market_value,
    total_asset, realized_pnl, total_return, positions. A later run of the same day replaces it (``merge.upsert`` by account_id, day)."""
    state = F.max_by(F.struct("cash", "frozen_cash", "market_value", "total_asset", "realized_pnl", "positions"), "seq")
    df = outcomes.groupBy("account_id", "day").agg(state.alias("s")).select("account_id", "day", "s.*")
    start = F.lit(capital).cast("decimal(20,2)")
    return df.withColumns({"available_cash": (F.col("cash") - F.col("frozen_cash")).cast("decimal(20,2)"), "total_return": F.round(((F.col("total_asset") - start) / start).cast("decimal(28,12)"), 8).cast("decimal(18,8)")})
