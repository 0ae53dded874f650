"""A simulated order ledger: the state is never updated in place but replayed from ordered orders.

``replay`` folds each (account, symbol) by itself: without cash and weight gates, symbols don't touch each other. It takes orders by
(trade_date, order_id) and fills them at once; everything else is derived from the fills by joins and aggregates. What needs
the order of events across symbols, gates, waiting orders and plans, is in ``events``.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prices import RATES, by_value, fees, half_up, lots
from .folds import fold_sorted
from .risk import trailing_price

MONEY = "decimal(20,2)"
# States of plans; of those that are live a symbol has one, those that are cancellable have no position yet.
LIVE = ("ACTIVE", "ORDER_CREATED", "OPEN")
CANCELLABLE = ("ACTIVE", "ORDER_CREATED")
_FILL = {
    "account_id": ("long", pa.int64()), "symbol": ("string", pa.string()), "order_id": ("long", pa.int64()), "side": ("string", pa.string()), "quantity": ("int", pa.int32()), "price": ("decimal(18,4)", pa.decimal128(18, 4)), "trade_date": ("date", pa.date32()),
    **{c: ("decimal(20,2)", pa.decimal128(20, 2)) for c in ("gross", "total_fee", "net")}, "status": ("string", pa.string()), "realized": ("decimal(20,2)", pa.decimal128(20, 2)),
    "held": ("long", pa.int64()), "available": ("long", pa.int64()), "average_cost": ("decimal(18,4)", pa.decimal128(18, 4)),
}


def with_fees(orders: DataFrame, rates: dict[str, str] = RATES) -> DataFrame:
    """Adds gross, the three fees, their total, and net: what a buyer pays or a seller gets."""
    gross = half_up(F.col("price") * F.col("quantity"), 2, 20)
    df = orders.withColumn("gross", gross).withColumns(fees(F.col("side"), gross, rates))
    df = df.withColumn("total_fee", (F.col("commission") + F.col("stamp_duty") + F.col("transfer_fee")).cast(MONEY))
    return df.withColumn("net", F.when(F.col("side") == "BUY", F.col("gross") + F.col("total_fee")).otherwise(F.col("gross") - F.col("total_fee")).cast(MONEY))


def reject_reason() -> Column:
    """Why an order is refused before any state is looked at; null for a good one."""
    return (
        F.when(~F.coalesce(F.upper("side").isin("BUY", "SELL"), F.lit(False)), "BAD_SIDE")
        .when(F.coalesce((F.col("quantity") <= 0) | (F.col("quantity") % 100 != 0), F.lit(True)), "BAD_LOT")
        .when(F.coalesce(F.col("price") <= 0, F.lit(True)), "BAD_PRICE")
    )


def validated(orders: DataFrame) -> DataFrame:
    return orders.withColumn("reject_reason", reject_reason())


@dataclass
class _Holding:
    held: int = 0
    free: int = 0
    cost: Decimal = Decimal(0)
    bought: date | None = None

    def fill(self, o: dict) -> list[dict]:
        """An order's row, with the holding after it."""
        if self.bought is not None and self.bought < o["trade_date"]:
            self.free = self.held
        quantity, status, realized = o["quantity"], o["reject_reason"], Decimal(0)
        if status is None and o["side"] == "SELL":
            if self.free < quantity:
                status = "OVERSELL"
            else:
                realized = (o["net"] - self.cost * quantity).quantize(Decimal("0.01"), ROUND_HALF_UP)
                self.held, self.free = self.held - quantity, self.free - quantity
        elif status is None:
            self.cost = ((self.cost * self.held + o["net"]) / (self.held + quantity)).quantize(Decimal("0.0001"), ROUND_HALF_UP)
            self.held, self.bought = self.held + quantity, o["trade_date"]
        if not self.held:
            self.cost, self.bought = Decimal(0), None
        own = {c: o[c] for c in ("account_id", "symbol", "order_id", "side", "quantity", "price", "trade_date", "gross", "total_fee", "net")}
        return [own | {"status": status or "FILLED", "realized": realized, "held": self.held, "available": self.free, "average_cost": self.cost}]


def replay(orders: DataFrame, rates: dict[str, str] = RATES) -> DataFrame:
    """Every order with its status (FILLED, OVERSELL or why it was refused), realized profit, and the position after it.

    Shares bought on a day can be sold from the next one on. Average cost is rounded to four digits at every purchase. The rows of an
    account and symbol stream by in order, so a holding of a million orders takes the memory of one.
    """
    df = validated(with_fees(orders, rates)).select("account_id", "symbol", "order_id", "side", "quantity", F.col("price").cast("decimal(18,4)").alias("price"), "trade_date", "gross", "total_fee", "net", "reject_reason")
    return fold_sorted(df, ["account_id", "symbol"], ["trade_date", "order_id"], lambda _: _Holding(), _Holding.fill, _FILL)


def daily(fills: DataFrame) -> DataFrame:
    """What each account did in each symbol on each of its days, and what it then held; one pass over the fills, and all that positions, highs,
    cash and the equity curve need of them. As small as the days are, it can be kept (``cut``) where several of those are wanted."""
    good = F.col("status") == "FILLED"
    bought = good & (F.col("side") == "BUY")
    return fills.groupBy("account_id", "symbol", "trade_date").agg(
        F.max_by(F.struct("held", "available", "average_cost"), "order_id").alias("p"), F.count_if(good).alias("filled"), F.sum(F.when(good, F.when(F.col("side") == "BUY", -F.col("net")).otherwise(F.col("net")))).alias("change"),
        F.sum(F.when(good, F.col("realized"))).alias("gain"), F.sum(F.when(good, F.col("total_fee"))).alias("fees"), F.max(F.when(bought, F.col("price"))).alias("paid"), F.max(F.when(bought, F.col("order_id"))).alias("bought_id"),
        F.max(F.when(bought & (F.col("held") == F.col("quantity")), F.col("trade_date"))).alias("opened"),
    )


def _daily(fills: DataFrame) -> DataFrame:
    return fills if "bought_id" in fills.columns else daily(fills)


def positions(fills: DataFrame) -> DataFrame:
    """Open positions: the state after the last order of each account and symbol, and its last purchase. Takes fills or their ``daily``."""
    df = _daily(fills).groupBy("account_id", "symbol").agg(F.max_by("p", "trade_date").alias("p"), F.max(F.when(F.col("bought_id").isNotNull(), F.col("trade_date"))).alias("last_buy_date"))
    return df.select("account_id", "symbol", F.col("p.held").alias("quantity"), F.col("p.available").alias("available_quantity"), F.col("p.average_cost").alias("average_cost"), "last_buy_date").where("quantity > 0")


def position_highs(fills: DataFrame, bars: DataFrame) -> DataFrame:
    """account_id, symbol, opened, highest_price: the day on which the holding last rose from zero, and the highest of its
    purchase prices and QFQ closes from that day on. Takes fills or their ``daily``.

    Accounts that opened a symbol on the same day share one look at its bars.
    """
    keys = ["account_id", "symbol"]
    days = _daily(fills).select(*keys, "trade_date", "paid", F.max("opened").over(Window.partitionBy(*keys)).alias("opened"))
    paid = days.where("trade_date >= opened").groupBy(*keys, "opened").agg(F.max("paid").alias("paid"))
    closes = bars.where("adjust_type = 'QFQ'").select("symbol", "trade_date", "close")
    tops = paid.select("symbol", "opened").distinct().join(closes, "symbol").where("trade_date >= opened").groupBy("symbol", "opened").agg(F.max("close").alias("top"))
    return paid.join(tops, ["symbol", "opened"], "left").select(*keys, "opened", F.greatest("paid", F.col("top").cast("decimal(18,4)")).alias("highest_price"))


def cash_flow(fills: DataFrame, capital: str) -> DataFrame:
    """One row an account: cash, realized profit and fees from its fills or their ``daily``."""
    return _daily(fills).where("filled > 0").groupBy("account_id").agg(
        (F.lit(capital).cast(MONEY) + F.sum("change")).cast(MONEY).alias("cash"), F.sum("gain").cast(MONEY).alias("realized_pnl"), F.sum("fees").cast(MONEY).alias("total_fees")
    )


def available_tomorrow(positions_: DataFrame, pending_sells: DataFrame, market_date: Column) -> DataFrame:
    """Shares free to sell once the last purchase is a day old: all but those in pending sales."""
    frozen = pending_sells.groupBy("account_id", "symbol").agg(F.sum("quantity").alias("frozen"))
    free = F.greatest(F.lit(0), F.col("quantity") - F.coalesce("frozen", F.lit(0)))
    return positions_.join(frozen, ["account_id", "symbol"], "left").withColumn("available_quantity", F.when(F.col("last_buy_date") < market_date, free).otherwise(F.col("available_quantity"))).drop("frozen")


def _marked(df: DataFrame) -> DataFrame:
    df = df.withColumn("last_price", F.coalesce("latest_price", "average_cost").cast("decimal(18,4)"))
    value = half_up(F.col("last_price") * F.col("quantity").cast("decimal(12,0)"), 2, 20)
    gain = half_up((F.col("last_price") - F.col("average_cost")) * F.col("quantity").cast("decimal(12,0)"), 2, 20)
    return df.withColumns({"market_value": value, "unrealized_pnl": gain, "missing": F.col("latest_price").isNull()})


def marked(positions_: DataFrame, latest: DataFrame) -> DataFrame:
    """Positions with last price (their cost where there is none), market value and unrealized profit."""
    df = _marked(positions_.join(latest.select("symbol", F.col("latest_price")), "symbol", "left"))
    cost = (F.col("average_cost") * F.col("quantity").cast("decimal(12,0)")).cast("double")
    return df.withColumn("pnl_rate", F.coalesce(by_value(F.try_divide(F.col("unrealized_pnl").cast("double"), F.nullif(cost, F.lit(0.0))), 8), F.lit(0.0)))


def position_details(marked_: DataFrame, highs: DataFrame, universe: DataFrame, plans: DataFrame, trailing: str = "0.04") -> DataFrame:
    """Marked positions with the security's name, the highest price and the trailing stop below it, and of the plan that
    ``source_plan_id`` names the stop, the target and the status."""
    names = universe.select("symbol", F.col("name").alias("_name"))
    levels = plans.select(F.col("plan_id").alias("source_plan_id"), "stop_loss", F.col("target1").alias("target_price"), F.col("status").alias("plan_status"))
    df = marked_.join(highs.select("account_id", "symbol", "highest_price"), ["account_id", "symbol"], "left").join(names, "symbol", "left").join(levels, "source_plan_id", "left")
    return df.withColumns({"name": F.coalesce("_name", "symbol"), "trailing_stop_price": trailing_price(F.col("highest_price"), F.lit(trailing).cast("decimal(8,4)"))}).drop("_name")


def with_freezes(orders: DataFrame) -> DataFrame:
    """Adds what a pending order holds back: a purchase its amount and fees (frozen_amount), a sale its shares
    (frozen_quantity); 0 for all others. Orders have fees and a status."""
    pending = lambda side: (F.col("status") == "PENDING_CONFIRM") & (F.col("side") == side)
    return orders.withColumns(
        {"frozen_amount": F.when(pending("BUY"), F.col("net")).otherwise(F.lit(0)).cast(MONEY), "frozen_quantity": F.when(pending("SELL"), F.col("quantity")).otherwise(F.lit(0)).cast("bigint")}
    )


def available_cash(cash: DataFrame, frozen: DataFrame) -> DataFrame:
    """Accounts with frozen_cash, the sum of their pending purchases, and available_cash, the rest."""
    held = frozen.groupBy("account_id").agg(F.sum("frozen_amount").cast(MONEY).alias("frozen_cash"))
    df = cash.join(held, "account_id", "left").withColumn("frozen_cash", F.coalesce("frozen_cash", F.lit(0)).cast(MONEY))
    return df.withColumn("available_cash", (F.col("cash") - F.col("frozen_cash")).cast(MONEY))


def gate_purchases(requests: DataFrame, cash: DataFrame, marked_: DataFrame, frozen: DataFrame, max_positions: int = 5, max_weight: str = "0.20") -> DataFrame:
    """Adds refused to requests to buy (with fees), each judged by itself against the account's state; null if it may stand.

    NO_CASH: it takes more than cash without what pending purchases freeze. PENDING: the symbol has a pending purchase.
    MAX_POSITIONS: a further symbol beside those held or waited for. MAX_WEIGHT: with what is held and pending of the symbol, at
    market prices, above a share of the total asset.
    """
    keys = ["account_id", "symbol"]
    waiting = frozen.where("frozen_amount > 0")
    pending = waiting.groupBy(*keys).agg(F.sum("gross").alias("pending_value"), F.count(F.lit(1)).alias("pending_orders"))
    asset = available_cash(cash, frozen).join(marked_.groupBy("account_id").agg(F.sum("market_value").alias("_value")), "account_id", "left")
    asset = asset.join(held_or_pending(marked_, waiting), "account_id", "left").select("account_id", "available_cash", (F.col("cash") + F.coalesce("_value", F.lit(0))).alias("total_asset"), F.coalesce("symbols", F.lit(0)).alias("symbols"))
    own = marked_.select(*keys, F.col("market_value").alias("own_value"))
    df = requests.join(asset, "account_id", "left").join(own, keys, "left").join(pending, keys, "left")
    value = F.coalesce("own_value", F.lit(0)) + F.coalesce("pending_value", F.lit(0)) + F.col("gross")
    refused = (
        F.when(F.coalesce(F.col("available_cash") < F.col("net"), F.lit(True)), "NO_CASH")
        .when(F.col("pending_orders") > 0, "PENDING")
        .when(F.col("own_value").isNull() & (F.col("symbols") >= max_positions), "MAX_POSITIONS")
        .when(value > F.col("total_asset") * F.lit(max_weight).cast("decimal(8,4)"), "MAX_WEIGHT")
    )
    return df.withColumn("refused", refused).select(*requests.columns, "refused")


def _with_asset(df: DataFrame, capital: str) -> DataFrame:
    """Adds total asset and return to cash and market value, which is 0 where there is no position."""
    df = df.withColumns({c: F.coalesce(c, F.lit(0)).cast(MONEY) for c in ("market_value", "unrealized_pnl")} | {"positions": F.coalesce("positions", F.lit(0))})
    df = df.withColumn("total_asset", (F.col("cash") + F.col("market_value")).cast(MONEY))
    return df.withColumn("total_return", by_value(F.col("total_asset").cast("double") / float(capital) - 1, 8))


def account_summary(cash: DataFrame, marked_: DataFrame, capital: str, frozen: DataFrame | None = None) -> DataFrame:
    """One row an account: cash, market value, total asset, profits and total return; given the orders with freezes, also
    frozen and available cash."""
    value = marked_.groupBy("account_id").agg(F.sum("market_value").alias("market_value"), F.sum("unrealized_pnl").alias("unrealized_pnl"), F.count(F.lit(1)).alias("positions"))
    return _with_asset((cash if frozen is None else available_cash(cash, frozen)).join(value, "account_id", "left"), capital)


def equity_curve(fills: DataFrame, bars: DataFrame, capital: str, days: int = 365) -> DataFrame:
    """A snapshot of each account at the end of each of its last days (7 to 1000) with fills, ascending: cash, realized profit,
    market value and unrealized profit of what it then held, total asset and return.

    A holding counts from a day with fills to its next one, at the newest QFQ close up to the snapshot's day (its cost where
    there is none), which is looked up once for all accounts.
    """
    good = _daily(fills).where("filled > 0")
    moves = good.groupBy("account_id", "trade_date").agg(F.sum("change").alias("change"), F.sum("gain").alias("gain"))
    upto = Window.partitionBy("account_id").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    newest = Window.partitionBy("account_id").orderBy(F.desc("trade_date"))
    df = moves.select("account_id", "trade_date", (F.lit(capital).cast(MONEY) + F.sum("change").over(upto)).cast(MONEY).alias("cash"), F.sum("gain").over(upto).cast(MONEY).alias("realized_pnl"))
    df = df.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= max(7, min(1000, days))).drop("_n")
    held = _held_on(good, df.select("account_id", "trade_date"))
    wanted = held.select("symbol", "trade_date").distinct()
    priced = held.join(_closes_on(wanted, bars), ["symbol", "trade_date"], "left")
    value = _marked(priced).groupBy("account_id", "trade_date").agg(F.sum("market_value").alias("market_value"), F.sum("unrealized_pnl").alias("unrealized_pnl"), F.count(F.lit(1)).alias("positions"))
    return _with_asset(df.join(value, ["account_id", "trade_date"], "left"), capital).orderBy("account_id", "trade_date")


def _held_on(good: DataFrame, days: DataFrame) -> DataFrame:
    """What each account holds at the end of its days, from its ``daily`` with fills."""
    state = good.select("account_id", "symbol", "trade_date", "p")
    later = F.lead("trade_date").over(Window.partitionBy("account_id", "symbol").orderBy("trade_date"))
    spans = state.select("account_id", "symbol", F.col("p.held").alias("quantity"), F.col("p.average_cost").alias("average_cost"), F.col("trade_date").alias("_from"), later.alias("_till"))
    inside = (F.col("trade_date") >= F.col("_from")) & (F.col("_till").isNull() | (F.col("trade_date") < F.col("_till")))
    return days.join(spans.where("quantity > 0"), "account_id").where(inside).drop("_from", "_till")


def _closes_on(wanted: DataFrame, bars: DataFrame) -> DataFrame:
    """symbol, trade_date, latest_price: the newest QFQ close up to each wanted day."""
    closes = bars.where("adjust_type = 'QFQ'").join(wanted.select("symbol").distinct(), "symbol", "left_semi").select("symbol", "trade_date", "close", F.lit(False).alias("_asked"))
    both = closes.unionByName(wanted.withColumns({"close": F.lit(None).cast(closes.schema["close"].dataType), "_asked": F.lit(True)}))
    days = both.groupBy("symbol", "trade_date").agg(F.max("close").alias("close"), F.max("_asked").alias("_asked"))
    upto = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("latest_price", F.last("close", ignorenulls=True).over(upto)).where("_asked").select("symbol", "trade_date", "latest_price")


def held_or_pending(positions_: DataFrame, pending_buys: DataFrame) -> DataFrame:
    """How many different symbols each account holds or waits to buy."""
    both = positions_.select("account_id", "symbol").union(pending_buys.select("account_id", "symbol")).distinct()
    return both.groupBy("account_id").agg(F.count(F.lit(1)).alias("symbols"))


def plans_from_results(results: DataFrame, live: DataFrame, valid_days: int = 5) -> DataFrame:
    """Plans for eligible results whose symbol has no live plan yet."""
    taken = live.where(F.col("status").isin(*LIVE)).select("symbol").distinct()
    return results.where("eligible").join(taken, "symbol", "left_anti").select("symbol", "name", "score", "buy_low", "buy_high", "stop_loss", "target1", "suggested_weight", F.lit(valid_days).alias("valid_days"), F.lit("ACTIVE").alias("status"))


def orders_from_plans(plans: DataFrame, asset: Column, default_weight: str = "0.20") -> DataFrame:
    """An order for each plan that may have one (ACTIVE or ORDER_CREATED, where plans have a status) and buys a lot at least.

    The price is the request's own (``price``), else the first positive one of the upper entry and the latest; quantity is the request's
    own (``quantity``) if positive, else whole lots of the plan's weight of the asset, of the default weight where that isn't positive.
    """
    given = lambda c, kind: F.col(c).cast(kind) if c in plans.columns else F.lit(None).cast(kind)
    positive = lambda c: F.when(c > 0, c)
    price = F.coalesce(given("price", "decimal(18,4)"), positive(given("buy_high", "decimal(18,4)")), given("latest_price", "decimal(18,4)"))
    weight = F.coalesce(positive(F.col("suggested_weight").cast("decimal(8,4)")), F.lit(default_weight).cast("decimal(8,4)"))
    own = plans.where(F.col("status").isin(*CANCELLABLE)) if "status" in plans.columns else plans
    df = own.select(*[c for c in ("plan_id",) if c in plans.columns], "symbol", price.alias("price"), weight.alias("weight"), given("quantity", "long").alias("_own"))
    df = df.where("price > 0").withColumn("quantity", F.coalesce(positive(F.col("_own")), lots(asset.cast(MONEY) * F.col("weight"), F.col("price"))))
    return df.where("quantity >= 100").withColumn("side", F.lit("BUY")).drop("_own")


def apply_cancellations(orders: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Pending orders that are cancelled become CANCELLED and freeze nothing; others stay as they are."""
    ids = cancelled.select("order_id").distinct().withColumn("_gone", F.lit(True))
    gone = F.coalesce(F.col("_gone"), F.lit(False)) & (F.col("status") == "PENDING_CONFIRM")
    df = orders.join(ids, "order_id", "left").withColumn("_gone", gone)
    frozen = {c: F.when(F.col("_gone"), F.lit(0)).otherwise(F.col(c)).cast(orders.schema[c].dataType) for c in ("frozen_amount", "frozen_quantity") if c in orders.columns}
    return df.withColumns(frozen | {"status": F.when(F.col("_gone"), "CANCELLED").otherwise(F.col("status"))}).drop("_gone")


def plans_after_cancellations(plans: DataFrame, orders: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Plans whose waiting order was cancelled go back from ORDER_CREATED to ACTIVE; ``orders`` are those before that."""
    freed = orders.where("status = 'PENDING_CONFIRM'").join(cancelled.select("order_id").distinct(), "order_id", "left_semi").select("plan_id").distinct().withColumn("_freed", F.lit(True))
    back = F.coalesce(F.col("_freed"), F.lit(False)) & (F.col("status") == "ORDER_CREATED")
    return plans.join(freed, "plan_id", "left").withColumn("status", F.when(back, "ACTIVE").otherwise(F.col("status"))).drop("_freed")


def cancel_plans(plans: DataFrame, orders: DataFrame, cancelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cancelled plans, and the orders with the pending ones of these plans cancelled; a plan that is open or ended can't be cancelled,
    and its orders stay as they are."""
    ids = plans.where(F.col("status").isin(*CANCELLABLE)).join(cancelled.select("plan_id").distinct(), "plan_id", "left_semi").select("plan_id")
    marked_ = ids.withColumn("_gone", F.lit(True))
    new = plans.join(marked_, "plan_id", "left").withColumn("status", F.when(F.col("_gone"), "CANCELLED").otherwise(F.col("status"))).drop("_gone")
    own = orders.join(ids, "plan_id", "left_semi").select("order_id")
    return new, apply_cancellations(orders, own)


def order_view(orders: DataFrame, universe: DataFrame, plans: DataFrame, n: int = 200) -> DataFrame:
    """The newest orders with display_name, the order's own name, else the security's, else the symbol, and of the plan the state, the
    stop and the target."""
    names = universe.select("symbol", F.col("name").alias("_security"))
    levels = plans.select("plan_id", F.col("status").alias("plan_status"), "stop_loss", F.col("target1").alias("target_price"))
    newest = orders.orderBy(F.desc("order_id")).limit(n)  # joined after the cut, so that no more rows meet than are shown
    df = newest.join(names, "symbol", "left").join(levels, "plan_id", "left")
    own = F.col("name") if "name" in orders.columns else F.lit(None).cast("string")
    return df.withColumn("display_name", F.coalesce(own, "_security", "symbol")).drop("_security").orderBy(F.desc("order_id"))


def setting(settings: DataFrame, key: str, default: str, kind: str = "decimal(18,6)") -> DataFrame:
    """One row with the value of a setting, or the default where it is missing or can't be read."""
    value = F.max(F.when(F.col("setting_key") == key, F.col("setting_value").try_cast(kind)))
    return settings.agg(F.coalesce(value, F.lit(default).cast(kind)).alias("value"))
