"""Risk events of marked positions, and the gate and size of a purchase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.messages import present
from ..functions.prices import half_up, lots

# Messages of the events and of the gate.
MESSAGES = {"STOP_LOSS": "当前价格已触发止损线", "TAKE_PROFIT": "当前价格达到第一目标位，可考虑分批止盈", "TRAILING_STOP": "价格从持仓最高价回落并触发移动止盈线", "DATA_MISSING": "持仓缺少最新本地K线，请先更新行情"}


def _event(kind: str, level: str, condition: Column, trigger: Column) -> Column:
    return F.when(condition, F.struct(F.lit(kind).alias("event_type"), F.lit(level).alias("level"), F.lit(MESSAGES[kind]).alias("message"), trigger.cast("decimal(18,4)").alias("trigger_price")))


def trailing_price(highest: Column, share: Column) -> Column:
    return half_up((highest * (1 - share)).cast("decimal(28,8)"), 4)


def check_risk(positions: DataFrame, as_of: Column) -> DataFrame:
    """Events of positions with last_price (null if missing), average_cost, highest_price, stop_loss, target_price and
    trailing_pct; a position may raise several, each with a key that makes it one a day."""
    price, cost = F.col("last_price"), F.col("average_cost")
    top = F.coalesce(F.when(F.col("highest_price") > 0, F.col("highest_price")), price)
    trail = trailing_price(top, F.coalesce(F.when(F.col("trailing_pct") > 0, F.col("trailing_pct")), F.lit("0.04").cast("decimal(8,4)")))
    events = present(
        _event("STOP_LOSS", "HIGH", price <= F.col("stop_loss"), F.col("stop_loss")),
        _event("TAKE_PROFIT", "MEDIUM", price >= F.col("target_price"), F.col("target_price")),
        _event("TRAILING_STOP", "HIGH", (top > cost) & (price <= trail), trail),
        _event("DATA_MISSING", "MEDIUM", price.isNull(), F.lit(None).cast("decimal(18,4)")),
    )
    df = positions.select("account_id", "symbol", price.cast("decimal(18,4)").alias("current_price"), as_of.cast("string").alias("_day"), F.explode(events).alias("e")).select("account_id", "symbol", "current_price", "_day", "e.*")
    return df.withColumns({"event_key": F.concat_ws(":", F.col("account_id").cast("string"), F.col("symbol").cast("string"), "event_type", "_day"), "resolved": F.lit(False)}).drop("_day")


def check_ticks(ticks: DataFrame, positions: DataFrame) -> DataFrame:
    """The events that ticks (symbol, price, tick_time) raise of positions, see ``check_risk``: one for each position, kind and day, as its
    latest tick that raises it has it, with that tick's time as event_time.

    Positions of a symbol meet its ticks in one join; the latest event of a key is an aggregate, combined before the shuffle.
    """
    held = positions.drop("last_price").join(ticks.select("symbol", F.col("price").alias("last_price"), "tick_time"), "symbol")
    # check_risk looks at a position and a price; the time goes along in the symbol's place and back
    found = check_risk(held.withColumn("symbol", F.struct("symbol", "tick_time")), F.lit(None).cast("string"))
    day = F.to_date("event_time").cast("string")
    df = found.withColumns({"event_time": F.col("symbol.tick_time"), "symbol": F.col("symbol.symbol")})
    df = df.withColumn("event_key", F.concat_ws(":", F.col("account_id").cast("string"), "symbol", "event_type", day))
    newest = F.max_by(F.struct("account_id", "symbol", "event_type", "level", "message", "current_price", "trigger_price", "event_time"), F.struct("event_time", "current_price"))
    return df.groupBy("event_key").agg(newest.alias("e")).select("event_key", "e.*").withColumn("resolved", F.lit(False))


def resolve(events: DataFrame, keys: DataFrame) -> DataFrame:
    """Events with the given keys are resolved."""
    done = keys.select("event_key").distinct().withColumn("_done", F.lit(True))
    return events.join(done, "event_key", "left").withColumn("resolved", F.col("resolved") | F.coalesce("_done", F.lit(False))).drop("_done")


def validate_buy(requests: DataFrame, max_positions: int = 5, max_weight: str = "0.20") -> DataFrame:
    """Adds weight, quantity, suggested_amount, messages and allowed to requests with total_capital, available_cash,
    current_positions, account_drawdown, daily_loss_pct, price and requested_weight."""
    weight = F.greatest(F.least(F.col("requested_weight"), F.lit(max_weight).cast("decimal(8,4)")), F.lit(0).cast("decimal(8,4)"))
    amount = F.least(F.col("total_capital") * weight, F.col("available_cash"))
    df = requests.withColumn("weight", weight).withColumn("quantity", lots(amount, F.col("price")))
    messages = present(
        F.when(F.col("current_positions") >= max_positions, "已达到最大持仓数量"),
        F.when(F.col("account_drawdown") >= F.lit("0.12").cast("decimal(8,4)"), "账户回撤达到12%，暂停开仓"),
        F.when(F.col("daily_loss_pct") >= F.lit("0.03").cast("decimal(8,4)"), "当日亏损达到3%，暂停开仓"),
        F.when(F.col("quantity") < 100, "可用资金不足100股"),
    )
    df = df.withColumn("messages", messages)
    return df.withColumns({"allowed": F.size("messages") == 0, "suggested_amount": half_up(F.col("price") * F.col("quantity").cast("decimal(12,0)"), 2, 20)})
