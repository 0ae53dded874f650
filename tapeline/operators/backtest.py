"""Back-tests: signals, exits and trades as joins and windows, with an ordered fold of capital per symbol."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prices import by_value
from .folds import fold_sorted
from .indicators import by_date, last, numbered, tail

D = "decimal(28,8)"


@dataclass(frozen=True)
class Rules:
    """What a back-test runs with."""

    capital: str = "100000"
    hold: int = 10
    stop: str = "0.05"
    take: str = "0.08"
    trail: str = "0.04"
    commission: str = "0.0003"
    stamp: str = "0.0005"
    min_bars: int = 30


def _d(text: str) -> Column:
    return F.lit(text).cast("decimal(12,6)")


def backtest_signals(bars: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """symbol, signal_n, signal_date, entry: bars on the fixed grid that close above their mean of 20, with the next open."""
    stride = max(2, rules.hold)
    df = numbered(bars).withColumns(
        {
            "avg20": F.round(F.sum("close").over(last(20)).cast("decimal(20,4)") / F.lit(20).cast("decimal(10,0)"), 6),
            "entry": F.lead("open").over(by_date()),
            "entry_date": F.lead("trade_date").over(by_date()),
        }
    )
    on_grid = (F.col("n") >= 20) & ((F.col("n") - 20) % stride == 0) & (F.col("n") < F.col("n_bars") - 2)
    return df.where(on_grid & (F.col("n_bars") >= rules.min_bars) & (F.col("close") > F.col("avg20"))).select(
        "symbol", F.col("n").alias("signal_n"), F.col("trade_date").alias("signal_date"), "entry_date", F.col("entry").cast("decimal(18,4)").alias("entry")
    )


def backtest_exits(bars: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Each signal with its exit: the first bar of the hold that meets a rule, else the last one.

    A signal is joined to the bars it may hold by symbol and range of bar numbers: at most hold + 1 of them.
    On one bar, stop comes before take, take before trail.
    """
    signals = backtest_signals(bars, rules)
    held = numbered(bars).select("symbol", "n", F.col("trade_date").alias("exit_date"), "high", "low", "close")
    walked = signals.join(held, "symbol").where((F.col("n") > F.col("signal_n")) & (F.col("n") <= F.col("signal_n") + 1 + rules.hold))
    order = Window.partitionBy("symbol", "signal_n").orderBy("n")
    stop, take = (F.col("entry") * (1 - _d(rules.stop))).cast(D), (F.col("entry") * (1 + _d(rules.take))).cast(D)
    top = F.greatest(F.col("entry"), F.max("high").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    reason = F.when(F.col("low") <= stop, "STOP_LOSS").when(F.col("high") >= take, "TAKE_PROFIT").when(F.col("close") <= (F.col("top") * (1 - _d(rules.trail))).cast(D), "TRAILING_STOP")
    walked = walked.withColumn("top", top).withColumn("reason", reason)
    # the first bar with a reason; bars without one sort behind, the last of them first
    key = F.when(F.col("reason").isNotNull(), F.col("n")).otherwise(F.lit(1 << 40) - F.col("n"))
    chosen = walked.groupBy("symbol", "signal_n", "signal_date", "entry_date", "entry").agg(F.min_by(F.struct("n", "exit_date", "close", "reason"), key).alias("x"))
    why = F.coalesce(F.col("x.reason"), F.lit("MAX_HOLD"))
    price = F.when(why == "STOP_LOSS", stop).when(why == "TAKE_PROFIT", take).otherwise(F.col("x.close").cast(D))
    return chosen.select("symbol", "signal_n", "signal_date", "entry_date", "entry", F.col("x.n").alias("exit_n"), F.col("x.exit_date").alias("exit_date"), why.alias("reason"), price.cast(D).alias("exit_price"))


_TRADE = {
    "symbol": ("string", pa.string()), "n": ("int", pa.int32()), "entry_date": ("date", pa.date32()), "exit_date": ("date", pa.date32()), "entry": ("decimal(18,4)", pa.decimal128(18, 4)), "exit_price": (D, pa.decimal128(28, 8)),
    "reason": ("string", pa.string()), "quantity": ("long", pa.int64()), **{c: (D, pa.decimal128(28, 8)) for c in ("pnl", "capital", "peak")},
}


def _to_eight(value: Decimal) -> Decimal:
    return value.quantize(Decimal("0.00000001"), ROUND_HALF_UP)


class _Capital:
    """Capital from trade to trade, and its highest value."""

    def __init__(self, rules: Rules):
        self.rules, self.capital = rules, Decimal(rules.capital)
        self.peak = self.capital

    def trade(self, leg: dict) -> list[dict]:
        """A fifth of the capital in whole lots, if that buys one."""
        lots = _to_eight(self.capital * Decimal("0.20")) // (leg["entry"] * 100)
        if lots < 1:
            return []
        quantity = int(lots) * 100
        buy, sell = leg["entry"] * quantity, leg["exit_price"] * quantity
        pnl = sell - buy - _to_eight((buy + sell) * Decimal(self.rules.commission)) - _to_eight(sell * Decimal(self.rules.stamp))
        self.capital += pnl
        self.peak = max(self.peak, self.capital)
        own = {c: leg[c] for c in ("symbol", "entry_date", "exit_date", "entry", "exit_price", "reason")}
        return [own | {"n": leg["signal_n"], "quantity": quantity, "pnl": pnl, "capital": self.capital, "peak": self.peak}]


def backtest_trades(bars: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The trades of each symbol with quantity, pnl and the capital after it.

    Only the chain of quantity and capital is sequential; it is a fold over the symbol's signals, which stream by in order.
    """
    exits = backtest_exits(bars, rules)
    folded = fold_sorted(exits, ["symbol"], ["signal_n"], lambda _: _Capital(rules), _Capital.trade, _TRADE)
    share = by_value((F.col("peak") - F.col("capital")).cast("double") / F.col("peak").cast("double"), 6)
    return folded.withColumns({"trade_return": by_value(F.col("pnl").cast("double") / (F.col("entry") * F.col("quantity")).cast("double"), 6), "drawdown": share})


def backtest_summary(bars: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row a symbol with enough bars: capital, total return, drawdown, win rate, profit-loss ratio, trades."""
    trades = backtest_trades(bars, rules)
    pnl = F.col("pnl").cast("double")
    won, lost = F.sum(F.when(pnl > 0, pnl)), F.sum(F.when(pnl < 0, -pnl))
    done = trades.groupBy("symbol").agg(
        F.max_by("capital", "n").cast("double").alias("final_capital"), F.max("drawdown").alias("max_drawdown"), F.count(F.lit(1)).alias("trades"),
        F.count_if(pnl > 0).alias("wins"), F.coalesce(won, F.lit(0.0)).alias("gross_win"), F.coalesce(lost, F.lit(0.0)).alias("gross_loss"),
    )
    able = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars")).where(F.col("n_bars") >= rules.min_bars).select("symbol")
    capital = float(rules.capital)
    zero = F.lit(0.0)
    return able.join(done, "symbol", "left").select(
        "symbol",
        by_value(F.coalesce("final_capital", F.lit(capital)), 4).alias("final_capital"),
        by_value(F.coalesce(F.col("final_capital") / capital - 1, zero), 6).alias("total_return"),
        F.coalesce("max_drawdown", zero).alias("max_drawdown"),
        by_value(F.coalesce(F.col("wins") / F.col("trades"), zero), 6).alias("win_rate"),
        by_value(F.coalesce(F.when(F.col("gross_loss") == 0, F.col("gross_win")).otherwise(F.try_divide("gross_win", "gross_loss")), zero), 6).alias("profit_loss_ratio"),
        F.coalesce("trades", F.lit(0)).cast("bigint").alias("trade_count"),
    )


def failed_symbols(wanted: DataFrame, bars: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Wanted symbols without enough bars, and why."""
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    short = wanted.select("symbol").distinct().join(n, "symbol", "left").withColumn("n_bars", F.coalesce("n_bars", F.lit(0)))
    return short.where(F.col("n_bars") < rules.min_bars).withColumn("error_message", F.format_string("only %d bars", F.col("n_bars")))


def local_bars(bars: DataFrame, n: int = 180) -> DataFrame:
    return tail(bars, n)
