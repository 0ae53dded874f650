"""Indicators over daily bars, as window functions that share one partitioning and one sort by symbol and date.

Two families, never mixed: ``with_indicators`` works on doubles with exponential averages seeded at the first bar of the tail;
``with_exact_indicators`` on decimals with plain sums, six digits, half up. Both add columns to every bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The longest tail, as of the histories that can be asked for.
LONGEST = 3000


def of_day(bars: DataFrame) -> list[Column]:
    """What puts bars of one symbol and day in order, as a symbol's dates may repeat: the prices, then every other column.

    So the order of a symbol's bars is whole, and results don't depend on how rows come to a task.
    """
    known = [c for c in ("close", "high", "low", "open", "volume", "amount") if c in bars.columns]
    others = [c for c, kind in bars.dtypes if c not in (*known, "symbol", "trade_date") and "map<" not in kind and "variant" not in kind]
    return [F.col(f"`{c}`") for c in known + others]


def by_date():
    """A symbol's bars in order; they are ``numbered``."""
    return Window.partitionBy("symbol").orderBy("n")


def last(n: int, skip: int = 0):
    """The n bars that end ``skip`` bars before the current one."""
    return by_date().rowsBetween(-(n - 1) - skip, -skip)


def tail(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each symbol; a rank filter, which Spark applies before the shuffle too."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("trade_date"), *[c.desc() for c in of_day(bars)])
    return bars.withColumn("_newest", F.row_number().over(newest)).where(F.col("_newest") <= n).drop("_newest")


def numbered(bars: DataFrame) -> DataFrame:
    """Adds n, the bar's place from 0, and n_bars."""
    order = Window.partitionBy("symbol").orderBy("trade_date", *of_day(bars))
    return bars.withColumns({"n": F.row_number().over(order) - 1, "n_bars": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})


def ewm(value: Column, alpha: float, n: Column) -> Column:
    """Exponential average y_n = (1 - alpha) y_(n-1) + alpha x_n from y_0 = x_0, for n from 0; null for null or negative n.

    In closed form over a running window, so no recursion: exact to rounding up to ``LONGEST`` bars, beyond which the weights of
    the fastest average used here would overflow.
    """
    keep = 1.0 - alpha
    x = F.when(n == 0, value).when(n > 0, value * alpha)
    return F.sum(x * F.pow(F.lit(keep), -n)).over(by_date().rowsBetween(Window.unboundedPreceding, 0)) * F.pow(F.lit(keep), n)


def full(value: Column, n: int) -> Column:
    """A rolling value, null until n bars are there."""
    return F.when(F.col("n") >= n - 1, value)


def sma(column: str, n: int) -> Column:
    return full(F.sum(column).over(last(n)).cast("double") / n, n)


def true_range(kind: str = "double") -> Column:
    before = F.lag("close").over(by_date()).cast(kind)
    high, low = F.col("high").cast(kind), F.col("low").cast(kind)
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


def change_over(n: int) -> Column:
    """Percent change against the close n bars before."""
    return (F.col("close").cast("double") / F.lag("close", n).over(by_date()).cast("double") - 1) * 100


def with_indicators(bars: DataFrame, n: int = 260) -> DataFrame:
    """Averages, Wilder RSI and ATR, MACD, returns, volume ratio, breakout, range and volatility on the last n bars.

    The exponential averages depend on where the tail starts, so the tail is cut first; one of over ``LONGEST`` bars is an error.
    """
    if n > LONGEST:
        raise ValueError(f"a tail has at most {LONGEST} bars")
    alpha = 0.07142857142857142
    df = numbered(tail(bars, n))
    c = F.col("close").cast("double")
    diff = F.col("close") - F.lag("close").over(by_date())
    df = df.withColumns(
        {f"ma{p}": sma("close", p) for p in (5, 10, 20, 60)}
        | {f"return{p}": change_over(p) for p in (5, 20, 60)}
        | {
            "gain": F.greatest(diff.cast("double"), F.lit(0.0)),
            "loss": F.greatest((-diff).cast("double"), F.lit(0.0)),
            "true_range": true_range(),
            "ema12": ewm(c, 2.0 / 13, F.col("n")),
            "ema26": ewm(c, 2.0 / 27, F.col("n")),
            "daily_return": c / F.lag("close").over(by_date()).cast("double") - 1,
            "avg_volume_prev20": F.sum("volume").over(last(20, 1)).cast("double") / 20,
            "amount20": F.sum(F.coalesce("amount", F.lit(0))).over(last(20)).cast("double"),
            "estimate20": F.sum(F.col("volume") * F.col("close") * 100).over(last(20)).cast("double"),
            "prev_high20": F.max("close").over(last(20, 1)),
            "high20": F.max("close").over(last(20)),
            "low20": F.min("close").over(last(20)),
        }
    )
    since = F.col("n") - 1  # gains and losses start at the second bar
    df = df.withColumns(
        {
            "avg_gain": F.when(F.col("n") >= 14, ewm(F.col("gain"), alpha, since)),
            "avg_loss": F.when(F.col("n") >= 14, ewm(F.col("loss"), alpha, since)),
            "atr14": F.when(F.col("n") >= 13, ewm(F.col("true_range"), alpha, F.col("n"))),
            "macd": F.col("ema12") - F.col("ema26"),
            "volatility20": F.stddev_pop("daily_return").over(last(20)) * 100,
            "limit_ups": F.count_if(F.col("daily_return") >= 0.095).over(last(5)),
        }
    )
    df = df.withColumn("macd_hist", F.col("macd") - ewm(F.col("macd"), 0.2, F.col("n")))
    high, low = F.col("high20").cast("double"), F.col("low20").cast("double")
    return df.withColumns(
        {
            "prev_hist": F.lag("macd_hist").over(by_date()),
            "rsi14": F.coalesce(100 - 100 / (1 + F.try_divide("avg_gain", F.nullif(F.col("avg_loss"), F.lit(0.0)))), F.lit(100.0)),
            "atr_pct": F.col("atr14") / c * 100,
            "volume_ratio20": F.coalesce(F.try_divide(F.col("volume").cast("double"), F.nullif("avg_volume_prev20", F.lit(0.0))), F.lit(0.0)),
            "avg_amount20": F.when(F.col("amount20") > 0, F.col("amount20")).otherwise(F.col("estimate20")) / 20,
            "breakout20": F.col("close") >= F.col("prev_high20"),
            "drawdown20": (c / high - 1) * 100,
            "range_position20": F.when(high > low, (c - low) / F.nullif(high - low, F.lit(0.0)) * 100).otherwise(50.0),
            "day_return": F.col("daily_return") * 100,
        }
    )


def latest(bars: DataFrame) -> DataFrame:
    """The last bar of each symbol, of numbered bars."""
    return bars.where(F.col("n") == F.col("n_bars") - 1)


def exact(total: Column, over: int | Column, digits: int = 6) -> Column:
    """A quotient of decimals, half up."""
    over = F.lit(over) if isinstance(over, int) else over
    return F.round(total.cast("decimal(28,8)") / over.cast("decimal(10,0)"), digits).cast(f"decimal(18,{digits})")


def sma_exact(n: int) -> Column:
    return full(exact(F.sum("close").over(last(n)), n), n)


def avg_volume_incl(n: int = 20) -> Column:
    """Mean volume of the last n bars, the current one included."""
    return full(exact(F.sum("volume").over(last(n)), n), n)


def atr_simple(n: int = 14) -> Column:
    """Mean true range of the last n bars; needs one bar more."""
    return full(exact(F.sum("exact_range").over(last(n)), n), n + 1)


def highest_close(n: int) -> Column:
    return full(F.max("close").over(last(n)), n)


def rsi_simple(n: int = 14) -> Column:
    """From plain sums of the last n changes; 100 without losses."""
    up, down = F.sum("up").over(last(n)).cast("decimal(18,4)"), F.sum("down").over(last(n)).cast("decimal(18,4)")
    rs = F.round(up / F.nullif(down, F.lit(0).cast("decimal(18,4)")), 6).cast("decimal(18,6)")
    part = F.round(F.lit(100).cast("decimal(10,0)") / (1 + rs), 6).cast("decimal(18,6)")
    return full(F.coalesce(F.lit(100).cast("decimal(18,6)") - part, F.lit(100).cast("decimal(18,6)")), n + 1).cast("decimal(18,6)")


def with_exact_indicators(bars: DataFrame) -> DataFrame:
    """The decimal family: averages 5, 20 and 60, RSI, ATR, volume ratio with the current bar, previous close high."""
    change = F.col("close") - F.lag("close").over(by_date())
    zero = F.lit(0).cast("decimal(13,4)")
    df = numbered(bars).withColumns({"up": F.greatest(change, zero), "down": F.greatest(-change, zero), "exact_range": true_range("decimal(13,4)")})
    df = df.withColumns({f"sma{p}": sma_exact(p) for p in (5, 20, 60)} | {"rsi": rsi_simple(), "atr": atr_simple(), "avg_volume20": avg_volume_incl(), "prev_high": full(F.max("close").over(last(20, 1)), 21)})
    return df.withColumns(
        {
            "ratio": F.round(F.col("volume").cast("decimal(20,0)") / F.nullif("avg_volume20", F.lit(0)), 4).cast("decimal(18,4)"),
            "atr_share": F.round(F.col("atr") / F.col("close"), 6).cast("decimal(18,6)"),
        }
    )
