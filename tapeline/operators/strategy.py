"""Multi-factor signals of the decimal family, and daily signals and plans from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.messages import present
from ..functions.prices import price_ladder
from .indicators import latest, tail, with_exact_indicators

# The symbols of the daily signals, in their order.
DAILY_SYMBOLS = ("600000", "600036", "601318", "601166", "601398", "601088", "600028", "600309", "000001", "000858", "002415", "002594")


def multifactor_signals(bars: DataFrame, min_bars: int = 61) -> DataFrame:
    """symbol, signal_date, action, score, reference_price, reasons, risks from each symbol's last bar."""
    df = latest(with_exact_indicators(bars)).where(F.col("n_bars") >= min_bars)
    c, ratio, share = F.col("close"), F.col("ratio"), F.col("atr_share")
    trend = (c > F.col("sma20")) & (F.col("sma20") > F.col("sma60"))
    rules = [
        (trend, 25, "中短期趋势向上", ~trend, "趋势结构未形成多头排列"),
        (c > F.col("sma5"), 8, "收盘价位于5日均线上方", None, None),
        (F.col("rsi").between(50, 72), 18, "RSI动量健康", F.col("rsi") > 78, "短线指标过热"),
        (ratio.between(F.lit("1.25").cast("decimal(6,2)"), F.lit(3)), 15, "成交量温和放大", ratio > 4, "成交量异常放大，存在冲高回落风险"),
        (c >= F.col("prev_high"), 20, "突破近20日收盘高点", None, None),
        (share.between(F.lit("0.015").cast("decimal(6,3)"), F.lit("0.06").cast("decimal(6,3)")), 9, "波动率适合短线交易", ~share.between(F.lit("0.015").cast("decimal(6,3)"), F.lit("0.06").cast("decimal(6,3)")), "波动率不处于理想区间"),
    ]
    score = sum((F.when(good, points).otherwise(0) for good, points, *_ in rules), F.lit(0))
    df = df.withColumn("score", F.least(score, F.lit(100)).cast("int"))
    return df.select(
        "symbol", F.col("trade_date").alias("signal_date"),
        F.when(F.col("score") >= 70, "BUY").when(F.col("score") >= 55, "WATCH").otherwise("AVOID").alias("action"),
        "score", F.col("close").alias("reference_price"),
        present(*[F.when(good, F.lit(text)) for good, _, text, *_ in rules]).alias("reasons"),
        present(*[F.when(bad, F.lit(risk)) for *_, bad, risk in rules if bad is not None]).alias("risks"),
    )


def daily_signals(bars: DataFrame, symbols: tuple[str, ...] = DAILY_SYMBOLS, limit: int = 12, n: int = 100) -> DataFrame:
    """The best signals among fixed symbols on their last n bars; equal scores in the symbols' order."""
    place = F.array_position(F.array(*[F.lit(s) for s in symbols]), F.col("symbol")).alias("place")
    found = multifactor_signals(tail(bars.where(F.col("symbol").isin(*symbols)), n)).select("*", place)
    return found.orderBy(F.desc("score"), "place").limit(max(1, min(limit, 50)))


def daily_plans(bars: DataFrame, symbols: tuple[str, ...] = DAILY_SYMBOLS, limit: int = 12) -> DataFrame:
    """Plans for the daily signals but those to avoid: ladder around the close, weight 0.20, valid for two days."""
    ladder = price_ladder(F.col("reference_price"))
    return daily_signals(bars, symbols, limit).where("action <> 'AVOID'").select(
        "symbol", F.col("signal_date").alias("plan_date"), "score", *[v.alias(k) for k, v in ladder.items()],
        F.lit("0.20").cast("decimal(8,4)").alias("suggested_weight"), F.lit(2).alias("valid_days"), F.array_join("reasons", "；").alias("rationale"),
    )
