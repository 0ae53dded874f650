"""Rule scores over the latest bar: dynamic score, levels, filter reasons, notes and summary.

Every block of rules is one ``when`` chain, so the whole score is a projection without Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.messages import present
from ..functions.prices import half_up, price_ladder, shown, signed_percent, suggested_weight
from .indicators import latest, with_indicators

MIN_BARS = 80
# The texts of notes and reasons.
DEFAULT_BULLISH = "当前尚未出现明确的短线优势信号"
DEFAULT_BEARISH = "指标暂未出现明显恶化，但仍需核对大盘与公告风险"
MODE = "LOCAL_RULES_DYNAMIC"


def _text(pattern: str, value: Column) -> Column:
    """The pattern with the value in place of its one number, %.1f or %.2f."""
    before, digits, after = re.split(r"%\.(\d)f", pattern)
    return F.concat(F.lit(before), shown(value, int(digits)), F.lit(after.replace("%%", "%")))


def _blocks() -> dict[str, list[tuple[Column, int, Column | None, Column | None]]]:
    """For each block its rules, the first that holds counts: condition, points, bullish note, bearish note."""
    c, yes = F.col("close").cast("double"), F.lit(True)
    ma5, ma10, ma20, ma60 = (F.col(f"ma{p}") for p in (5, 10, 20, 60))
    rsi, ret, ratio, atr, vol = (F.col(x) for x in ("rsi14", "return20", "volume_ratio20", "atr_pct", "volatility20"))
    fall, hist, before, turn = F.col("drawdown20"), F.col("macd_hist"), F.col("prev_hist"), F.coalesce(F.col("turnover_rate").cast("double"), F.lit(0.0))
    say = F.lit
    return {
        "trend": [
            ((c > ma20) & (ma20 > ma60), 15, say("价格位于20日均线上方，且MA20高于MA60，中期趋势偏强"), None),
            (c > ma20, 7, say("价格站上20日均线，短线趋势有所改善"), None),
            ((c < ma20) & (ma20 < ma60), -15, None, say("价格低于20日均线且MA20低于MA60，趋势结构偏弱")),
            (yes, -5, None, say("价格尚未形成清晰的中期多头排列")),
        ],
        "short": [
            ((ma5 > ma10) & (ma10 > ma20), 8, say("MA5、MA10、MA20形成短期多头排列"), None),
            ((ma5 < ma10) & (ma10 < ma20), -8, None, say("短期均线呈空头排列")),
        ],
        "rsi": [
            (rsi.between(50, 70), 8, _text("RSI14为%.1f，动量处于相对健康区间", rsi), None),
            (rsi > 78, -8, None, _text("RSI14为%.1f，短线存在过热和回撤风险", rsi)),
            (rsi < 35, -5, None, _text("RSI14为%.1f，当前动量偏弱", rsi)),
            (yes, 0, _text("RSI14为%.1f，暂未出现极端超买", rsi), None),
        ],
        "return20": [
            ((ret > 0) & (ret <= 15), 7, F.concat(say("近20日收益"), signed_percent(ret), say("，上涨节奏相对温和")), None),
            (ret > 25, -7, None, F.concat(say("近20日累计上涨"), signed_percent(ret), say("，短线追高风险增加"))),
            (ret < -12, -8, None, F.concat(say("近20日收益"), signed_percent(ret), say("，阶段走势明显偏弱"))),
        ],
        "volume": [
            (ratio.between(1.2, 2.5), 8, _text("当日量比约%.2f，成交量温和放大", ratio), None),
            (ratio > 3.5, -5, None, _text("当日量比约%.2f，放量过快需防冲高回落", ratio)),
            (ratio < 0.65, -3, None, _text("当日量比约%.2f，市场参与度偏低", ratio)),
        ],
        "breakout": [
            (F.col("breakout20"), 10, say("收盘价突破前20个交易日收盘高点"), None),
            (fall >= -2.0, 3, say("价格接近20日高位，处于突破观察区"), None),
            (fall <= -10, -6, None, _text("较20日高点回撤%.2f%%，修复压力仍在", F.abs(fall))),
        ],
        "macd": [
            ((hist > 0) & (hist >= before), 6, say("MACD柱线位于零轴上方且继续增强"), None),
            ((hist < 0) & (hist < before), -6, None, say("MACD柱线为负且继续走弱")),
        ],
        "atr": [
            (atr.between(1.2, 5.5), 3, _text("ATR占价格%.2f%%，波动水平适合短线观察", atr), None),
            (atr > 7, -10, None, _text("ATR占价格%.2f%%，短线波动风险较高", atr)),
        ],
        "volatility": [(vol > 4.5, -7, None, _text("近20日单日波动率约%.2f%%，价格稳定性较弱", vol))],
        "turnover": [
            (turn.between(1, 10), 2, None, None),
            (turn > 18, -4, None, _text("最新换手率%.2f%%，筹码交换较为剧烈", turn)),
        ],
    }


def _first(rules, pick: int) -> Column:
    """The picked part of the first rule that holds; null where it has none."""
    out = None
    for condition, *parts in rules:
        value = F.lit(None).cast("string") if parts[pick] is None else parts[pick] if isinstance(parts[pick], Column) else F.lit(parts[pick])
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def signal_level(score: Column) -> Column:
    return F.when(score >= 75, "STRONG").when(score >= 60, "WATCH").when(score >= 45, "NEUTRAL").otherwise("WEAK")


def risk_level(score: Column) -> Column:
    atr, vol = F.col("atr_pct"), F.col("volatility20")
    high = (atr >= 7) | (vol >= 4.5) | (F.col("return20") <= -15)
    return F.when(high, "HIGH").when((atr <= 3.5) & (vol <= 2.8) & (score >= 65), "LOW").otherwise("MEDIUM")


def filter_reasons() -> Column:
    """Why a symbol isn't a candidate, by unrounded values; empty for a candidate."""
    rules = [
        (F.col("score") < 60, "综合评分低于60"),
        (F.col("risk_level") == "HIGH", "风险等级为HIGH"),
        (F.col("avg_amount20") < 50_000_000, "近20日平均成交额低于5000万元"),
        (F.col("atr_pct") > 7, "ATR波动超过7%"),
        (F.col("return20") > 25, "近20日涨幅超过25%，追高风险较大"),
        (F.col("return20") < -10, "近20日跌幅超过10%"),
        (F.col("drawdown20") < -12, "较20日高点回撤超过12%"),
        (F.col("volume_ratio20") < 0.65, "成交活跃度不足"),
        (F.col("day_return") >= 9.5, "最新交易日接近涨停，不宜追价"),
        (F.col("limit_ups") >= 2, "近5日出现多次涨停，短线波动过大"),
    ]
    return present(*[F.when(condition, F.lit(text)) for condition, text in rules])


METRICS = {
    "return5_pct": "return5", "return20_pct": "return20", "return60_pct": "return60", "ma5": "ma5", "ma10": "ma10", "ma20": "ma20", "ma60": "ma60", "rsi14": "rsi14",
    "volume_ratio20": "volume_ratio20", "average_amount20": "avg_amount20", "latest_day_return_pct": "day_return", "atr14_pct": "atr_pct", "volatility20_pct": "volatility20",
    "drawdown20_pct": "drawdown20", "range_position20_pct": "range_position20", "turnover_rate": "turnover_rate",
}


def metric(column: str, digits: int = 2) -> Column:
    """Rounded for display, 0 for null."""
    return F.coalesce(F.round(F.col(column).cast("decimal(28,10)"), digits), F.lit(0)).cast(f"decimal(24,{digits})")


def score_latest(df: DataFrame) -> DataFrame:
    """Adds points by block, score, levels, reasons and notes to latest bars with indicators."""
    blocks = _blocks()
    points = {f"pts_{k}": F.coalesce(_first(rules, 0), F.lit(0)) for k, rules in blocks.items()}
    df = df.withColumns(points)
    total = sum((F.col(k) for k in points), F.lit(50))
    df = df.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int"))
    df = df.withColumns({"signal_level": signal_level(F.col("score")), "risk_level": risk_level(F.col("score"))})
    df = df.withColumn("filter_reasons", filter_reasons()).withColumn("eligible", F.size("filter_reasons") == 0)
    notes = {side: present(*[_first(rules, pick) for rules in blocks.values()]) for side, pick in (("bullish", 1), ("bearish", 2))}
    df = df.withColumns(notes)
    return df.withColumns({k: F.when(F.size(k) > 0, F.col(k)).otherwise(F.array(F.lit(d))) for k, d in (("bullish", DEFAULT_BULLISH), ("bearish", DEFAULT_BEARISH))})


def summary() -> Column:
    side = F.when(F.col("close").cast("double") >= F.col("ma20"), "高于").otherwise("低于")
    parts = [
        F.lit("截至"), F.col("trade_date").cast("string"), F.lit("，收盘价"), half_up(F.col("close"), 2).cast("string"), F.lit("元，近5日"), signed_percent(F.col("return5")), F.lit("、近20日"), signed_percent(F.col("return20")),
        F.lit("。当前价格"), side, _text("20日均线，RSI14为%.1f，量比约", F.col("rsi14")), shown(F.col("volume_ratio20"), 2), F.lit("，动态规则评分为"), F.col("score").cast("string"), F.lit("分。"),
    ]
    return F.concat(*parts)


def dynamic_analysis(bars: DataFrame, n: int = 260, min_bars: int = MIN_BARS) -> DataFrame:
    """One row a symbol: score, levels, eligibility, reasons, notes, metrics, price ladder and weight, from its last n
    bars; symbols with fewer than ``min_bars`` bars give none."""
    df = score_latest(latest(with_indicators(bars, n)).where(F.col("n_bars") >= min_bars))
    close2 = half_up(F.col("close"), 2)
    rounded = {k: metric(v) for k, v in METRICS.items()}
    return df.select(
        "symbol", "trade_date", "score", "signal_level", "risk_level", "eligible", "filter_reasons", "bullish", "bearish", summary().alias("summary"), F.lit(MODE).alias("mode"),
        close2.alias("latest_close"), *[v.alias(k) for k, v in price_ladder(close2).items()], suggested_weight(F.col("score"), F.col("risk_level")).alias("suggested_weight"),
        F.struct(*[v.alias(k) for k, v in rounded.items()], metric("macd_hist", 4).alias("macd_histogram"), F.col("limit_ups").alias("recent_limit_up_count"), F.col("breakout20").alias("breakout20")).alias("metrics"),
        "avg_amount20", F.col("return5").alias("return5_pct"), F.col("return20").alias("return20_pct"), "rsi14", F.col("atr_pct").alias("atr14_pct"), "volume_ratio20", "breakout20",
    )


def with_degraded(symbols: DataFrame, analysis: DataFrame) -> DataFrame:
    """Every wanted symbol; one without analysis has score 0 and unknown risk."""
    out = symbols.select("symbol").distinct().join(analysis, "symbol", "left")
    return out.withColumns({"score": F.coalesce("score", F.lit(0)), "risk_level": F.coalesce("risk_level", F.lit("UNKNOWN")), "eligible": F.coalesce("eligible", F.lit(False)), "degraded": F.col("mode").isNull()})
