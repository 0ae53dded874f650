"""Full-market scan and its validation, each one lazy plan."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prices import by_value
from ..operators.backtest import Rules, backtest_summary, failed_symbols, local_bars
from ..operators.normalize import active_universe
from ..operators.score import MIN_BARS, dynamic_analysis

THRESHOLD = 60
STRATEGY = "DYNAMIC_SCAN"


def rank_results(results: DataFrame) -> DataFrame:
    """Adds rank_no in each task: eligible first, then score, date and symbol."""
    order = Window.partitionBy("task_id").orderBy(F.desc("eligible"), F.desc("score"), F.desc("trade_date"), "symbol")
    return results.withColumn("rank_no", F.row_number().over(order))


def scan(bars: DataFrame, universe: DataFrame, task_id: int = 1, n: int = 260) -> DataFrame:
    """Ranked analyses of all active securities.

    Bars are cut to the universe by a semi-join before any window; everything per symbol shares one shuffle.
    """
    wanted = active_universe(universe).select("symbol", "name")
    analysed = dynamic_analysis(bars.join(wanted.select("symbol"), "symbol", "left_semi"), n)
    return rank_results(analysed.join(wanted, "symbol").withColumn("task_id", F.lit(task_id)))


def rescan(previous: DataFrame, bars: DataFrame, universe: DataFrame, changed: DataFrame, task_id: int = 1, n: int = 260, most_listed: int = 1000) -> DataFrame:
    """What ``scan`` gives now, from the results of an earlier one and the symbols whose bars changed since (column symbol).

    Only changed symbols are analysed, and those of the universe that had no result; the others keep theirs, and all are ranked anew. As many as
    ``most_listed`` symbols are named in the filter of the bars, which lets a table in buckets or sorted files skip the rest; they are symbols
    of a market, not of its history, so the list is short.
    """
    wanted = active_universe(universe).select("symbol", "name")
    again = changed.select("symbol").union(wanted.join(previous, "symbol", "left_anti").select("symbol")).distinct().join(wanted, "symbol", "left_semi")
    listed = [r.symbol for r in again.limit(most_listed + 1).collect()]
    own = bars.where(F.col("symbol").isin(listed)) if len(listed) <= most_listed else bars.join(again, "symbol", "left_semi")
    kept = previous.drop("name", "rank_no", "task_id").join(again, "symbol", "left_anti")
    fresh = dynamic_analysis(own, n)
    return rank_results(kept.unionByName(fresh.select(kept.columns)).join(wanted, "symbol").withColumn("task_id", F.lit(task_id)))


def scan_failures(bars: DataFrame, universe: DataFrame, task_id: int = 1) -> DataFrame:
    """Active securities that can't be analysed, and why."""
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    short = active_universe(universe).select("symbol", "name").join(n, "symbol", "left").where(F.coalesce("n_bars", F.lit(0)) < MIN_BARS)
    return short.select(F.lit(task_id).alias("task_id"), "symbol", "name", F.format_string("only %d bars", F.coalesce("n_bars", F.lit(0))).alias("error_message"), F.lit(0).alias("retry_count"), F.lit(False).alias("resolved"))


def scan_summary(results: DataFrame) -> DataFrame:
    """One row a task: symbols, selected ones, newest date."""
    return results.groupBy("task_id").agg(F.count(F.lit(1)).alias("success_symbols"), F.count_if("eligible").alias("selected_count"), F.max("trade_date").alias("trade_date"))


def signals_from_scan(results: DataFrame, limit: int = 50, scan_type: str = "FULL") -> DataFrame:
    """Signals of the best eligible results; only full scans give any."""
    good = results.where(F.lit(scan_type == "FULL") & F.col("eligible")).orderBy("rank_no").limit(limit)
    return good.select(
        "symbol", F.col("trade_date").alias("signal_date"), F.when(F.col("score") >= 75, "BUY").otherwise("WATCH").alias("action"),
        F.col("score"), F.col("latest_close").alias("reference_price"), F.col("bullish").alias("reasons"), F.col("bearish").alias("risks"), F.lit(STRATEGY).alias("strategy_code"),
    )


def plans_from_scan(results: DataFrame, limit: int = 50, valid_days: int = 2) -> DataFrame:
    """Trade plans of the best eligible results."""
    good = results.where("eligible").orderBy("rank_no").limit(limit)
    return good.select(
        "symbol", "name", F.col("trade_date").alias("plan_date"), "score", "buy_low", "buy_high", "stop_loss", "target1", "target2", "suggested_weight",
        F.lit(valid_days).alias("valid_days"), F.lit("ACTIVE").alias("status"), F.col("summary").alias("rationale"), F.col("task_id").alias("source_task_id"),
    )


def replace_plans(plans: DataFrame, new: DataFrame, as_of: date) -> DataFrame:
    """Plans of the day go, the new ones come; those have the date of their bar, which may be another."""
    from ..operators.merge import replace_where

    return replace_where(plans, F.col("plan_date") == F.lit(as_of), new)


def candidates(results: DataFrame, top_n: int = 20) -> DataFrame:
    """The best eligible results of a task by rank; all of them count when none is eligible."""
    any_eligible = F.max(F.col("eligible").cast("int")).over(Window.partitionBy("task_id"))
    ranked = results.withColumn("_any", any_eligible).where(F.col("eligible") | (F.col("_any") == 0)).drop("_any")
    place = F.row_number().over(Window.partitionBy("task_id").orderBy(F.asc_nulls_last("rank_no"), "symbol"))
    return ranked.withColumn("place", place).where(F.col("place") <= max(5, min(50, top_n)))


def validate_scan(results: DataFrame, bars: DataFrame, top_n: int = 20, hold: int = 10) -> DataFrame:
    """A back-test of each candidate on its last 180 bars; too short ones fail by themselves.

    Candidates, at most 50 a task, are found once and named in the filter of the bars, so that the scan isn't planned anew for each use.
    """
    rules = Rules(hold=max(2, min(30, hold)))
    best = candidates(results, top_n).select("task_id", "symbol", F.col("rank_no").alias("scan_rank"), F.col("score").alias("scan_score"))
    found = best.collect()
    chosen = bars.sparkSession.createDataFrame(found, best.schema)
    own = local_bars(bars.where(F.col("symbol").isin(sorted({r.symbol for r in found}))), 180)
    bad = failed_symbols(chosen, own, rules).select("symbol", "error_message")
    return chosen.join(backtest_summary(own, rules), "symbol", "left").join(bad, "symbol", "left").withColumn("status", F.when(F.col("total_return").isNull(), "FAILED").otherwise("SUCCESS"))


def validation_summary(validated: DataFrame) -> DataFrame:
    """One row a task: means over successes (0 without any), counts, and how many gained."""
    good = F.col("status") == "SUCCESS"
    mean = lambda c: by_value(F.coalesce(F.avg(F.when(good, F.col(c))), F.lit(0.0)), 8)
    return validated.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("total_symbols"), F.count_if(good).alias("success_symbols"), F.count_if(~good).alias("failed_symbols"),
        mean("total_return").alias("avg_total_return"), mean("win_rate").alias("avg_win_rate"), mean("max_drawdown").alias("avg_max_drawdown"),
        F.count_if(good & (F.col("total_return") > 0)).alias("positive_strategy_count"),
    )
