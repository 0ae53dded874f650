"""Reads over bars, securities and task tables: overview, search, latest bar, paging, latest task, histories."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .indicators import tail


def clamp(value: int | None, least: int, most: int, default: int) -> int:
    return max(least, min(most, default if value is None else value))


def page(df: DataFrame, order: list[Column | str], number: int = 1, size: int = 50) -> DataFrame:
    """A page of 10 to 200 rows; pages count from 1."""
    size = clamp(size, 10, 200, 50)
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def bars_tail(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each symbol as records: volume whole, missing amount and turnover 0."""
    zero = F.lit(0)
    return tail(bars, n).select("symbol", "trade_date", "open", "high", "low", "close", F.col("volume").cast("bigint").alias("volume"), F.coalesce("amount", zero).alias("amount"), F.coalesce("turnover_rate", zero).alias("turnover_rate"))


def history(bars: DataFrame, fetched: DataFrame, symbol: str, n: int, as_of: date) -> DataFrame:
    """The last n (30 to 3000) bars of a symbol: stored ones if there are n and the last is at most a week old, else
    with the fetched ones over them."""
    from .merge import upsert

    n = clamp(n, 30, 3000, 260)
    own = bars.where(F.col("symbol") == symbol)
    state = own.agg(F.count(F.lit(1)).alias("rows"), F.max("trade_date").alias("newest")).select(
        ((F.col("rows") >= n) & (F.col("newest") >= F.date_sub(F.lit(as_of), 7))).alias("fresh")
    )
    fresh = F.coalesce(F.col("fresh"), F.lit(False))
    more = fetched.where(F.col("symbol") == symbol).join(F.broadcast(state), how="cross").where(~fresh).drop("fresh")  # one row
    return tail(upsert(own, more, ["symbol", "trade_date", "adjust_type"]), n)


def latest_bars(bars: DataFrame) -> DataFrame:
    """The newest QFQ bar of each symbol, the one of the highest close on a day with several, by an aggregate that is combined before the shuffle."""
    newest = F.max(F.when(F.col("trade_date").isNotNull(), F.struct("trade_date", "close")))
    return bars.where("adjust_type = 'QFQ'").groupBy("symbol").agg(newest.alias("b")).select("symbol", F.col("b.trade_date").alias("latest_date"), F.col("b.close").alias("latest_price"))


def bars_as_of(bars: DataFrame, when: date) -> DataFrame:
    """The newest bar of each symbol on or before a day."""
    return latest_bars(bars.where(F.col("trade_date") <= F.lit(when)))


def search_securities(universe: DataFrame, bars: DataFrame, keyword: str = "", number: int = 1, size: int = 50) -> DataFrame:
    """A page of the active main-board securities whose symbol or name holds the keyword (as a LIKE pattern), with their latest
    bar and, on each row, the total over all pages. A page without securities is one row of nulls with the total."""
    keyword = keyword.strip()
    like = F.lit(not keyword) | F.col("symbol").like(f"%{keyword}%") | F.col("name").like(f"%{keyword}%")
    found = universe.where("is_active and board = 'MAIN'").where(like)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    own = page(found, ["symbol"], number, size).join(latest_bars(bars), "symbol", "left")
    return total.join(own, F.lit(True), "left").select(*own.columns, "total")  # one row and a page


def plans_view(plans: DataFrame, latest: DataFrame, status: str | None = None, n: int = 200) -> DataFrame:
    """The newest plans, of one status or all of them (none, blank or ALL), with their symbol's latest price and day."""
    wanted = (status or "").strip().upper()
    own = plans if wanted in ("", "ALL") else plans.where(F.col("status") == wanted)
    return own.orderBy(F.desc("plan_id")).limit(n).join(latest.select("symbol", "latest_price", "latest_date"), "symbol", "left")


# Columns of a result and the fields of its metrics that fill them; columns that hold lists.
METRIC_FIELDS = {"return_5_pct": "return5Pct", "return_20_pct": "return20Pct", "rsi14": "rsi14", "atr14_pct": "atr14Pct", "volume_ratio20": "volumeRatio20", "breakout20": "breakout20"}
LISTS = ("filter_reasons", "bullish", "bearish")


def json_list(text: Column) -> Column:
    """The elements of a JSON list as texts: strings as they are, anything else as JSON; empty where the text isn't a list."""
    element = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.to_json(x))
    return F.coalesce(F.transform(F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"), element), F.array().cast("array<string>"))


def json_object(text: Column) -> Column:
    """A JSON object as a VARIANT with all of its fields, whatever they are; an empty one where the text isn't an object."""
    parsed = F.try_parse_json(text)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed).otherwise(F.parse_json(F.lit("{}")))


def open_results(results: DataFrame) -> DataFrame:
    """Results with their JSON opened: lists as arrays, ``metrics`` as a VARIANT, and null columns filled from its fields.

    Text that is null, broken or of another kind gives an empty list or object and fills nothing; fields that aren't known stay in the object.
    """
    kinds = {c: results.schema[c].dataType.simpleString() for c in METRIC_FIELDS if c in results.columns}
    df = results.withColumns({c: json_list(F.col(c)) for c in LISTS if c in results.columns} | {"metrics": json_object(F.col("metrics"))})
    return df.withColumns({c: F.coalesce(F.col(c), F.try_variant_get("metrics", f"$.{METRIC_FIELDS[c]}", k)) for c, k in kinds.items()})


def fill_from_metrics(results: DataFrame) -> DataFrame:
    """Results whose null columns are filled from the JSON text ``metrics``, which stays as it is."""
    return open_results(results.withColumn("_text", F.col("metrics"))).drop("metrics").withColumnRenamed("_text", "metrics").select(results.columns)


# Least, most and default of what a scan task may be asked for, and of one that retries failures.
TASK_LIMITS = {"FULL": {"batch_size": (2, 30, 12), "result_limit": (10, 200, 50)}, "RETRY": {"batch_size": (2, 20, 6), "result_limit": (200, 200, 200)}}


def scan_tasks(requests: DataFrame) -> DataFrame:
    """QUEUED tasks for requests (scan_type, batch_size, result_limit): sizes inside the limits of their type, the default where null."""

    def limited(column: str) -> Column:
        kinds = {kind: F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.col(column), F.lit(default)))) for kind, own in TASK_LIMITS.items() for low, high, default in [own[column]]}
        return F.when(F.col("scan_type") == "RETRY", kinds["RETRY"]).otherwise(kinds["FULL"])

    return requests.withColumns({c: limited(c) for c in ("batch_size", "result_limit")} | {"status": F.lit("QUEUED"), "official": F.lit(False)})


def wanted_symbols(requests: DataFrame, position: str = "position") -> DataFrame:
    """The symbols of a request, each once, in the order in which they first occur."""
    return requests.groupBy("symbol").agg(F.min(position).alias(position)).orderBy(position)


def batch_items(results: DataFrame) -> DataFrame:
    """Analyses of a batch in the order in which they are answered: score down, then symbol; without a score as 0."""
    return results.orderBy(F.desc(F.coalesce("score", F.lit(0))), "symbol")


def overview(universe: DataFrame, bars: DataFrame) -> DataFrame:
    """One row: securities, active ones, bars, symbols with bars, and the newest date."""
    u = universe.agg(F.count(F.lit(1)).alias("securities"), F.count_if("is_active").alias("active"), F.count_if(F.col("is_active") & ~F.col("is_st")).alias("tradable"))
    b = bars.agg(F.count(F.lit(1)).alias("bars"), F.countDistinct("symbol").alias("symbols_with_bars"), F.max("trade_date").alias("latest_trade_date"))
    return u.join(b, how="cross")  # one row each


def task_history(tasks: DataFrame, failures: DataFrame, n: int = 20) -> DataFrame:
    """The newest tasks with the number of their unresolved failures."""
    open_ = failures.where("not resolved").groupBy(F.col("task_id").alias("id")).agg(F.count(F.lit(1)).alias("unresolved_failures"))
    return tasks.join(open_, "id", "left").withColumn("unresolved_failures", F.coalesce("unresolved_failures", F.lit(0))).orderBy(F.desc("id")).limit(clamp(n, 1, 100, 20))


def latest_task(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy(F.desc("id")).limit(1)


def latest_official(tasks: DataFrame) -> DataFrame:
    """The newest completed official task; if there is none, the newest completed one."""
    return tasks.where("status = 'COMPLETED'").orderBy(F.desc("official"), F.desc("id")).limit(1)


def task_results(results: DataFrame, task_id: int, n: int = 100, eligible_only: bool = False) -> DataFrame:
    """Results of a task, eligible ones first, by rank."""
    own = results.where(F.col("task_id") == task_id)
    return (own.where("eligible") if eligible_only else own).orderBy(F.desc("eligible"), F.asc("rank_no")).limit(clamp(n, 1, 500, 100))


def latest_results(tasks: DataFrame, results: DataFrame, n: int = 100) -> DataFrame:
    """Results of the latest official task."""
    return results.join(latest_official(tasks).select(F.col("id").alias("task_id")), "task_id", "left_semi").orderBy(F.desc("eligible"), F.asc("rank_no")).limit(clamp(n, 1, 500, 100))


def failures_with_names(failures: DataFrame, universe: DataFrame) -> DataFrame:
    """Failures, open ones first, with the security's name where they have none."""
    names = universe.select("symbol", F.col("name").alias("_name"))
    return failures.join(names, "symbol", "left").withColumn("name", F.coalesce("name", "_name", "symbol")).drop("_name").orderBy("resolved", "symbol")


def retry_symbols(failures: DataFrame, task_id: int) -> DataFrame:
    """Symbols of a task's open failures, each once, in order, for a retry task."""
    return failures.where((F.col("task_id") == task_id) & ~F.col("resolved")).select("symbol").distinct().orderBy("symbol")


def after_retry(failures: DataFrame, succeeded: DataFrame, task_id: int) -> DataFrame:
    """Failures of the task whose symbol now succeeded are resolved, and count one retry more."""
    good = succeeded.select("symbol").distinct().withColumn("_good", F.lit(True))
    mine = F.coalesce(F.col("_good"), F.lit(False)) & (F.col("task_id") == task_id) & ~F.col("resolved")
    out = failures.join(good, "symbol", "left").withColumn("_mine", mine)
    return out.withColumns({"retry_count": F.col("retry_count") + F.col("_mine").cast("int"), "resolved": F.col("resolved") | F.col("_mine")}).drop("_good", "_mine")
