"""File sources and sinks: bar caches as CSV, universes as JSON, tables as Parquet by month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_SCHEMA = (
    "symbol string, trade_date date, open decimal(18,4), high decimal(18,4), low decimal(18,4), close decimal(18,4), "
    "volume bigint, amount decimal(24,4), turnover_rate decimal(10,4), adjust_type string"
)
UNIVERSE_SCHEMA = "symbol string, name string, exchange string, board string, is_st boolean, is_active boolean"


def cut(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared checkpoint folder; without that setting a local session takes a temporary folder, and
    a cluster, whose machines have none in common, is an error."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(base or "file:///tmp/checkpoints")
    return df.checkpoint(eager=True)


def write_csv_cache(bars: DataFrame, folder: str, source: str) -> None:
    """One folder of CSV files; where the bars come from is a column."""
    bars.withColumn("data_source", F.lit(source)).write.mode("overwrite").option("header", True).csv(folder)


def read_csv_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Cached bars; rows without a required value, also one that can't be read, are dropped."""
    df = spark.read.schema(BAR_SCHEMA + ", data_source string").option("header", True).option("mode", "PERMISSIVE").csv(folder)
    return df.dropna(subset=["symbol", "trade_date", "open", "high", "low", "close", "volume"])


def write_universe(universe: DataFrame, folder: str) -> None:
    universe.write.mode("overwrite").json(folder)


def read_universe(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(UNIVERSE_SCHEMA).json(folder)


def write_bars(bars: DataFrame, folder: str, files: int = 16) -> None:
    """By month of the bar, sorted by symbol, so that readers of a few days or symbols skip the rest; a month is written by
    several tasks, each of a part of its symbols."""
    df = bars.withColumn("month", F.date_format("trade_date", "yyyy-MM"))
    df.repartition("month", F.pmod(F.xxhash64("symbol"), F.lit(files))).sortWithinPartitions("month", "symbol", "trade_date").write.mode("overwrite").partitionBy("month").parquet(folder)


def write_clustered(bars: DataFrame, name: str, folder: str, buckets: int = 64) -> None:
    """A table of bars in buckets of symbols, a file each, sorted by symbol and date: windows over a symbol's bars need no shuffle.

    The table lies in ``folder``; another session opens it there by ``open_clustered``.
    """
    dealt = bars.repartition(buckets, "symbol")  # as buckets are dealt, so that a task writes a single file
    dealt.write.format("parquet").mode("overwrite").option("path", folder).bucketBy(buckets, "symbol").sortBy("symbol", "trade_date").saveAsTable(name)


def open_clustered(spark: SparkSession, name: str, folder: str, schema: str = BAR_SCHEMA, buckets: int = 64) -> DataFrame:
    """A table that ``write_clustered`` left in a folder."""
    spark.sql(f"create table if not exists {name} ({schema}) using parquet clustered by (symbol) sorted by (symbol, trade_date) into {buckets} buckets location '{folder}'")
    return spark.table(name)


def read_bars(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BAR_SCHEMA + ", month string").parquet(folder)
