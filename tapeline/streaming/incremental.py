"""Streaming: incremental bars into a table of bars, and daily bars from an event stream.

A corrected or late bar overwrites the stored one by key. Parquet has no merge, so each micro-batch writes a new version of
the months it touches, next to the old ones, and readers take the newest version of each month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.indicators import tail
from ..operators.merge import correct, upsert

KEYS = ["symbol", "trade_date", "adjust_type"]


def incremental_update(base: DataFrame, delta: DataFrame, window: int = 90) -> DataFrame:
    """base with the last bars (90 of each symbol) of delta over it. Bars that share a symbol and day are bars of their own, see ``correct``;
    columns that delta lacks stay as they are."""
    return correct(base, tail(delta, window), KEYS)


def update_counters(base: DataFrame, delta: DataFrame, wanted: DataFrame, window: int = 90) -> DataFrame:
    """One row a wanted symbol: bars that came, bars that are new, and its newest date; 0 bars is a failure."""
    new = tail(delta, window)
    fresh = new.join(base.select(*KEYS), KEYS, "left_anti").groupBy("symbol").agg(F.count(F.lit(1)).alias("inserted_bars"))
    came = new.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.max("trade_date").alias("latest_trade_date"))
    df = wanted.select("symbol").distinct().join(came, "symbol", "left").join(fresh, "symbol", "left")
    return df.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("bars", "inserted_bars")}).withColumn("failed", F.col("bars") == 0)


def stream_bars(stream: DataFrame, folder: str, checkpoint: str, window: int = 90):
    """Writes every micro-batch of a stream of bars as a version of the months it touches; returns the started query.

    Batches are numbered by Spark, so a batch that runs again after a failure replaces its own version.
    """
    spark = stream.sparkSession
    month = F.date_format("trade_date", "yyyy-MM")

    def write(batch: DataFrame, number: int) -> None:
        new = tail(batch, window)
        touched = [r.month for r in new.select(month.alias("month")).distinct().collect()]  # a few months
        old = read_bars(spark, folder, batch.schema, before=number, months=touched)
        upsert(old, new, KEYS).withColumn("month", month).repartition("month", F.pmod(F.xxhash64("symbol"), F.lit(16))).write.mode("overwrite").partitionBy("month").parquet(f"{folder}/version={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest(spark, folder: str, before: int | None) -> dict[str, str]:
    """The folder of each month's newest complete version; a listing of names, no data."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda path: [f.getPath().getName() for f in fs.listStatus(hadoop(path))] if fs.exists(hadoop(path)) else []
    found: dict[str, str] = {}
    for version in sorted(int(x.split("=")[1]) for x in names(folder) if x.startswith("version=")):
        inside = names(f"{folder}/version={version}")
        if (before is None or version < before) and "_SUCCESS" in inside:
            found |= {x.split("=")[1]: f"{folder}/version={version}/{x}" for x in inside if x.startswith("month=")}
    return found


def read_bars(spark, folder: str, schema, before: int | None = None, months: list[str] | None = None) -> DataFrame:
    """The table of bars (as it was before a batch, or some months of it); empty if there is none."""
    found = [path for month, path in sorted(_newest(spark, folder, before).items()) if months is None or month in months]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def ohlc(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Open, high, low, close, total and count of event values by user and time window; for tables and streams.

    With ``late``, a stream's windows close that long after their end (watermark). Equal times: smaller event_id first.
    """
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    df = df.withWatermark("ts", late) if late else df
    at = F.struct("ts", "event_id")
    out = df.groupBy("user_id", F.window("ts", width).alias("w")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("n")
    )
    return out.select("user_id", F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "n")
