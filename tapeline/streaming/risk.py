"""Risk events of a stream of ticks: each micro-batch is joined with the positions, and its events are merged into the stored ones.

Parquet has no merge, so a batch writes a new version of the days it touches, next to the old ones; readers take the newest of each day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.risk import check_ticks
from .incremental import _newest

EVENT = "event_key string, account_id long, symbol string, event_type string, level string, message string, current_price decimal(18,4), trigger_price decimal(18,4), event_time timestamp, resolved boolean"


def merge_events(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One row a key: what the later tick says, resolved if the stored event was, whichever order ticks came in."""
    both = stored.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    own = Window.partitionBy("event_key")
    kept = F.max(F.when(~F.col("_new"), F.col("resolved"))).over(own)
    latest = own.orderBy(F.desc("event_time"), F.desc("current_price"), F.desc("_new"))
    df = both.withColumns({"_kept": kept, "_turn": F.row_number().over(latest)}).where("_turn = 1")
    return df.withColumn("resolved", F.coalesce("_kept", F.lit(False))).select(stored.columns)


def stream_risk(ticks: DataFrame, positions: DataFrame, folder: str, checkpoint: str):
    """Merges the events of every micro-batch of ticks (symbol, price, tick_time) into ``folder``; returns the started query.

    Late and repeated ticks are merged by their time, so the stored events are those of all ticks in any order. A batch that
    runs again after a failure replaces its own version.
    """
    spark = ticks.sparkSession
    day = F.date_format("event_time", "yyyy-MM-dd")

    def write(batch: DataFrame, number: int) -> None:
        new = check_ticks(batch, positions)
        days = [r.day for r in batch.select(F.date_format("tick_time", "yyyy-MM-dd").alias("day")).distinct().collect()]  # those of a batch
        merged = merge_events(_stored(spark, folder, number, days), new.select(*[c.split()[0] for c in EVENT.split(", ")]))
        merged.withColumn("month", day).write.mode("overwrite").partitionBy("month").parquet(f"{folder}/version={number}")

    return ticks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _stored(spark, folder: str, before: int | None = None, days: list[str] | None = None) -> DataFrame:
    found = [path for name, path in sorted(_newest(spark, folder, before).items()) if days is None or name in days]
    return spark.read.schema(EVENT).parquet(*found) if found else spark.createDataFrame([], EVENT)


def resolve_events(keys: DataFrame, folder: str) -> None:
    """Marks events as resolved: their keys are added to those of the folder, beside the versions, so no batch is in the way."""
    keys.select("event_key").distinct().write.mode("append").parquet(f"{folder}/resolved")


def read_events(spark, folder: str) -> DataFrame:
    """The stored events; one whose key was resolved stays so, also when a later tick raises it again."""
    path = f"{folder}/resolved"
    keys = spark.read.schema("event_key string").parquet(path) if _exists(spark, path) else spark.createDataFrame([], "event_key string")
    done = keys.distinct().withColumn("_done", F.lit(True))
    return _stored(spark, folder).join(done, "event_key", "left").withColumn("resolved", F.col("resolved") | F.coalesce("_done", F.lit(False))).drop("_done")


def _exists(spark, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
