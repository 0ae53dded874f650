"""Where rows go: keys of a fold apart from each other, upserts in partitions by size, events numbered in groups."""

from pyspark.sql import functions as F

from tapeline.operators import folds, merge
from tapeline.sources import fixtures

DIR = "/root/testdata/sf0.001"


def test_few_keys_have_a_partition_each(spark):
    rows = spark.range(4000).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 7 != 3, F.col("id") % 7).cast("string").alias("b"), "id")
    placed = folds.spread(rows, ["a", "b"]).withColumn("p", F.spark_partition_id())
    assert placed.count() == 4000
    assert placed.groupBy("p").agg(F.count_distinct("a").alias("n")).agg(F.max("n")).first()[0] == 1
    many = folds.spread(rows, ["id"])
    assert many.rdd.getNumPartitions() == 32 and many.count() == 4000


def test_partitions_of_an_upsert_grow_with_its_rows(spark):
    parts = [merge.parted(spark.range(n).withColumn("v", F.lit(1)), ["id"]).rdd.getNumPartitions() for n in (10, 8_000_000)]
    assert parts[0] == 8 and parts[1] > 8


def test_events_are_numbered_as_by_a_window(spark):
    want = fixtures.from_table(spark, DIR, fixtures.EVENTS, "orders")
    got = fixtures.account_events(spark, DIR)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
