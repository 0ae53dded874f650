"""Keys that are spread over tasks: averages against pandas over a million bars of one symbol, ranks with ties, and how many rows a task gets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeline.operators import apart


@pytest.fixture(autouse=True)
def all_partitions(spark):
    """Small partitions stay apart, so that what a task gets can be seen."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def largest_task(df):
    """Rows of the largest partition of a frame's last shuffle."""
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


@pytest.fixture(scope="module")
def long_bars(spark):
    """One symbol of a million bars, and a short one."""
    n = F.col("id")
    close = (100 + 20 * F.sin(n / 50) + 5 * F.sin(n / 7) + (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000)).cast("decimal(12,4)")
    one = spark.range(1_000_000).select(F.lit("600001").alias("symbol"), F.date_add(F.lit("0001-01-01").cast("date"), n.cast("int")).alias("trade_date"), close.alias("close"))
    two = spark.range(40).select(F.lit("600002").alias("symbol"), F.date_add(F.lit("2020-01-01").cast("date"), (n * 400).cast("int")).alias("trade_date"), close.alias("close"))
    return one.unionByName(two).withColumns({"high": F.col("close") + F.lit("0.5").cast("decimal(3,1)"), "low": F.col("close") - F.lit("0.25").cast("decimal(4,2)")}).cache()


def test_averages_of_a_million_bars(spark, long_bars):
    found = apart.averages_of_history(long_bars)
    got = found.where("symbol = '600001' and (n > 999000 or n < 2000 or n % 997 = 0)").drop("symbol", "trade_date").toPandas().sort_values("n").set_index("n")
    # a block is a task's least unit; without blocks one task would have all million
    assert largest_task(apart.numbered_apart(long_bars)) < 300_000
    short = found.where("symbol = '600002'").orderBy("n").select("n", "ema12", "rsi14", "atr14").collect()
    assert [r.n for r in short] == list(range(40)) and short[12].atr14 is None and short[13].atr14 is not None
    rows = long_bars.where("symbol = '600001'").orderBy("trade_date").select("close", "high", "low").toPandas().astype(float)
    close = rows["close"]
    smooth = lambda x, alpha: x.ewm(alpha=alpha, adjust=False).mean()
    macd = smooth(close, 2 / 13) - smooth(close, 2 / 27)
    diff = close.diff()
    gain, loss = smooth(diff.clip(lower=0).iloc[1:], 1 / 14), smooth((-diff).clip(lower=0).iloc[1:], 1 / 14)
    reach = pd.concat([rows["high"] - rows["low"], (rows["high"] - close.shift()).abs(), (rows["low"] - close.shift()).abs()], axis=1).max(axis=1)
    want = pd.DataFrame({"ema12": smooth(close, 2 / 13), "macd": macd, "macd_hist": macd - smooth(macd, 0.2), "rsi14": (100 - 100 / (1 + gain / loss)).reindex(close.index), "atr14": smooth(reach, 1 / 14)})
    for c in want.columns:
        own, other = got[c].astype(float), want[c].loc[got.index]
        late = got.index >= 14
        assert np.allclose(own[late], other[late], rtol=1e-9, atol=1e-9), c


def test_decay_over_blocks(spark):
    """A slow average still feels the first of several blocks, and a value that was once stays until doubles can't tell it."""
    rows = spark.range(5 * apart.BLOCK).select(F.lit("s").alias("symbol"), F.col("id").alias("n"), F.when(F.col("id") < 10, 1.0).otherwise(0.0).alias("x"))
    got = apart.ewm_apart(rows, {"slow": (F.col("x"), 0.0005, 0), "late": (F.col("x"), 0.01, 5)}).orderBy("n").toPandas()
    x = pd.Series([1.0] * 10 + [0.0] * (5 * apart.BLOCK - 10))
    assert np.allclose(got["slow"], x.ewm(alpha=0.0005, adjust=False).mean(), rtol=1e-9, atol=0)
    assert got["late"][:5].isna().all() and np.allclose(got["late"][5:], x[5:].ewm(alpha=0.01, adjust=False).mean(), rtol=1e-9, atol=0)


def test_ranks_with_ties(spark):
    rows = spark.range(200_000).select(
        (F.col("id") % 3).cast("int").alias("task_id"), F.lpad((F.col("id") * 7919 % 1_000_003).cast("string"), 6, "0").alias("symbol"), F.when(F.col("id") % 11 > 0, F.col("id") % 2 == 0).alias("eligible"),
        F.when(F.col("id") % 13 > 0, (F.col("id") % 5).cast("int")).alias("score"), F.when(F.col("id") % 17 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 4).cast("int"))).alias("trade_date"),
    )
    order = [F.desc_nulls_last("eligible"), F.desc_nulls_last("score"), F.desc_nulls_last("trade_date"), "symbol"]
    want = rows.withColumn("rank_no", F.row_number().over(Window.partitionBy("task_id").orderBy(*order)))
    got = apart.rank_apart(rows)
    assert got.exceptAll(want).count() == 0 and got.count() == 200_000
    assert largest_task(got) < 100_000


def test_empty(spark, long_bars):
    none = long_bars.where("false")
    assert apart.averages_of_history(none).count() == 0 and apart.numbered_apart(none).count() == 0


def test_histories_are_shuffled_once(spark):
    """The bars move once, by symbol and period; everything else that moves is a row a period."""
    n = F.col("id")
    close = (50 + 10 * F.sin(n / 9)).cast("decimal(12,4)")
    bars = spark.range(40_000).select((n % 10).cast("string").alias("symbol"), F.date_add(F.lit("1990-01-01").cast("date"), (n / 10).cast("int")).alias("trade_date"), close.alias("close")).withColumns({"high": F.col("close"), "low": F.col("close")})
    none, store = spark._jvm.java.util.ArrayList(), spark.sparkContext._jsc.sc().statusStore()

    def moved():
        stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = moved()
    apart.averages_of_history(bars).write.format("noop").mode("overwrite").save()
    assert 40_000 <= moved() - before < 50_000


def test_parts_of_many_blocks(spark):
    """A part of several blocks, parts of one row, and one that is empty of earlier rows."""
    sizes = [3, 1, 5000, 1, 1, 2500]
    rows = [("s", n, part, place, float(np.sin(n / 5))) for n, (part, place) in enumerate((p, i) for p, size in enumerate(sizes) for i in range(size))]
    df = spark.createDataFrame(rows, "symbol string, n long, p long, place long, x double").repartition(5)
    got = apart.ewm_apart(df, {"fast": (F.col("x"), 0.2, 0), "late": (F.col("x"), 1 / 14, 5)}, F.col("p"), F.col("place")).orderBy("n").toPandas()
    x = pd.Series([r[4] for r in rows])
    assert np.allclose(got["fast"], x.ewm(alpha=0.2, adjust=False).mean(), rtol=1e-9, atol=1e-12)
    assert got["late"][:5].isna().all() and np.allclose(got["late"][5:], x[5:].ewm(alpha=1 / 14, adjust=False).mean(), rtol=1e-9, atol=1e-12)
