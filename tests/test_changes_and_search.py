"""A scan kept up to date against a full one, and search through the index against a scan of all names."""

import random

import pytest
from pyspark.sql import functions as F

from tapeline.operators import search
from tapeline.operators.normalize import normalize_universe
from tapeline.plans import scan as P
from tapeline.sources import files
from tapeline.sources.fixtures import bars, names, raw_universe

SF = "/root/testdata/sf0.001"
COLUMNS = ["symbol", "name", "score", "eligible", "trade_date", "latest_close", "rank_no"]


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("seed", range(2))
def test_rescan(spark, tmp_path, seed):
    """Random deltas: new days, corrected bars, symbols that come and go."""
    rng = random.Random(seed)
    universe = normalize_universe(raw_universe(spark, SF))
    files.write_clustered(bars(spark, SF), f"all_bars_{seed}", f"file://{tmp_path}/bars", buckets=5)
    own = spark.table(f"all_bars_{seed}")
    symbols = sorted(r.symbol for r in own.select("symbol").distinct().collect())
    touched, new = rng.sample(symbols, 3), rng.choice(symbols)
    was = own.where(~F.col("symbol").isin(touched) | (F.col("trade_date") < "1998-05-01"))
    before = P.scan(was, universe.where(F.col("symbol") != new)).cache()
    changed = spark.createDataFrame([(s,) for s in touched], "symbol string")
    gone = universe.where(F.col("symbol") != symbols[0])
    got = P.rescan(before, own, gone, changed)
    assert same(got.select(COLUMNS), P.scan(own, gone).select(COLUMNS))
    few = own.where(F.col("symbol").isin(touched))
    assert 0 < few.count() < 0.7 * own.count()  # the bars that a scan of these changes looks at
    assert same(P.rescan(before, own, gone, changed, most_listed=1).select(COLUMNS), P.scan(own, gone).select(COLUMNS))
    spark.sql(f"drop table all_bars_{seed}")


def test_search(spark, tmp_path):
    universe = names(spark, SF).unionByName(spark.createDataFrame([("999999", "平安银行"), ("999998", "100%_sure"), ("999997", "A"), ("999996", None), ("999995", "")], "symbol string, name string")).cache()
    search.write_index(search.build_index(universe), f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    total = index.count()
    for keyword in ["平安", "00%1", "0_1", "Customer#0000000_1", "9", "", "%", "_", "a%_", "zz", "000", "99999", "安银", "10%9", "e#%1%2", "100\\%\\_s", "\\%\\_"]:
        want = universe.where(F.col("symbol").like(f"%{keyword}%") | F.col("name").like(f"%{keyword}%"))
        got = search.search(universe, index, keyword)
        assert same(got, want), keyword
        pairs = search.pattern_pairs(keyword)
        if pairs:
            assert index.where(F.col("pair").isin(pairs)).count() <= total * 0.8
    assert search.candidates(index, search.pattern_pairs("平安")).count() == 1
    assert search.search(universe.where("false"), index, "平安").count() == 0
