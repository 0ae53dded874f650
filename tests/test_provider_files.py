"""A folder of bar files with broken ones, sidecars and several providers: bars, sources and errors in one read."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tapeline.sources import provider_files as P


def text(n=90, start=10.0, headers="date,open,high,low,close,volume,amount,turnover", row=lambda d, c: f"{d},{c},{c + 1},{c - 1},{c},{1000},{5000},{0.02}"):
    first = datetime.date(2023, 1, 2)
    return "\n".join([headers, *[row(first + datetime.timedelta(i), round(start + i / 10, 2)) for i in range(n)]])


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("bars")
    files = {
        "tencent/600001.csv": text(headers="date,open,high,low,close,amount", row=lambda d, c: f"{d},{c},{c},{c},{c},777"), "sina/600001.csv": text(start=50),  # tencent's amount is its volume
        "tencent/600002.csv": "date,open\n2023-01-02,1", "sina/600002.csv": text(start=20), "eastmoney/600002.csv": "broken",  # the last is never asked
        "tencent/600003.csv": text(40), "eastmoney/600003.csv": "﻿" + text(headers="日期,开盘,最高,最低,收盘,成交量,成交额,换手率"),
        "tencent/600004.csv": 'date,open,high,low,close,volume\n"unclosed', "cache/600004.csv": text(start=30), "cache/600004.json": json.dumps({"source": "AKShare-Sina"}),
        "cache/600005.csv": text(start=40), "tencent/600006.csv": text(10), "sina/600006.csv": "", "cache/600007.csv": text(), "cache/600007.json": "{not json",
    }
    for name, data in files.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(data)
    (root / "sina" / "600008.csv").write_bytes(b"date,open\xff\xfe\n")
    return f"file://{root}"


@pytest.mark.parametrize("files", [1, 64])
def test_bars_sources_and_errors(spark, folder, files):
    bars, failures = P.resolve_files(P.read_files(spark, folder, files=files))
    got = {r.symbol: (r.provider, r.data_source, r.n) for r in bars.groupBy("symbol", "provider", "data_source").agg(F.count("*").alias("n")).collect()}
    assert got == {
        "600001": ("tencent", "tencent", 90), "600002": ("sina", "sina", 90), "600003": ("eastmoney", "eastmoney", 90), "600004": ("cache", "Local-Cache(AKShare-Sina)", 90), "600005": ("cache", "Local-Cache", 90),
    }
    assert {(r.volume, r.amount) for r in bars.where("symbol = '600001'").collect()} == {(777.0, 777.0)}
    assert {r.turnover_rate for r in bars.where("symbol = '600002'").collect()} == {2.0} and {r.turnover_rate for r in bars.where("symbol = '600003'").collect()} == {0.02}
    told = {(r.symbol, r.provider): (r.error_message.split(":")[0].split(" good")[0], r.resolved) for r in failures.collect()}
    assert told == {
        ("600002", "tencent"): ("ValueError", True), ("600003", "tencent"): ("fewer than 80", True), ("600004", "tencent"): ("Error", True), ("600006", "tencent"): ("fewer than 80", False),
        ("600006", "sina"): ("ValueError", False), ("600007", "cache"): ("JSONDecodeError", False), ("600008", "sina"): ("UnicodeDecodeError", False),
    }


def test_named_symbols_open_no_other_files(spark, folder):
    parts = lambda *symbols: P.read_files(spark, folder, files=1, symbols=list(symbols) or None).rdd.getNumPartitions()
    assert parts("600005") == 1 and parts("600005", "600001") == 3 and parts() == 14
    raw = P.read_files(spark, folder)
    assert raw.where("symbol = '600005' and trade_date = '2023-01-05'").count() == 1 and raw.select("symbol").distinct().count() == 8
    assert P.read_files(spark, folder, ("none",)).count() == 0
