"""Bar files of several providers as one Spark source, with what could not be read as rows of their own.

A folder holds ``<provider>/<symbol>.csv`` and maybe ``<symbol>.json`` beside it, whose ``source`` tells where a cached file came from. ``format("bar_files")``
reads the files as they are, texts under the canonical headers, some symbols a task; a file that can't be read is a row with an error. ``resolve_files`` makes
bars of it: normalised, each symbol from its first provider that gives enough, and the failures of the others.
"""

from __future__ import annotations

import csv
import io
import json
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.merge import resolve_source
from ..operators.normalize import BAR_HEADERS, NUMBERS, REQUIRED, normalize_bars

# The order in which providers are asked, and the name of a cached file's source.
PROVIDERS = ("tencent", "sina", "eastmoney", "cache")
CACHE = "Local-Cache"
TEXTS = ("trade_date", *NUMBERS)
RAW = "symbol string, provider string, priority int, data_source string, seq int, " + ", ".join(f"{c} string" for c in TEXTS) + ", error string"


@dataclass
class _Files(InputPartition):
    names: list[tuple[str, str, str | None]]  # provider, file, sidecar


class BarFiles(DataSource):
    """``path``: the folder; ``providers``: their order, by commas; ``files``: how many files a task reads; ``symbols``: those whose files
    are opened, by commas, if not all. (An option and not a pushed filter, as Spark keeps the partitions of a loaded frame, filtered or not.)"""

    @classmethod
    def name(cls) -> str:
        return "bar_files"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> BarFilesReader:
        return BarFilesReader(self.options)


class BarFilesReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.order = options["path"], options.get("providers", ",".join(PROVIDERS)).split(",")
        self.files, self.symbols = int(options.get("files", "64")), set(options["symbols"].split(",")) if "symbols" in options else None

    def partitions(self):
        store, place = fs.FileSystem.from_uri(self.path)
        found = []
        for provider in self.order:
            names = {x.base_name: x.path for x in store.get_file_info(fs.FileSelector(f"{place}/{provider}", allow_not_found=True)) if x.is_file}
            for name, path in names.items():
                if name.endswith(".csv") and (self.symbols is None or name[:-4] in self.symbols):
                    found.append((provider, path, names.get(f"{name[:-4]}.json")))
        found.sort(key=lambda x: x[1].rsplit("/", 1)[1])  # files of a symbol together
        return [_Files(found[i : i + self.files]) for i in range(0, len(found), self.files)] or [_Files([])]

    def read(self, partition):
        store, _ = fs.FileSystem.from_uri(self.path)
        for provider, path, sidecar in partition.names:
            symbol = path.rsplit("/", 1)[1][:-4]
            head = (symbol, provider, self.order.index(provider))
            try:
                source = _source(store, provider, sidecar)
                rows = list(_rows(store.open_input_file(path).readall()))
            except Exception as error:  # whatever is wrong with a file is told, and the others are read
                yield (*head, None, None, *[None] * len(TEXTS), f"{type(error).__name__}: {error}"[:1000])
                continue
            for i, row in enumerate(rows):
                yield (*head, source, i, *row, None)


def _source(store, provider: str, sidecar: str | None) -> str:
    if provider != "cache":
        return provider
    return f"{CACHE}({json.loads(store.open_input_file(sidecar).readall()).get('source', 'unknown')})" if sidecar else CACHE


def _rows(data: bytes):
    """The texts of a CSV file under the canonical headers; a required one that is missing is an error."""
    lines = csv.reader(io.StringIO(data.decode("utf-8-sig")), strict=True)
    headers = [BAR_HEADERS.get(h.strip(), "") for h in next(lines, [])]
    missing = [c for c in REQUIRED if c not in headers and not (c == "volume" and "amount" in headers)]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    at = [headers.index(c) if c in headers else None for c in TEXTS]
    for line in lines:
        if line:
            yield [line[i] if i is not None and i < len(line) else None for i in at]


def read_files(spark: SparkSession, folder: str, providers: tuple[str, ...] = PROVIDERS, files: int = 64, symbols: list[str] | None = None) -> DataFrame:
    """The raw rows and errors of a folder of bar files, of all symbols or of some."""
    spark.dataSource.register(BarFiles)
    options = {"path": folder, "providers": ",".join(providers), "files": str(files)} | ({"symbols": ",".join(symbols)} if symbols is not None else {})
    return spark.read.format("bar_files").options(**options).load()


def resolve_files(raw: DataFrame, providers: tuple[str, ...] = PROVIDERS, min_rows: int = 80) -> tuple[DataFrame, DataFrame]:
    """Bars, each symbol's from its first provider with at least ``min_rows`` good ones, with data_source; and failures (symbol, provider,
    error_message, resolved) of files that gave none, resolved where a later provider did."""
    good = None
    for i, provider in enumerate(providers):
        own = raw.where((F.col("provider") == provider) & F.col("error").isNull())
        # a provider without volume sends no text there, and its amount counts
        has = own.withColumn("volume", F.when(F.col("provider") == "tencent", F.coalesce("volume", "amount")).otherwise(F.col("volume")))
        part = normalize_bars(has.drop("priority", "data_source", "error"), sequence="seq", min_rows=min_rows).withColumn("priority", F.lit(i))
        good = part if good is None else good.unionByName(part)
    bars = resolve_source(good)
    files = raw.groupBy("symbol", "provider", "priority").agg(F.max("data_source").alias("data_source"), F.max("error").alias("error"), F.count("seq").alias("rows"))
    gave = good.select("symbol", "provider").distinct().withColumn("_gave", F.lit(True))
    used = bars.groupBy("symbol").agg(F.first("priority").alias("_used"))
    failed = files.join(gave, ["symbol", "provider"], "left").where("_gave is null").join(used, "symbol", "left")
    tried = failed.where(F.col("_used").isNull() | (F.col("priority") < F.col("_used")))  # later ones were never asked
    failures = tried.select("symbol", "provider", F.coalesce("error", F.format_string("fewer than %d good rows of %d", F.lit(min_rows), F.col("rows"))).alias("error_message"), F.col("_used").isNotNull().alias("resolved"))
    return bars.join(files.select("symbol", "provider", "data_source"), ["symbol", "provider"]).drop("priority"), failures
