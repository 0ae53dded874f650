"""Raw provider rows to bars and to a security universe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.symbols import clean_code, exchange_name, is_active, is_main_board, is_st

# Headers of the providers and the columns they stand for.
BAR_HEADERS = {
    "日期": "trade_date", "date": "trade_date", "开盘": "open", "open": "open", "收盘": "close", "close": "close", "最高": "high", "high": "high", "最低": "low", "low": "low",
    "成交量": "volume", "volume": "volume", "成交额": "amount", "amount": "amount", "换手率": "turnover_rate", "turnover": "turnover_rate", "涨跌幅": "change_pct",
}
CODE_HEADERS = ("code", "证券代码", "A股代码", "代码")
NAME_HEADERS = ("name", "证券简称", "A股简称", "名称")
REQUIRED = ("trade_date", "open", "high", "low", "close", "volume")
NUMBERS = ("open", "high", "low", "close", "volume", "amount", "turnover_rate", "change_pct")


def rename_headers(raw: DataFrame) -> DataFrame:
    """Known headers become the canonical names; a column whose name is taken already keeps its own."""
    taken = set(raw.columns)
    renamed = {c: BAR_HEADERS[c] for c in raw.columns if c in BAR_HEADERS and (BAR_HEADERS[c] == c or BAR_HEADERS[c] not in taken)}
    return raw.withColumnsRenamed({k: v for k, v in renamed.items() if k != v})


def normalize_bars(raw: DataFrame, sequence: str, min_rows: int = 80, listing: str | None = None) -> DataFrame:
    """symbol, trade_date and numbers as doubles, by date; raw also has ``symbol`` and ``provider``.

    Headers are renamed, bad values become null, missing optional numbers 0. The provider ``tencent`` gives volume as
    amount when it has no volume; ``sina`` gives turnover as a share if no row of the symbol is above 1.5. Rows without a
    required value go, of equal dates the last one by ``sequence`` stays, symbols with fewer than ``min_rows`` bars go.
    Where symbols have bars of several listings, ``listing`` names the column that tells those apart: dates are equal within one listing
    then, the rest is by symbol as before. A missing required column is an error.
    """
    df = rename_headers(raw)
    if "volume" not in df.columns and "amount" in df.columns:
        volume = F.when(F.col("provider") == "tencent", F.col("amount"))
        df = df.withColumns({"volume": volume, "amount": F.when(F.col("provider") == "tencent", F.lit("0")).otherwise(F.col("amount").cast("string"))})
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    number = {c: F.col(c).try_cast("double") if c in df.columns else F.lit(0.0) for c in NUMBERS}
    df = df.withColumns(number | {"trade_date": F.col("trade_date").cast("string").try_cast("date")})
    largest = F.max(F.abs("turnover_rate")).over(Window.partitionBy("symbol"))
    df = df.withColumn("turnover_rate", F.when((F.col("provider") == "sina") & (largest <= 1.5), F.col("turnover_rate") * 100).otherwise(F.col("turnover_rate")))
    # NaN is missing too
    df = df.dropna(subset=list(REQUIRED))
    newest = Window.partitionBy("symbol", *([listing] if listing else []), "trade_date").orderBy(F.desc_nulls_last(sequence))
    df = df.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1")
    df = df.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).where(F.col("_rows") >= min_rows)
    return df.select("symbol", "provider", "trade_date", *NUMBERS)


def normalize_universe(raw: DataFrame, include_st: bool = True) -> DataFrame:
    """symbol, name, exchange, board, is_st, is_active of main-board securities, once each, by symbol.

    The code and name columns are found by their headers, and a missing one is an error; codes are trimmed and padded, those
    that aren't digits go; a blank name becomes the symbol. An empty result is left to ``require_rows``, as a plan can't know it.
    """
    code = next((c for c in CODE_HEADERS if c in raw.columns), None)
    name = next((c for c in NAME_HEADERS if c in raw.columns), None)
    if code is None or name is None:
        raise ValueError(f"no column with codes or names: {', '.join(raw.columns)}")
    symbol = clean_code(F.col(code))
    given = F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))
    df = raw.select(symbol.alias("symbol"), given.alias("given")).where(F.col("symbol").rlike(r"^\d{6}$") & is_main_board(F.col("symbol")))
    df = df.groupBy("symbol").agg(F.max("given").alias("given")).withColumn("name", F.coalesce("given", "symbol")).drop("given")
    df = df.withColumns({"exchange": exchange_name(F.col("symbol")), "board": F.lit("MAIN"), "is_st": is_st(F.col("name")), "is_active": is_active(F.col("name"))})
    return df if include_st else df.where(~F.col("is_st"))


def require_rows(universe: DataFrame) -> DataFrame:
    """The universe, or an error if it has no row; reads one row."""
    if not universe.head(1):
        raise ValueError("no main-board security is left")
    return universe


def active_universe(universe: DataFrame, limit: int | None = None) -> DataFrame:
    """Active main-board securities that aren't ST, by symbol, optionally the first few."""
    df = universe.where("is_active and not is_st and board = 'MAIN'").orderBy("symbol")
    return df.limit(limit) if limit else df
