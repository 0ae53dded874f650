"""Column functions on security symbols and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of the main boards, and first digits of the three exchanges.
MAIN_BOARD = ("000", "001", "002", "003", "600", "601", "603", "605")
SHANGHAI, SHENZHEN, BEIJING = ("6", "9"), ("0", "2", "3"), ("4", "8")


def is_main_board(symbol: Column) -> Column:
    return F.substring(symbol, 1, 3).isin(*MAIN_BOARD)


def exchange_name(symbol: Column) -> Column:
    """SH, SZ or else BJ."""
    first = F.substring(symbol, 1, 1)
    return F.when(first.isin(*SHANGHAI), "SH").when(first.isin(*SHENZHEN), "SZ").otherwise("BJ")


def exchange_symbol(symbol: Column) -> Column:
    """The symbol with its exchange before it; other first digits are an error."""
    first = F.substring(symbol, 1, 1)
    wrong = F.raise_error(F.concat(F.lit("unknown exchange of symbol "), F.coalesce(symbol, F.lit("null"))))
    prefix = F.when(first.isin(*SHANGHAI), "sh").when(first.isin(*SHENZHEN), "sz").when(first.isin(*BEIJING), "bj").otherwise(wrong)
    return F.concat(prefix, symbol)


def stub_exchange(symbol: Column) -> Column:
    """For securities that only bars tell of: SH if it starts with 6, else SZ."""
    return F.when(symbol.startswith("6"), "SH").otherwise("SZ")


def clean_code(raw: Column) -> Column:
    """Trimmed, without a trailing .0, padded to six."""
    plain = F.regexp_replace(F.trim(raw.cast("string")), r"\.0$", "")
    return F.when(F.length(plain) < 6, F.lpad(plain, 6, "0")).otherwise(plain)


def is_st(name: Column) -> Column:
    return F.upper(name).contains("ST") | name.contains("退")


def is_active(name: Column) -> Column:
    return ~name.contains("退")
