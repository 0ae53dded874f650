"""Search of securities by parts of their symbol or name, through an index of character pairs.

The index has a row for each pair of neighbouring characters of a security's symbol or name. A pattern's pairs, those of its stretches without
wildcards, name rows of the index; securities that have all of them are candidates, and the pattern itself decides. Written sorted by pair, the
index is read in as many row groups as the pattern has pairs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("symbol", "name")


def _pairs(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))


def build_index(universe: DataFrame) -> DataFrame:
    """field, pair, symbol: each pair of characters of each security's symbol and name, once."""
    both = [universe.select(F.lit(f).alias("field"), F.explode(_pairs(F.col(f))).alias("pair"), "symbol") for f in FIELDS]
    return both[0].unionByName(both[1]).where(F.char_length("pair") == 2)


def write_index(index: DataFrame, folder: str, files: int = 8) -> None:
    """Sorted by pair, in ranges, so that a reader of some pairs skips the rest."""
    index.repartitionByRange(files, "pair", "field").sortWithinPartitions("pair", "field").write.mode("overwrite").option("parquet.block.size", 1 << 20).parquet(folder)


def pattern_pairs(keyword: str) -> list[str]:
    """The different pairs that every text which holds the LIKE pattern has; a backslash takes the next character as it is."""
    pieces = re.findall(r"\\(.)|([%_])|(.)", keyword, re.S)
    runs, run = [], ""
    for kept, wildcard, plain in pieces:
        if wildcard:
            runs, run = [*runs, run], ""
        else:
            run += kept or plain
    return sorted({r[i : i + 2] for r in [*runs, run] for i in range(len(r) - 1)})


def candidates(index: DataFrame, pairs: list[str]) -> DataFrame:
    """Symbols of which one field has all pairs."""
    own = index.where(F.col("pair").isin(pairs)).groupBy("symbol", "field").agg(F.count_distinct("pair").alias("k"))
    return own.where(F.col("k") == len(pairs)).select("symbol").distinct()


def search(universe: DataFrame, index: DataFrame, keyword: str) -> DataFrame:
    """Securities whose symbol or name holds the keyword, a LIKE pattern; the same rows as a scan gives. A keyword without two characters
    in a row names no pairs, so that all securities are looked at."""
    like = F.col("symbol").like(f"%{keyword}%") | F.col("name").like(f"%{keyword}%")
    pairs = pattern_pairs(keyword)
    return (universe.join(candidates(index, pairs), "symbol", "left_semi") if pairs else universe).where(like)
