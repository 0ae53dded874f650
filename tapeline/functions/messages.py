"""Column functions on message texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def abbreviated(message: Column, length: int = 1000, blank: str = "unknown error") -> Column:
    """At most this many characters; a constant for a blank one."""
    return F.substring(F.coalesce(F.nullif(F.trim(message), F.lit("")), F.lit(blank)), 1, length)


def present(*parts: Column) -> Column:
    """An array of the parts that aren't null."""
    return F.filter(F.array(*parts), lambda x: x.isNotNull())
