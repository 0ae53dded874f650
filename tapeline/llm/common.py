"""Helpers that several training-data operators share.

Text operators look at UTF-8 bytes. ``Rolling`` hashes any stretch of a byte array in constant time after one
pass: each byte becomes a random 64-bit number, weighted by a power of an odd multiplier, and prefix sums modulo
2^64 are subtracted. Two different stretches collide with a chance of about 2^-64 per pair.
"""

from __future__ import annotations

import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
NO_ID = np.iinfo(np.int64).max  # a null doc_id counts as the largest one
_RNG = np.random.Generator(np.random.PCG64(20240817))
BYTE_CODE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
STEP_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, named by a path that only Spark has to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(df: DataFrame) -> SparkSession:
    """The session of a frame, with this repository on the path of its Python workers."""
    spark = df.sparkSession
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the shared checkpoint folder. Where the setting is missing, a local session gets a
    temporary folder; a cluster, whose machines have no such folder in common, is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared checkpoint folder, so that lost executors lose nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def pick(df: DataFrame, **names: str) -> DataFrame:
    """The columns of exactly these names, renamed; other columns, also those that differ by case alone, go."""
    at = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_{at[c]}").alias(new) for new, c in names.items()])


def keyed(df: DataFrame, key: str) -> DataFrame:
    """Adds a key of each row's content: rows of one key are equal in all columns, but for a chance of 2^-64 per pair.

    It needs no order, so it is the same at each reading, also where doc_id is null or repeated. Columns that hold maps or variants,
    which have no hash, count by their JSON. Names are those of the frame, without dots or twins.
    """
    hashed = lambda c, kind: F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else F.col(c)
    parts = [x for c, kind in df.dtypes for x in (hashed(c, kind), F.col(c).isNull())]
    return df.withColumn(key, F.xxhash64(*parts))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks_for(docs: DataFrame, column: str, chunk_bytes: int) -> int:
    """How many chunks of about chunk_bytes the column fills; at least two for each shuffle partition."""
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(2 * shuffle_partitions(docs.sparkSession), -(-total // chunk_bytes))


def chunked(docs: DataFrame, n: int) -> DataFrame:
    """Rows dealt evenly to n chunks by a hash of id and text, whatever the ids look like."""
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def powers(step: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, step, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Hashes of stretches of codes (uint64)."""

    kept = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))  # powers, for arrays of up to a million

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        steps, inverse = Rolling.kept
        if len(inverse) <= n:
            steps, inverse = powers(STEP, max(n, 1 << 17) + 1), powers(STEP_INVERSE, max(n, 1 << 17) + 1)
            if n <= 1 << 20:
                Rolling.kept = steps, inverse
        self.inverse = inverse[: n + 1]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * steps[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def every(self, length: int) -> np.ndarray:
        """The hash of each stretch of this length, by start."""
        n = max(0, len(self.sums) - length)
        return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n]) if n else np.zeros(0, np.uint64)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbouring values, by start, in log2(width) passes."""
    reach = 1
    while reach < width:
        more = min(reach, width - reach)
        values = np.minimum(values[: len(values) - more], values[more:])
        reach += more
    return values


def leftmost_least(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each width neighbouring hashes, by start: the position of the least one, the leftmost of equal ones.

    Equal stretches give the same relative position, so that rows which share a stretch share the chosen part.
    """
    low = np.uint64((1 << 30) - 1)
    at = np.arange(len(hashes), dtype=np.uint64)
    return (least_of((hashes & ~low) | at, width) & low).astype(np.int64)


def ids_of(column) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy()


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one byte array, a space after each; the start and end of each."""
    parts = [x or b"" for x in texts]
    size = np.fromiter((len(x) for x in parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    return np.frombuffer(b" ".join(parts) + b" ", np.uint8), end - size, end
