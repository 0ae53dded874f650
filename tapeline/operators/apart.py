"""Numbers, ranks and exponential averages of keys that are too long for one task.

A window over a key sorts all its rows in one task. Here a key's rows are cut into groups that are known beforehand, each group is
windowed by itself, and what crosses groups is a table of one row a group: counts that become offsets, and block ends that become the next
block's start. So a key of any length is spread over tasks, and the only window over a whole key is over its groups.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import of_day
from .merge import parted

#: Bars of a block; the weights of an exponential average of alpha up to 0.45 stay in range over so many.
BLOCK = 1024


def number_apart(rows: DataFrame, keys: list[str], coarse: list[tuple[Column, bool]], fine: list[Column], name: str = "n") -> DataFrame:
    """Adds the place from 0 of each row of its key, ordered by the coarse values (value, whether it falls) and then by ``fine``.

    Rows of equal coarse values are numbered in one task each. Nulls of coarse values come last.
    """
    df = rows.withColumns({f"_g{i}": value for i, (value, _) in enumerate(coarse)})
    groups = [f"_g{i}" for i in range(len(coarse))]
    order = [F.desc_nulls_last(g) if falls else F.asc_nulls_last(g) for g, (_, falls) in zip(groups, coarse, strict=True)]
    counts = df.groupBy(*keys, *groups).agg(F.count(F.lit(1)).alias("_k"))
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = counts.withColumn("_before", F.sum("_k").over(upto) - F.col("_k")).drop("_k")
    for c in (*keys, *groups):
        before = before.withColumnRenamed(c, f"_o{c}")
    same = [F.col(c).eqNullSafe(F.col(f"_o{c}")) for c in (*keys, *groups)]
    local = df.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, *groups).orderBy(*fine)) - 1)
    return local.join(before, same).withColumn(name, F.col("_before") + F.col("_local")).select(*rows.columns, name)


def rank_apart(results: DataFrame) -> DataFrame:
    """As ``plans.scan.rank_results``: rank_no in each task, eligible first, then score, date and symbol; results of one score, date and
    symbol prefix share a task, not all of them."""
    coarse = [(F.col("eligible"), True), (F.col("score"), True), (F.col("trade_date"), True), (F.substring("symbol", 1, 4), False)]
    return number_apart(results, ["task_id"], coarse, [F.col("symbol")], "_n").withColumn("rank_no", (F.col("_n") + 1).cast("int")).drop("_n")


def numbered_apart(bars: DataFrame, name: str = "n") -> DataFrame:
    """The place of each bar among its symbol's, from 0; a task holds a symbol's bars of 1,024 days at most."""
    period = F.floor(F.unix_date("trade_date") / BLOCK)
    return number_apart(bars, ["symbol"], [(period, False)], [F.col("trade_date"), *of_day(bars)], name)


def ewm_apart(rows: DataFrame, averages: dict[str, tuple[Column, float, int]], part: Column | None = None, place: Column | None = None) -> DataFrame:
    """Adds exponential averages to rows with symbol and n: y = (1 - alpha) y + alpha x from y = x at a first n, null before.

    ``averages`` names (x, alpha, first). Rows of one symbol and ``part`` share a task, in blocks by their ``place`` in it, from 0; without
    those a part is a block. A block's average is a closed form over its own rows plus the decayed average at the end of the
    block before. That end is a sum over the ends of earlier blocks, each more decayed: a scan of the table of blocks, in steps that double.
    Only that table moves if the rows are shuffled by symbol and part already.
    """
    least = BLOCK if part is None else 1  # rows of a block that another follows
    part, place = (F.floor(F.col("n") / BLOCK), F.col("n") % BLOCK) if part is None else (part, place)
    df = rows.withColumns({"_part": part, "_sub": F.floor(place / BLOCK).cast("int"), "_at": place % BLOCK})
    j, running = F.col("_at"), Window.partitionBy("symbol", "_part", "_sub").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    local = {}
    for name, (x, alpha, first) in averages.items():
        weight = F.when(F.col("n") == first, x).when(F.col("n") > first, x * alpha).otherwise(F.lit(0.0))
        local[f"_l_{name}"] = F.sum(weight * F.pow(F.lit(1 - alpha), -j)).over(running) * F.pow(F.lit(1 - alpha), j)
    df = df.withColumns(local)
    keeps = {name: 1 - alpha for name, (_, alpha, _) in averages.items()}
    ends = df.groupBy("symbol", "_part", "_sub").agg(*[F.max_by(c, "n").alias(c) for c in local], F.count(F.lit(1)).alias("_k"))
    ends = ends.withColumns({f"_d_{name}": F.pow(F.lit(keep), F.col("_k")) for name, keep in keeps.items()})
    blocks = Window.partitionBy("symbol").orderBy("_part", "_sub")
    # sums over twice as many blocks in each step, until what is left of the first can't be told
    reach = max(max(1, math.ceil(math.log(5e-324) / math.log(keep) / least)) if keep > 0 else 1 for keep in keeps.values())
    for step in range(math.ceil(math.log2(reach))):
        before = lambda c: F.coalesce(F.lag(c, 1 << step).over(blocks), F.lit(0.0))  # noqa: B023, E731
        ends = ends.withColumns({f"_l_{name}": F.col(f"_l_{name}") + before(f"_l_{name}") * F.col(f"_d_{name}") for name in keeps} | {f"_d_{name}": F.col(f"_d_{name}") * before(f"_d_{name}") for name in keeps})
    starts = ends.select("symbol", "_part", F.struct("_sub", *[F.coalesce(F.lag(f"_l_{name}", 1).over(blocks), F.lit(0.0)).alias(name) for name in keeps]).alias("_start"))
    found = df.join(starts.groupBy("symbol", "_part").agg(F.sort_array(F.collect_list("_start")).alias("_starts")), ["symbol", "_part"])
    start = F.get("_starts", F.col("_sub"))
    y = {name: F.when(F.col("n") >= first, F.col(f"_l_{name}") + F.pow(F.lit(1 - alpha), j + 1) * start[name]) for name, (_, alpha, first) in averages.items()}
    return found.withColumns(y).select(*rows.columns, *averages)


def averages_of_history(bars: DataFrame) -> DataFrame:
    """symbol, trade_date, n, ema12, ema26, macd, macd_hist, rsi14, atr14 of every bar of histories of any length, as ``with_indicators``
    defines them on a tail, but from each symbol's first bar on.

    Bars are shuffled once, by symbol and 1,024 days. What such a part needs of those before it, the number of bars and the last close,
    and the averages where its blocks start, come from tables of one row a part.
    """
    alpha, close = 1 / 14, F.col("close").cast("double")
    part = F.coalesce(F.floor(F.unix_date("trade_date") / BLOCK), F.lit(1 << 40)).alias("_part")  # bars without a day come last
    df = parted(bars.select("symbol", "trade_date", "high", "low", "close", part), ["symbol", "_part"])
    own = Window.partitionBy("symbol", "_part").orderBy("trade_date", *of_day(df.drop("_part")))
    df = df.withColumns({"_j": F.row_number().over(own) - 1, "_lag": F.lag("close").over(own)})
    parts = Window.partitionBy("symbol").orderBy("_part")
    # the number of bars by their last place, as a count would need none of the columns, and Spark would shuffle the bars once more without them
    known = df.groupBy("symbol", "_part").agg((F.max("_j") + 1).alias("_k"), F.max_by("close", "_j").alias("_last"))
    known = known.select("symbol", "_part", (F.sum("_k").over(parts.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_k")).alias("_before"), F.lag("_last").over(parts).alias("_edge"))
    df = df.join(known, ["symbol", "_part"]).withColumns({"n": F.col("_before") + F.col("_j"), "before": F.coalesce("_lag", "_edge")})
    change = F.col("close") - F.col("before")
    high, low, before = F.col("high").cast("double"), F.col("low").cast("double"), F.col("before").cast("double")
    df = df.select("symbol", "trade_date", "n", "_part", "_j", close.alias("_c"), F.greatest(change.cast("double"), F.lit(0.0)).alias("_gain"), F.greatest((-change).cast("double"), F.lit(0.0)).alias("_loss"), F.greatest(high - low, F.abs(high - before), F.abs(low - before)).alias("_range"))
    first = {"ema12": (F.col("_c"), 2 / 13, 0), "ema26": (F.col("_c"), 2 / 27, 0), "gain14": (F.col("_gain"), alpha, 1), "loss14": (F.col("_loss"), alpha, 1), "range14": (F.col("_range"), alpha, 0)}
    df = ewm_apart(df, first, F.col("_part"), F.col("_j")).withColumn("macd", F.col("ema12") - F.col("ema26"))
    df = ewm_apart(df, {"signal": (F.col("macd"), 0.2, 0)}, F.col("_part"), F.col("_j"))
    strength = F.try_divide("gain14", F.nullif("loss14", F.lit(0.0)))
    return df.select(
        "symbol", "trade_date", "n", "ema12", "ema26", "macd", (F.col("macd") - F.col("signal")).alias("macd_hist"),
        F.coalesce(F.when(F.col("n") >= 14, 100 - 100 / (1 + strength)), F.lit(100.0)).alias("rsi14"), F.when(F.col("n") >= 13, F.col("range14")).alias("atr14"),
    )
