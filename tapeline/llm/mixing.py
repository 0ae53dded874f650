"""Mixing sources to target weights, with DataFrame functions alone.

Words are packed into blocks of fixed length, source by source. The output is dealt to shards of slots; each shard
draws how many of its slots each source fills, from the multinomial distribution of the targets' shares. A source's slots are numbered through all shards, the numbers go through a pseudorandom
permutation of the source's blocks (again for each round, if the source is repeated), and slots and blocks are
joined by that index. A document gets the words of its blocks, as often as they are drawn.

How it scales. Texts are read once, for their sizes. A source's order is cut into buckets by a hash of the id, so that the
prefix sums of a source with a third of all rows run in many tasks; only bucket totals meet in one place. Slots are drawn
and counted by shard, numbered from the counts, and spread by source and shard before they are rows. Blocks and
slots are joined by source and index, which is even for any source. The table of sources is broadcast only up to a counted size. All randomness is a hash of the seed and of numbers that don't
depend on partitions, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pick, shuffle_partitions

WORDS = r"[^\x20\x09-\x0D]+"
CELLS = 4096


def _unit(*parts: Column) -> Column:
    """A pseudorandom number from 0 up to 1."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, source_size, target, weight for each source of (source, size) rows.

    Sources by code point, null last, get the weights in turn. They share all sizes by weight; a target stops at
    ``most`` times its source's size and the excess is shared again, until none is above.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # from here on one row a source
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    ranked = each.withColumn("sid", place.cast("int")).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("sid", F.lit(len(weights))) + 1).cast("int"))
    )
    cap = F.col("source_size") * F.lit(most)
    before = Window.orderBy((cap / F.col("weight")).asc(), "sid").rowsBetween(Window.unboundedPreceding, -1)
    rest = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # sources of small caps come first; from the first that isn't above its cap on, all get the same for each weight
    level = ranked.withColumn("cap", cap).withColumn("rest", rest).withColumn("above", F.col("rest") * F.col("weight") > F.col("cap"))
    share = F.max(F.when(~F.col("above"), F.struct((-F.col("cap") / F.col("weight")).alias("o"), (-F.col("sid")).alias("s"), F.col("rest")))).over(everything)
    return level.withColumn("share", share["rest"]).select(
        "source", "sid", "source_size", "weight", F.when(F.col("above"), F.col("cap")).otherwise(F.least("cap", F.col("share") * F.col("weight"))).alias("target")
    )


def _permuted(i: Column, n: Column, key: Column, turns: int = 8) -> Column:
    """Where a pseudorandom permutation of 0..n-1, for any n, sends i: in each turn, places are paired by a random
    reflection, and a hash of the pair says whether its two places change over. ``key`` is a number that tells permutations apart."""

    def turn(at: Column, k: Column) -> Column:
        other = F.pmod(F.shiftrightunsigned(F.xxhash64(key, k), 1) - at, n)
        swap = F.xxhash64(key, k, F.greatest(at, other)) > 0
        return F.when(swap, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(turns)), i, turn)


def starts(docs: DataFrame, bucket_rows: int = 1000) -> DataFrame:
    """Adds ``start``, the words of the source before the document: documents go by bucket, then by id."""
    buckets = max(1, -(-docs.count() // bucket_rows))
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "sid"), F.lit(buckets)))
    order = Window.partitionBy("sid", "bucket").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    inside = docs.withColumn("inside", F.coalesce(F.sum("size").over(order), F.lit(0)))
    totals = docs.groupBy("sid", "bucket").agg(F.sum("size").alias("total"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("sid", "bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    return inside.join(base, ["sid", "bucket"]).withColumn("start", F.col("inside") + F.col("base")).drop("bucket", "inside", "base")


def draws(sources: DataFrame, block: int, shard_slots: int, seed: int) -> tuple[DataFrame, int]:
    """sid, shard, n, blocks: how many slots of each output shard a source fills, and the number of its blocks; and how
    many slots there are in all.

    Each slot of a shard draws its source by the targets' shares, so a shard's counts are multinomial.
    """
    spark = sources.sparkSession
    everything = Window.partitionBy()
    running = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    shares = cut(
        sources.where("source_size > 0")
        .withColumn("blocks", F.ceil(F.col("source_size") / block))
        .withColumn("expected", F.col("target") * F.col("blocks") / F.col("source_size"))
        .withColumn("all", F.sum("expected").over(everything))
        .withColumn("to", F.when(F.lead("sid").over(Window.orderBy("sid")).isNull(), F.lit(1.0)).otherwise(F.sum("expected").over(running) / F.col("all")))
        .withColumn("from", F.coalesce(F.lag("to").over(Window.orderBy("sid")), F.lit(0.0)))
        .select("sid", "blocks", "from", "to", F.round("all").cast("long").alias("slots"))
    )
    slots = shares.agg(F.max("slots")).first()[0] or 0
    # a draw looks only at the sources of its 4096th part of the unit interval
    cells = shares.where(F.col("to") > F.col("from")).withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("from") * CELLS).cast("int"), F.least(F.floor(F.col("to") * CELLS), F.lit(CELLS - 1)).cast("int")))
    )
    drawn = (
        spark.range(slots, numPartitions=max(1, min(-(-slots // (1 << 18)), 1 << 16)))
        .select(F.expr(f"id div {shard_slots}").alias("shard"), _unit(F.lit(seed), F.col("id")).alias("u"))
        .withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
        .join(small(cells.select("cell", "sid", "from", "to", "blocks")), "cell")
        .where((F.col("u") >= F.col("from")) & (F.col("u") < F.col("to")))
    )
    return drawn.groupBy("sid", "shard", "blocks").agg(F.count(F.lit(1)).alias("n")), slots


def small(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """A table to be broadcast if it has few rows, by count; else joined like any other."""
    return F.broadcast(rows) if rows.count() <= most else rows


def numbered(drawn: DataFrame, group: int = 1024) -> DataFrame:
    """Adds ``first``, the source's slots in all shards before: inside groups of shards, then over the groups."""
    drawn = drawn.withColumn("group", F.expr(f"shard div {group}"))
    inside = Window.partitionBy("sid", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = drawn.groupBy("sid", "group").agg(F.sum("n").alias("total"))
    earlier = Window.partitionBy("sid").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("sid", "group", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    first = F.coalesce(F.sum("n").over(inside), F.lit(0))
    return drawn.withColumn("inside", first).join(base, ["sid", "group"]).withColumn("first", F.col("inside") + F.col("base")).drop("inside", "base", "group")


def blocks_taken(docs: DataFrame, weights: tuple[int, ...], most: int, block: int, shard_slots: int, seed: int, more: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Documents with row (a number), size, source_size and target; and, for the pieces that blocks hold of them, row,
    offset, words, and times, how often the block is drawn."""
    docs = pick(docs, doc_id="doc_id", text="text", source="source", **more)
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), F.xxhash64("text").alias("tie"), *more)
    docs = cut(docs.withColumn("row", F.monotonically_increasing_id()))
    sources = cut(targets(docs, weights, float(most)))
    named = small(sources.withColumnRenamed("source", "named"))
    placed = cut(starts(docs.join(named, docs["source"].eqNullSafe(named["named"])).drop("named", "weight")))
    drawn, n = draws(sources, block, shard_slots, seed)
    rounds = (
        numbered(cut(drawn))
        .withColumn("end", F.least(F.col("first") + F.col("n"), F.col("blocks") * most))
        .where("first < end")
        # a number of its own, as few rows become many
        .repartition(max(shuffle_partitions(docs.sparkSession), -(-n // (1 << 18))), "sid", "shard")
        .select("sid", "blocks", F.explode(F.sequence(F.col("first"), F.col("end") - 1)).alias("slot"))
        .withColumn("turn", F.xxhash64(F.lit(seed), "sid", F.expr("slot div blocks")))
        .withColumn("block", _permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.col("turn")))
    )
    slots = rounds.groupBy("sid", "block").agg(F.count(F.lit(1)).cast("int").alias("times"))
    begin, end = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    pieces = (
        placed.where("size > 0")
        .select("row", "sid", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
        .select("row", "sid", "block", (begin - F.col("start")).cast("int").alias("offset"), (end - begin).cast("int").alias("words"))
    )
    found = pieces.join(slots, ["sid", "block"], "left").select("row", "offset", "words", F.coalesce("times", F.lit(0)).alias("times"))
    return placed, found


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = 8, shard_slots: int = 4096, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words of each document the mix takes, repeats counted.

    Size: words of the whole text, 0 if null. Null is a source of its own, the last. A source without words has
    target 0. Blocks are taken in at most ``most`` rounds, so no document exceeds that many times its size. A source's
    slots are a sum of multinomial counts, so its words stray from the target by about the root of block x target. Rows of
    equal doc_id are documents of their own. Empty table: no rows. Other columns are ignored.
    """
    placed, pieces = blocks_taken(docs, weights, most, block, shard_slots, seed, {})
    taken = pieces.where("times > 0").groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return placed.join(taken, "row", "left").select(
        "doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), F.coalesce("taken", F.lit(0).cast("long")).alias("taken")
    )


def mixed_texts(docs: DataFrame, key: str, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = 8, shard_slots: int = 4096, seed: int = 7) -> DataFrame:
    """key, whole, pieces: for each row of docs with drawn blocks, how often all of its text is taken, and the stretches
    (offset and words, in order) that are taken once more; ``key`` names a long column that tells rows of different content apart."""
    placed, pieces = blocks_taken(docs, weights, most, block, shard_slots, seed, {"key": key})
    every = pieces.groupBy("row").agg(F.min("times").alias("whole"), F.sort_array(F.collect_list(F.struct("offset", "words", "times"))).alias("all"))
    # blocks are drawn in all rounds, or in all but the last: what is more than the whole text is taken once more
    extra = F.filter("all", lambda p: p["times"] > F.col("whole"))
    return placed.select("row", "key").join(every, "row").select("key", "whole", extra.alias("pieces")).where((F.col("whole") > 0) | (F.size("pieces") > 0))
