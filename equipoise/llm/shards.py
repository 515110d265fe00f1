"""Sharding by sampled splitters, under the law `bytes`: shards hold near equal numbers of bytes.

Keys are drawn with a chance in proportion to their row's size; their quantiles cut the key space into
several ranges a shard, as many at every size of the table. A range of many rows is cut by equal steps of the
key, what is still overfull is subdivided by row, and exact prefix sums over all of these tell where each
shard ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import numbers, store, unit

#: Bytes that a row counts besides its text.
OVERHEAD = 16


def range_of(key: Column, splitters: list[int]) -> Column:
    """How many splitters are <= key, by binary search."""
    steps, pad = 0, list(splitters)
    while 1 << steps < len(pad) + 1:
        steps += 1
    pad += [(1 << 63) - 1] * ((1 << steps) - len(pad))
    array = numbers(pad, "bigint")
    jumps = numbers([1 << i for i in reversed(range(steps))], "int")
    least = F.lit(len(splitters))
    found = F.aggregate(jumps, F.lit(0), lambda acc, j: F.when(F.element_at(array, acc + j) <= key, acc + j).otherwise(acc))
    return F.least(found, least)


def _cell(splitters: list[int], steps: list[int]) -> Column:
    """The number of a row's cell in the order of keys: its range (`found`) is cut into equal steps between its two splitters."""
    low = [-(1 << 63), *splitters]
    width = [float(b - a) for a, b in zip(low, [*splitters, 1 << 63], strict=True)]
    first = [sum(steps[:i]) for i in range(len(steps))]
    own = lambda values, kind: F.element_at(numbers(values, kind), F.col("found") + 1)
    share = (F.col("key").cast("double") - own([float(x) for x in low], "double")) / own(width, "double")
    step = F.floor(share * own(steps, "bigint"))
    return (own(first, "bigint") + F.least(F.greatest(step, F.lit(0)), own(steps, "bigint") - 1)).cast("long")


def shard(docs: DataFrame, shards: int = 40, seed: int = 29, ranges_per_shard: int = 16, sample_per_range: int = 16, range_rows: int = 200_000) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1) and slot (gapless from 0 in each shard) for all documents.

    Size: UTF-8 bytes of the text (null: none) plus 16. The key is the hash of the text, ties by doc_id, so
    equal texts are neighbours and only a group that meets the end of a shard, or is larger than one, lies
    in two. A shard ends within half a row of its share. The sample has some `sample_per_range` keys for
    each of `shards * ranges_per_shard` ranges, and the driver sees no more than these and one row for each range.
    A range is cut in steps of its keys, a step for each `range_rows` rows; one of more than twice its share
    of rows or bytes, such as one text that a third of all rows have, is subdivided by the hash of the
    row's id and place.
    The crc32 of a null text is that of an empty one. Null and repeated doc_ids are rows
    like others; an empty table gives no rows; other columns are not read.
    """
    text = F.col("text").cast("string")
    base = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = store(base)
    total = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).head()
    if not total["rows"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = shards * ranges_per_shard
    chance = F.col("size") * (ranges * sample_per_range / total["bytes"])
    drawn = sorted(r["key"] for r in rows.where(unit(F.lit(seed), "place") < chance).select("key").collect())  # about ranges * sample_per_range numbers
    splitters = sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if drawn else []
    found = range_of(F.col("key"), splitters)
    held = {r["range"]: r["rows"] for r in rows.groupBy(found.alias("range")).agg(F.count(F.lit(1)).alias("rows")).collect()}  # at most `ranges` numbers
    steps = [max(1, -(-held.get(i, 0) // range_rows)) for i in range(len(splitters) + 1)]
    cells = sum(steps)
    ranged = store(rows.withColumn("found", found).withColumn("range", _cell(splitters, steps)).drop("found"))
    held = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    parts = F.ceil(F.greatest(F.col("bytes") / (total["bytes"] / cells), F.col("rows") / (total["rows"] / cells))).cast("int")
    parts = store(held.select("range", F.when(parts > 2, parts).otherwise(1).alias("parts")))  # stored, so the planner sees how few rows these are
    sub = F.floor(unit(F.lit(seed + 1), "doc_id", "place") * F.col("parts")).cast("int")
    dealt = store(ranged.join(parts, "range").select("doc_id", "size", "text_crc32", "key", "place", "range", sub.alias("sub")))
    # where each range starts: a row for each range and part of one, in the order of the shards
    each = dealt.groupBy("range", "sub").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    block = F.floor(F.col("range") / 256)
    within = Window.partitionBy("block").orderBy("range", "sub").rowsBetween(Window.unboundedPreceding, -1)
    blocks = each.groupBy(block.alias("block")).agg(F.sum("b").alias("bb"), F.sum("n").alias("bn"))
    below = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocks = blocks.select("block", zero(F.sum("bb").over(below)).alias("bb"), zero(F.sum("bn").over(below)).alias("bn"))
    starts = each.withColumn("block", block).join(blocks, "block")
    starts = starts.select("range", "sub", (zero(F.sum("b").over(within)) + F.col("bb")).alias("b0"), (zero(F.sum("n").over(within)) + F.col("bn")).alias("n0"))
    inside = Window.partitionBy("range", "sub").orderBy("key", "doc_id", "place")
    ordered = dealt.select("*", zero(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1))).alias("b"), (F.row_number().over(inside) - 1).cast("long").alias("n"))
    spot = ordered.join(starts, ["range", "sub"]).select("doc_id", "size", "text_crc32", (F.col("b") + F.col("b0") + F.col("size") / 2).alias("middle"), (F.col("n") + F.col("n0")).alias("rank"))
    which = F.least(F.floor(F.col("middle") * shards / total["bytes"]), F.lit(shards - 1)).cast("int")
    put = store(spot.select("doc_id", "size", "text_crc32", which.alias("shard"), "rank"))
    firsts = {r["shard"]: r["first"] for r in put.groupBy("shard").agg(F.min("rank").alias("first")).collect()}  # `shards` numbers
    first = F.element_at(numbers([firsts.get(i, 0) for i in range(shards)], "bigint"), F.col("shard") + 1)
    return put.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - first).cast("long").alias("slot"))
