"""Mixing sources to target weights: hash-random keys, prefix sums of sizes within each source, a cut at each source's budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import buckets, running, store, unit, word_count


def targets(sizes: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 2.0) -> DataFrame:
    """sizes: (source, source_size). Adds target double.

    Sources by code point, null last, weigh `weights` in turn and share `share` times all sizes. No target
    is above `most` times its source's size; what is over goes to the others by weight until none is
    above. That is the level at which sum(min(level * weight, most * size)) meets the budget: sources
    are taken by the level at which they fill up, and the first stretch that holds the budget gives it.
    If all are full, each gets `most` times its size. One small row for each source is handled.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.lit([float(x) for x in weights]), (place + 1).cast("int"))
    rows = sizes.select("source", "source_size", w.alias("w"), (F.col("source_size") * most).alias("cap")).withColumn("fill", F.col("cap") / F.col("w"))
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = rows.select(
        "*",
        F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("full"),
        F.sum("w").over(by_fill.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
        (F.sum("source_size").over(every) * share).alias("budget"),
    )
    # were all before it full, it and all after it open, the level would be this; the true level is the largest that reaches no cap of theirs
    level = (F.col("budget") - F.col("full")) / F.col("open")
    marked = sums.withColumn("level", F.when(level <= F.col("fill"), level))
    found = marked.withColumn("level", F.max("level").over(every))
    return found.select("source", "source_size", F.coalesce(F.least(F.col("level") * F.col("w"), F.col("cap")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 2.0, seed: int = 17, size: Column | None = None, keep: list[Column] | None = None, least_buckets: int = 256, bucket_rows: int = 100_000) -> DataFrame:
    """doc_id, size, source_size, target, taken and epochs (times that the mix takes the document) for all documents.

    Size: words of the text unless given (null: 0). A document goes whole: each source's documents are
    taken in full epochs and then in hash order up to the last whose middle lies within the budget, so the
    words taken are half a document from the target at most. The hash is of seed, doc_id and text, so
    reruns agree, and rows that repeat both are neighbours. A source is spread over hash ranges, however
    large it is. Null sources are one source, a null doc_id is an id like others, an empty table gives
    no rows; other columns are not read but those that `keep` asks for.
    """
    size = word_count(F.col("text").cast("string")) if size is None else size
    key = unit(F.lit(seed), "doc_id", "text")
    source = F.col("source").cast("string")
    rows = store(docs.select(F.col("doc_id"), F.coalesce(source, F.lit("")).alias("name"), source.isNull().alias("none"), size.alias("size"), key.alias("key"), *[F.struct(*(keep or [F.lit(0).alias("none")])).alias("kept")]))
    n = buckets(rows.count(), least_buckets, bucket_rows)
    named = F.when(~F.col("none"), F.col("name")).alias("source")
    goals = targets(rows.groupBy("none", "name").agg(F.sum("size").alias("source_size")).select(named, "source_size"), share, weights, most)
    keyed = rows.withColumn("bucket", F.floor(F.col("key") * n).cast("int"))
    cum = running(keyed, ["none", "name"], "bucket", [F.col("key"), F.col("doc_id")], {"before": "size"})
    # a goal for each source and hash range, so that rows stay where they are dealt and no task gets a whole source
    spread = goals.select(F.coalesce("source", F.lit("")).alias("name"), F.isnull("source").alias("none"), "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bucket"))
    met = cum.join(spread, ["none", "name", "bucket"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - whole * F.col("source_size")
    epochs = whole + F.when(F.col("size") == 0, 0).when(F.col("before") + F.col("size") / 2 <= rest, 1).otherwise(0)
    return met.select("doc_id", named, "size", "source_size", "target", "key", epochs.cast("long").alias("epochs"), *(["kept.*"] if keep else [])).withColumn("taken", F.col("epochs") * F.col("size"))
