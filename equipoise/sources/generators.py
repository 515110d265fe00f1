"""Random signed graphs, collapsed graphs and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def random_graph(spark: SparkSession, n: int, m: int, seed: int = 1, graph_id: str = "er") -> DataFrame:
    """m distinct undirected edges among n nodes with random signs, given once (src < dst). Pairs are drawn with a reserve and the first m by hash stay."""
    if m > n * (n - 1) // 2:
        raise ValueError(f"{n} nodes have {n * (n - 1) // 2} pairs at most")
    if m * 3 > n * (n - 1) // 2:  # dense: number all pairs and take m by hash
        pairs = spark.range(n).select(F.col("id").alias("src")).select("src", F.explode(F.sequence(F.col("src") + 1, F.lit(n - 1).cast("long"))).alias("dst")).where(f"src < dst and dst < {n}")
    else:
        draw = lambda k: F.floor(F.rand(seed + k) * n).cast("long")
        pairs = spark.range(2 * m + 100).select(draw(0).alias("a"), draw(1).alias("b")).where("a != b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    some = pairs.orderBy(F.xxhash64("src", "dst", F.lit(seed)), "src", "dst").limit(m)
    return some.select(F.lit(graph_id).alias("graph_id"), "src", "dst", _sign(seed))


def _sign(seed: int):
    return (2 * F.pmod(F.xxhash64("src", "dst", F.lit(seed + 7)), F.lit(2)) - 1).cast("double").alias("weight")


def configuration_graph(degrees: DataFrame, seed: int = 1, graph_id: str = "cm") -> DataFrame:
    """Undirected edges with about the given degrees (id, degree) and random signs: stubs are paired in hash order, loops and repeats dropped."""
    stubs = degrees.where("degree > 0").select("id", F.explode(F.sequence(F.lit(1), F.col("degree").cast("int"))).alias("k"))
    # neighbours in hash order within a bucket make a pair; buckets are many, so none is large
    keyed = stubs.withColumn("h", F.xxhash64("id", "k", F.lit(seed))).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(64)))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("h", "id", "k")) - 1
    pairs = keyed.withColumn("at", place).groupBy("bucket", F.floor(F.col("at") / 2).alias("pair")).agg(F.min("id").alias("src"), F.max("id").alias("dst"), F.count(F.lit(1)).alias("n"))
    return pairs.where("n = 2 and src != dst").select("src", "dst").distinct().select(F.lit(graph_id).alias("graph_id"), "src", "dst", _sign(seed))


def collapsed(edges: DataFrame) -> DataFrame:
    """Directed edges as undirected ones with the mean of parallel weights, given once (src <= dst)."""
    pair = edges.select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    return pair.groupBy("graph_id", "src", "dst").agg(F.avg("weight").alias("weight"))


def read_records(spark: SparkSession, path: str, dates: tuple[str, ...] = ("start", "end")) -> DataFrame:
    """A JSON array of records, with date columns."""
    df = spark.read.option("multiLine", True).json(path)
    for c in dates:
        if c in df.columns:
            df = df.withColumn(c, F.to_date(c))
    return df
