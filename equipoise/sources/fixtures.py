"""Signed graphs from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import SignedGraph
from .generators import collapsed

#: The records of the metadata example, with their overlap.
PRESIDENTS = [
    ("Richard", "Nixon", "1969-01-02", "1974-08-09", "Republican"), ("Gerald", "Ford", "1974-08-04", "1977-01-20", "Republican"),
    ("Jimmy", "Carter", "1977-01-20", "1981-01-20", "Democratic"), ("Ronald", "Reagan", "1981-01-20", "1989-01-20", "Republican"),
    ("George", "Bush", "1989-01-20", "1993-01-20", "Republican"), ("Bill", "Clinton", "1993-01-20", "2001-01-20", "Democratic"),
    ("George", "Bush", "2001-01-20", "2009-01-20", "Republican"), ("Barack", "Obama", "2009-01-20", "2017-01-20", "Democratic"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_edges(spark: SparkSession, sf_dir: str, by_year: bool = False) -> DataFrame:
    """Nation to nation: items kept count 1, items returned -2; one graph, or one a year."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", -2.0).otherwise(1.0).alias("w"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    who = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src"))
    whom = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst"))
    graph = (F.col("year").cast("string") if by_year else F.lit("trade")).alias("graph_id")
    # items are shuffled once, to their orders' nations; what meets the suppliers is a sum for each nation and supplier
    owners = orders.join(who, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", graph, "src")
    sold = items.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("graph_id", "src", "l_suppkey").agg(F.sum("w").alias("w"))
    met = sold.join(whom, F.col("l_suppkey") == F.col("s_suppkey")).where("src != dst")
    return met.groupBy("graph_id", "src", "dst").agg(F.sum("w").alias("weight")).where("weight != 0")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("region"))


def trade(spark: SparkSession, sf_dir: str, weighted: bool = False, **kw) -> SignedGraph:
    """The trade graph at full spectrum; nations without trade are nodes too."""
    nodes = nations(spark, sf_dir).withColumn("graph_id", F.lit("trade"))
    return SignedGraph(trade_edges(spark, sf_dir), nodes, directed=True, weighted=weighted, **({"m": None} | kw))


def undirected_trade(spark: SparkSession, sf_dir: str, **kw) -> SignedGraph:
    """The trade graph with the mean of both directions on each edge."""
    nodes = nations(spark, sf_dir).withColumn("graph_id", F.lit("trade"))
    return SignedGraph(collapsed(trade_edges(spark, sf_dir)), nodes, directed=False, **({"m": None} | kw))


def region_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between regions: sums of the trade graph's weights."""
    region = nations(spark, sf_dir)
    a, b = region.select(F.col("id").alias("src"), F.col("region").alias("from")), region.select(F.col("id").alias("dst"), F.col("region").alias("to"))
    met = trade_edges(spark, sf_dir).join(a, "src").join(b, "dst").where("`from` != `to`")
    return met.groupBy("graph_id", F.col("from").alias("src"), F.col("to").alias("dst")).agg(F.sum("weight").alias("weight")).where("weight != 0")


def yearly_trade(spark: SparkSession, sf_dir: str, **kw) -> SignedGraph:
    edges = trade_edges(spark, sf_dir, True)
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("string").alias("graph_id")).distinct()
    ids = [r["id"] for r in nations(spark, sf_dir).select("id").collect()]  # 25 rows
    nodes = years.select("graph_id", F.explode(F.array(*[F.lit(i).cast("long") for i in ids])).alias("id"))
    return SignedGraph(edges, nodes, directed=True, weighted=False, **({"m": None} | kw))


def customer_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bipartite graph of customers (even ids) and suppliers (odd ids), given once."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", -2.0).otherwise(1.0).alias("w"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    met = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return met.groupBy(F.lit("market").alias("graph_id"), (2 * F.col("o_custkey").cast("long")).alias("src"), (2 * F.col("l_suppkey").cast("long") + 1).alias("dst")).agg(F.sum("w").alias("weight")).where("weight != 0")


def presidents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESIDENTS, "name string, surname string, start string, end string, affil string").withColumns({"start": F.to_date("start"), "end": F.to_date("end")})
