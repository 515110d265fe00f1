"""GraphML (plain or gzipped), any number of files at once, read by Spark's XML source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import mirrored

_DATA = T.ArrayType(T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_key", T.StringType())]))


def _rows(spark: SparkSession, path: str, tag: str, names: list[str], data: bool = True) -> DataFrame:
    kind = T.StructType([T.StructField(f"_{n}", T.StringType()) for n in names] + [T.StructField("data", _DATA)] * data)
    df = spark.read.format("xml").option("rowTag", tag).schema(kind).load(path)
    return df.withColumn("graph_id", F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.graphml(\.gz)?$", ""))


def read(spark: SparkSession, path: str, weight: str = "weight") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, nodes, graphs) of all files under `path` (a glob may be given); graph_id is the file's name.

    Node ids are numbers by order of their names within a graph; nodes have `name_id` and attrs (a map).
    Undirected graphs come mirrored. A file without the weight attribute has weights of 1.
    """
    keys = _rows(spark, path, "key", ["id", "for", "attr.name"], False).select("graph_id", F.col("_id").alias("key"), F.col("_for").alias("of"), F.col("`_attr.name`").alias("attr"))
    graphs = spark.read.format("xml").option("rowTag", "graph").schema("_edgedefault string").load(path)
    graphs = graphs.select(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.graphml(\.gz)?$", "").alias("graph_id"), (F.col("_edgedefault") == "directed").alias("directed"))

    def attrs(df: DataFrame, of: str, by: list[str]) -> DataFrame:
        flat = df.select(*by, F.explode("data").alias("d")).select(*by, F.col("d._key").alias("key"), F.col("d._VALUE").alias("value"))
        met = flat.join(keys.where(F.col("of").isin(of, "all")), ["graph_id", "key"])
        return met.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("attr", "value"))).alias("attrs"))

    raw = _rows(spark, path, "node", ["id"]).withColumnRenamed("_id", "name_id")
    own = attrs(raw, "node", ["graph_id", "name_id"])
    number = F.dense_rank().over(Window.partitionBy("graph_id").orderBy(F.length("name_id"), "name_id")) - 1
    nodes = raw.select("graph_id", "name_id").join(own, ["graph_id", "name_id"], "left").withColumn("id", number.cast("long"))
    lines = _rows(spark, path, "edge", ["source", "target"]).withColumn("edge", F.monotonically_increasing_id())
    weights = attrs(lines, "edge", ["graph_id", "edge"]).select("graph_id", "edge", F.col("attrs").getItem(weight).cast("double").alias("weight"))
    ends = lambda name: nodes.select("graph_id", F.col("name_id").alias(f"_{name}"), F.col("id").alias(name))
    flat = lines.join(weights, ["graph_id", "edge"], "left").join(ends("source"), ["graph_id", "_source"]).join(ends("target"), ["graph_id", "_target"])
    flat = flat.select("graph_id", F.col("source").alias("src"), F.col("target").alias("dst"), F.coalesce("weight", F.lit(1.0)).alias("weight")).join(graphs, "graph_id")
    edges = flat.where("directed").drop("directed").unionByName(mirrored(flat.where("not directed").drop("directed")))
    return edges, nodes, graphs


def write(edges: DataFrame, nodes: DataFrame, path: str, directed: bool = True) -> None:
    """One graph as a gzipped GraphML file in the folder `path`: nodes (id) and edges (src, dst, weight), the latter given once.

    A file is one task's work, as a graph that is kept in one file fits into one.
    """
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="w" for="edge" attr.name="weight" attr.type="double"/>', f'<graph id="G" edgedefault="{"directed" if directed else "undirected"}">']
    spark = edges.sparkSession
    line = lambda rows, place: spark.createDataFrame([(place, i, r) for i, r in enumerate(rows)], "part int, at long, value string")
    node = nodes.select(F.lit(1).alias("part"), F.col("id").alias("at"), F.format_string('<node id="%d"/>', F.col("id").cast("long")).alias("value"))
    edge = edges.select(F.lit(2).alias("part"), F.col("src").alias("at"), F.concat(F.lit('<edge source="'), "src", F.lit('" target="'), "dst", F.lit('"><data key="w">'), F.col("weight").cast("string"), F.lit("</data></edge>")).alias("value"))
    rows = line(head, 0).union(node).union(edge).union(line(["</graph>", "</graphml>"], 3))
    rows.coalesce(1).sortWithinPartitions("part", "at").select("value").write.mode("overwrite").option("compression", "gzip").text(path)
