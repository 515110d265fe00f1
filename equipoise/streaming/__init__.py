"""Graphs of time windows, kept up to date from a stream of edges.

The operators here need a window's whole graph, so a stream is handled by recomputation: each micro-batch adds
its signed edges to the stored ones, and the windows that it touches are measured anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import SignedGraph


def windowed(events: DataFrame, at: str, width: str) -> DataFrame:
    """events (src, dst, weight, a timestamp) as edges with the start of their window as graph_id."""
    return events.select(F.date_format(F.window(at, width)["start"], "yyyy-MM-dd'T'HH:mm:ss").alias("graph_id"), "src", "dst", "weight")


def measure_stream(events: DataFrame, at: str, width: str, edges_path: str, measure: Callable[[SignedGraph], DataFrame], sink: Callable[[DataFrame, int], None], **graph):
    """A query writer (call start on it): after each micro-batch, `sink` gets the measure of every window the batch touched.

    Edges are kept under `edges_path` by batch number, so a batch that is run again overwrites itself.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        windowed(batch, at, width).write.mode("overwrite").parquet(f"{edges_path}/batch={number}")
        kept = spark.read.parquet(edges_path)
        touched = kept.where(F.col("batch") == number).select("graph_id").distinct()
        sink(measure(SignedGraph(kept.join(touched, "graph_id", "left_semi").select("graph_id", "src", "dst", "weight"), **graph)), number)

    return events.writeStream.foreachBatch(each)
