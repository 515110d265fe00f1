"""Partitions: frustration, majority labels, average-linkage clusters of cohesion, all partitions of small graphs, agreement."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package


def frustration(edges: DataFrame, membership: DataFrame, normalized: bool = True) -> DataFrame:
    """graph_id, part_id, value: negative weight within groups plus positive weight between them, over all weight if normalised.

    membership: (graph_id, part_id, node, cluster); a node without a row is a group of its own with others like it.
    """
    m = membership.select("graph_id", "part_id", "node", "cluster")
    left = m.select("graph_id", "part_id", F.col("node").alias("src"), F.col("cluster").alias("c1"))
    right = m.select("graph_id", "part_id", F.col("node").alias("dst"), F.col("cluster").alias("c2"))
    met = edges.join(left, ["graph_id", "src"]).join(right, ["graph_id", "part_id", "dst"])
    w, same = F.col("weight"), F.col("c1").eqNullSafe(F.col("c2"))
    bad = F.when(same & (w < 0), -w).when(~same & (w > 0), w).otherwise(F.lit(0.0))
    value = F.sum(bad) / F.sum(F.abs(w)) if normalized else F.sum(bad)
    return met.groupBy("graph_id", "part_id").agg(value.alias("value"))


def label_clusters(membership: DataFrame, labels: DataFrame) -> DataFrame:
    """membership with label: the most frequent label of each cluster, the first in order of those that tie. labels: (graph_id, node, label)."""
    met = membership.join(labels.select("graph_id", "node", "label"), ["graph_id", "node"])
    counts = met.groupBy("graph_id", "part_id", "cluster", "label").count()
    best = counts.groupBy("graph_id", "part_id", "cluster").agg(F.min(F.struct(-F.col("count"), F.col("label"))).alias("b")).select("graph_id", "part_id", "cluster", "b.label")
    return membership.join(best, ["graph_id", "part_id", "cluster"])


def linkage(d: np.ndarray, kind: str = "average") -> list[tuple[int, int]]:
    """Merges of clusters, named by their smallest member, in order; of equal distances the first pair in order goes first."""
    d = d.astype(float).copy()
    n = len(d)
    size, alive, merges = np.ones(n), np.ones(n, dtype=bool), []
    d[np.diag_indices(n)] = np.inf
    for _ in range(n - 1):
        i, j = sorted(divmod(int(np.argmin(d)), n))
        merges.append((i, j))
        new = {"average": lambda: (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j]), "single": lambda: np.minimum(d[i], d[j]), "complete": lambda: np.maximum(d[i], d[j])}[kind]()
        new[[i, j]] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
    return merges


def cut(n: int, merges: list[tuple[int, int]], clusters: int) -> np.ndarray:
    """Labels by smallest member when `clusters` are left."""
    label = np.arange(n)
    for i, j in merges[: max(0, n - clusters)]:
        label[label == j] = i
    return label


def hierarchy(cohesion: DataFrame, min_clusters: int = 1, max_clusters: int = 10, kind: str = "average", fill: float | None = None) -> DataFrame:
    """membership (graph_id, mode, n, node, cluster) from cohesion (graph_id, mode, i, j, value).

    One dendrogram for each graph and mode serves all cuts. Distances are 1 - cohesion of i < j. A pair without walks has no
    cohesion: an error, unless `fill` gives a value.
    """
    ship_package(cohesion.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf[["i", "j"]].to_numpy())
        d = np.full((len(ids), len(ids)), np.nan)
        up = pdf[pdf["i"] < pdf["j"]]
        a, b = np.searchsorted(ids, up["i"]), np.searchsorted(ids, up["j"])
        d[a, b] = d[b, a] = 1 - up["value"].to_numpy(dtype=float)
        np.fill_diagonal(d, 0)
        if np.isnan(d).any():
            if fill is None:
                raise ValueError("some pairs of nodes have no walks between them; give `fill`")
            d = np.where(np.isnan(d), 1 - fill, d)
        merges = linkage(d, kind)
        out = [pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], "mode": pdf["mode"].iloc[0], "n": n, "node": ids, "cluster": ids[cut(len(ids), merges, n)]}) for n in range(min_clusters, min(max_clusters, len(ids)) + 1)]
        return pd.concat(out) if out else pd.DataFrame(columns=["graph_id", "mode", "n", "node", "cluster"])

    return cohesion.groupBy("graph_id", "mode").applyInPandas(run, "graph_id string, mode string, n int, node long, cluster long")


def find_clusters(graph, beta=None, full_results: bool = False, min_clusters: int = 1, max_clusters: int = 10, kind: str = "average", fill: float | None = None, **kw) -> DataFrame:
    """The partition with the least frustration over strong and weak cohesion and numbers of clusters; ties: strong first, then the fewest clusters.

    graph_id, mode, n, node, cluster, frustration; one row for each (mode, n) with labels as an array if full results are asked for. beta: one number for each graph.
    """
    modes = [graph.pairwise_cohesion(beta, weak, **kw).select("graph_id", F.lit(name).alias("mode"), "i", "j", "value") for name, weak in (("s", False), ("w", True))]
    member = hierarchy(modes[0].union(modes[1]), min_clusters, max_clusters, kind, fill).persist()
    scores = frustration(graph.S, member.withColumn("part_id", F.struct("mode", "n"))).select("graph_id", "part_id.*", F.col("value").alias("frustration"))
    if full_results:
        labels = member.groupBy("graph_id", "mode", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "cluster"))), lambda x: x["cluster"]).alias("labels"))
        return scores.join(labels, ["graph_id", "mode", "n"])
    order = Window.partitionBy("graph_id").orderBy(F.round("frustration", 12), "mode", "n")
    best = scores.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
    return member.join(best, ["graph_id", "mode", "n"])


def set_partitions(spark, n: int, most_blocks: int | None = None) -> DataFrame:
    """part_id string, node, cluster: every partition of nodes 0 to n - 1 into at most `most_blocks` blocks, as restricted-growth strings."""
    most = most_blocks or n
    rows = spark.createDataFrame([([0], 0)], "code array<int>, top int")
    for _ in range(n - 1):
        rows = rows.select("code", "top", F.explode(F.sequence(F.lit(0), F.least(F.col("top") + 1, F.lit(most - 1)))).alias("c"))
        rows = rows.select(F.array_append("code", F.col("c")).alias("code"), F.greatest("top", "c").alias("top"))
    return rows.select(F.array_join(F.col("code").cast("array<string>"), ",").alias("part_id"), F.posexplode("code").alias("node", "cluster")).select("part_id", F.col("node").cast("long").alias("node"), "cluster")


def best_partition(edges: DataFrame, partitions: DataFrame) -> DataFrame:
    """graph_id, part_id, value: the first of the partitions with the least frustration. partitions: (graph_id, part_id, node, cluster)."""
    scores = frustration(edges, partitions)
    return scores.groupBy("graph_id").agg(F.min(F.struct(F.round("value", 12).alias("value"), "part_id")).alias("b")).select("graph_id", "b.part_id", "b.value")


def expected_mi(a: np.ndarray, b: np.ndarray) -> float:
    """Expected mutual information of two partitions with these sizes, under random labelling."""
    n, out, lg = int(a.sum()), 0.0, math.lgamma
    for x in map(int, a):
        for y in map(int, b):
            for k in range(max(1, x + y - n), min(x, y) + 1):
                p = lg(x + 1) + lg(y + 1) + lg(n - x + 1) + lg(n - y + 1) - lg(n + 1) - lg(k + 1) - lg(x - k + 1) - lg(y - k + 1) - lg(n - x - y + k + 1)
                out += k / n * math.log(n * k / (x * y)) * math.exp(p)
    return out


def adjusted_mi(pairs: DataFrame) -> DataFrame:
    """graph_id, ami: adjusted mutual information (arithmetic mean) of labels a and b, from rows (graph_id, a, b); 1 if both are one group or both are the same."""
    table = pairs.groupBy("graph_id", "a", "b").count()
    ship_package(pairs.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf.pivot_table(index="a", columns="b", values="count", aggfunc="sum", fill_value=0).to_numpy(dtype=float)
        n, x, y = c.sum(), c.sum(axis=1), c.sum(axis=0)
        entropy = lambda v: -sum(p / n * math.log(p / n) for p in v if p)
        hx, hy = entropy(x), entropy(y)
        mi = sum(c[i, j] / n * math.log(n * c[i, j] / (x[i] * y[j])) for i, j in zip(*np.nonzero(c), strict=True))
        e = expected_mi(x, y)
        low = (hx + hy) / 2 - e
        value = 1.0 if len(x) == len(y) == 1 or abs(low) < 1e-15 else (mi - e) / low
        return pd.DataFrame({"graph_id": [pdf["graph_id"].iloc[0]], "ami": [value]})

    return table.groupBy("graph_id").applyInPandas(run, "graph_id string, ami double")
