"""Signed simple cycles: exact by path joins, or estimated from sampled connected subgraphs; pruning and components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from ..storage import drop, store


def clean(edges: DataFrame) -> DataFrame:
    """Stored edges between nodes that have both in- and out-edges, again and again until nothing changes: what can lie on a cycle."""
    now, count = store(edges), -1
    while (n := now.count()) != count:
        count, old = n, now
        ends = now.select("graph_id", F.col("src").alias("id")).intersect(now.select("graph_id", F.col("dst").alias("id")))
        left = now.join(ends.withColumnRenamed("id", "src"), ["graph_id", "src"], "left_semi").join(ends.withColumnRenamed("id", "dst"), ["graph_id", "dst"], "left_semi")
        now = store(left.select(*edges.columns))
        drop(old)
    return now


def is_symmetric(edges: DataFrame) -> DataFrame:
    """graph_id, symmetric."""
    back = edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("back"))
    met = edges.join(back, ["graph_id", "src", "dst"], "left")
    return met.groupBy("graph_id").agg(F.min(F.abs(F.col("weight") - F.coalesce("back", F.lit(0.0))) <= 1e-8 + 1e-5 * F.abs("weight")).alias("symmetric"))


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, id, component: the smallest node id reachable when directions are ignored.

    Labels spread to neighbours and then jump to the label of their label, so rounds are about the
    logarithm of the longest path.
    """
    both = store(edges.select("graph_id", F.col("src").alias("id"), F.col("dst").alias("to")).union(edges.select("graph_id", "dst", "src")).distinct())
    now, mark = store(nodes.select("graph_id", "id").distinct().withColumn("component", F.col("id"))), None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("graph_id", "id", "component").cast("decimal(20,0)"))).head()
        if tuple(seen) == mark:
            return now
        mark, old = tuple(seen), now
        near = both.join(now.withColumnRenamed("id", "to"), ["graph_id", "to"]).select("graph_id", "id", "component")
        low = store(near.union(now).groupBy("graph_id", "id").agg(F.min("component").alias("component")))
        jump = low.select("graph_id", F.col("id").alias("component"), F.col("component").alias("further"))
        now = store(low.join(jump, ["graph_id", "component"], "left").select("graph_id", "id", F.least("component", F.coalesce("further", "component")).alias("component")))
        drop(old), drop(low)


def count_cycles(edges: DataFrame, most: int) -> DataFrame:
    """graph_id, length, positive, negative: simple cycles of 1 < length <= most, each once; a symmetric pair of edges is a cycle of length 2.

    Paths grow from their smallest node, by one equi-join a step with the rest as a residual filter, and are
    counted where an edge leads back. Loops are left out. Paths are as many as there are: for sparse
    or small graphs.
    """
    e = store(edges.where("src != dst and weight != 0").select("graph_id", "src", "dst", (F.col("weight") < 0).cast("int").alias("neg")))
    step = e.select("graph_id", F.col("src").alias("end"), F.col("dst").alias("to"), F.col("neg").alias("more"))
    back = e.select("graph_id", F.col("src").alias("end"), F.col("dst").alias("start"), F.col("neg").alias("more"))
    paths = e.where("dst > src").select("graph_id", F.col("src").alias("start"), F.col("dst").alias("end"), F.array("src", "dst").alias("path"), F.col("neg"))
    found, old = [], None
    for length in range(2, most + 1):
        closed = paths.join(back, ["graph_id", "end", "start"])
        odd = (F.col("neg") + F.col("more")) % 2
        found.append(store(closed.groupBy("graph_id").agg(F.sum((odd == 0).cast("long")).alias("positive"), F.sum((odd == 1).cast("long")).alias("negative")).withColumn("length", F.lit(length))))
        if length < most:
            grown = paths.join(step, ["graph_id", "end"]).where((F.col("to") > F.col("start")) & ~F.array_contains("path", F.col("to")))
            paths = store(grown.select("graph_id", "start", F.col("to").alias("end"), F.array_append("path", F.col("to")).alias("path"), (F.col("neg") + F.col("more")).alias("neg")))
            drop(old)
            old = paths
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out.select("graph_id", "length", "positive", "negative")


def ratios(counts: DataFrame) -> DataFrame:
    """counts with unbalanced and balanced shares; a total of 0 counts as 1."""
    total = F.col("positive") + F.col("negative")
    return counts.withColumns({"unbalanced": F.col("negative") / F.when(total == 0, 1).otherwise(total), "balanced": 1 - F.col("negative") / F.when(total == 0, 1).otherwise(total)})


def local_cycles(a: np.ndarray, most: int) -> np.ndarray:
    """(positive, negative) for each length 0 to most of a small dense matrix."""
    n, out = len(a), np.zeros((most + 1, 2), dtype=np.int64)
    near = [np.flatnonzero((a[i] != 0) & (np.arange(n) != i)) for i in range(n)]

    def go(start: int, at: int, used: int, length: int, neg: int) -> None:
        for b in near[at]:
            odd = neg ^ int(a[at, b] < 0)
            if b == start and length > 1:
                out[length, odd] += 1
            elif b > start and not used >> b & 1 and length < most:
                go(start, b, used | 1 << int(b), length + 1, odd)

    for s in range(n):
        go(s, s, 1 << s, 1, 0)
    return out


def grow(near: list[np.ndarray], size: int, rng: np.random.Generator, exact: bool = True) -> list[int]:
    """Vertices of a connected subgraph by random expansion; starts anew when it can't grow and the exact size is asked for."""
    while True:
        got = [int(rng.integers(len(near)))]
        edge = set(map(int, near[got[0]])) - set(got)
        while len(got) < size and edge:
            v = sorted(edge)[int(rng.integers(len(edge)))]
            got.append(v)
            edge = (edge | set(map(int, near[v]))) - set(got)
        if len(got) == size or not exact:
            return got


def _connected(near: list[np.ndarray], members: list[int]) -> bool:
    inside, reach, todo = set(members), {members[0]}, [members[0]]
    while todo:
        for w in map(int, near[todo.pop()]):
            if w in inside and w not in reach:
                reach.add(w), todo.append(w)
    return len(reach) == len(inside)


def replace(near: list[np.ndarray], size: int, rng: np.random.Generator, exact: bool = True) -> list[int]:
    """Expansion, then one by one every vertex that can be reached takes the place of a member with a falling chance (size / i) where the subgraph stays connected.

    The vertices still to try are neighbours of those met so far, tried ones included, until none is left;
    this evens out what expansion favours.
    """
    got = grow(near, size, rng, exact)
    met, waiting, i = set(got), sorted({int(w) for u in got for w in near[u]} - set(got)), len(got)
    while waiting:
        i += 1
        at = int(rng.integers(len(waiting)))
        waiting[at], waiting[-1] = waiting[-1], waiting[at]
        v = waiting.pop()
        met.add(v)
        if rng.random() < size / i:
            new = got.copy()
            new[int(rng.integers(len(new)))] = v
            got = new if _connected(near, new) else got
        more = set(map(int, near[v])) - met - set(waiting)
        waiting += sorted(more)
    return got


def connected_sets(near: list[set[int]], root: int, most: int) -> Iterator[tuple[list[int], int]]:
    """Every connected set of up to `most` vertices whose least is `root`, once, with the number of its neighbours outside."""

    def go(members: list[int], open_: list[int], beside: set[int]) -> Iterator[tuple[list[int], int]]:
        yield members, len(beside.difference(members))
        if len(members) == most:
            return
        for i, v in enumerate(open_):
            fresh = [w for w in near[v] if w > root and w not in beside and w not in members]
            yield from go([*members, v], open_[i + 1 :] + fresh, beside | near[v])

    yield from go([root], sorted(w for w in near[root] if w > root), set(near[root]))


def sieve(a: np.ndarray, most: int, roots: range | list[int] | None = None) -> np.ndarray:
    """(unsigned, signed) sums over simple cycles of each length 0 to `most`, without listing cycles.

    Closed walks of length l within each connected induced set H of vertices are counted with the sign (-1)^(l - |H|)
    as often as H's neighbours can fill it up to l vertices; all but simple cycles cancel out. The cost is the number of
    connected sets of `most` vertices, whatever the number of cycles.
    """
    near = [set(np.flatnonzero((a[i] != 0) | (a[:, i] != 0)).tolist()) - {i} for i in range(len(a))]
    out = np.zeros((most + 1, 2))
    for root in range(len(a)) if roots is None else roots:
        for members, outside in connected_sets(near, root, most):
            s = a[np.ix_(members, members)].astype(np.float64)
            walk_u, walk_s, u = np.abs(s), s, np.abs(s)
            for length in range(1, most + 1):
                if length > 1:
                    walk_u, walk_s = walk_u @ u, walk_s @ s
                fill = length - len(members)
                if 0 <= fill <= outside:
                    out[length] += np.array([np.trace(walk_u), np.trace(walk_s)]) * ((-1) ** fill * math.comb(outside, fill) / length)
    return out


def _dense(edges: DataFrame, most_nodes: int = 5_000) -> np.ndarray:
    """The one graph in `edges` as a dense matrix of signs without loops, if it has few enough nodes."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    if (n := ids.count()) > most_nodes:
        raise ValueError(f"{n} nodes; at most {most_nodes} are held in a dense matrix")
    pdf = edges.select("src", "dst", "weight").toPandas()
    ids = np.unique(pdf[["src", "dst"]].to_numpy())
    a = np.zeros((n, n), dtype=np.int8)
    a[np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"])] = np.sign(pdf["weight"])
    np.fill_diagonal(a, 0)
    return a


def sieve_cycles(edges: DataFrame, most: int) -> DataFrame:
    """length, positive, negative: simple cycles of the one graph in `edges`, exact, by the sieve over connected vertex sets; each task takes some least vertices."""
    spark = edges.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(_dense(edges))  # 25 MB at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = sieve(sent.value, most, batch["id"].tolist())
            yield pd.DataFrame({"length": range(most + 1), "u": found[:, 0], "s": found[:, 1]})

    n = len(sent.value)
    sums = spark.range(0, n, 1, max(1, min(n, 4 * spark.sparkContext.defaultParallelism))).mapInPandas(run, "length int, u double, s double")
    sums = sums.where("length > 1").groupBy("length").agg(F.sum("u").alias("u"), F.sum("s").alias("s"))
    return sums.select("length", *[F.round((F.col("u") + sign * F.col("s")) / 2).cast("long").alias(c) for c, sign in (("positive", 1), ("negative", -1))])


def sampled_cycles(edges: DataFrame, length: int, n_samples: int = 100_000, seed: int = 1, sampler: Callable = replace, first: int = 0, exact: bool = True) -> DataFrame:
    """length, positive, negative: means over sampled connected subgraphs of `length` vertices of the one graph in `edges`.

    The graph is broadcast (its nodes are few enough for a dense matrix: 5,000 at most); samples are dealt over tasks, and each has its own
    seed from its number, so a lost task draws the same again.
    """
    spark = edges.sparkSession
    ship_package(spark)
    a = _dense(edges)
    sent = spark.sparkContext.broadcast(a)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = sent.value
        near = [np.flatnonzero((a[i] != 0) | (a[:, i] != 0)) for i in range(len(a))]
        for batch in batches:
            total = np.zeros((length + 1, 2), dtype=np.int64)
            for k in batch["id"]:
                got = sampler(near, min(length, len(a)), np.random.default_rng([seed, int(k)]), exact)
                found = local_cycles(a[np.ix_(got, got)], len(got))
                total[: len(found)] += found
            yield pd.DataFrame({"length": range(length + 1), "positive": total[:, 0], "negative": total[:, 1]})

    tasks = max(1, min(4 * spark.sparkContext.defaultParallelism, n_samples // 50))
    sums = spark.range(first, first + n_samples, 1, tasks).mapInPandas(run, "length int, positive long, negative long").where("length > 1")
    return sums.groupBy("length").agg(*[(F.sum(c) / n_samples).alias(c) for c in ("positive", "negative")])


def sampled_ratio(edges: DataFrame, length: int, accuracy: float | None = None, n_samples: int = 100_000, batch: int = 1_000, most_batches: int = 1_000, seed: int = 1, sampler: Callable = replace) -> DataFrame:
    """length, positive, negative, unbalanced, balanced from sampled subgraphs.

    With `accuracy`, batches are drawn until the standard deviation of the running ratios of every length
    is below it (and more than five batches are in).
    """
    if accuracy is None:
        return ratios(sampled_cycles(edges, length, n_samples, seed, sampler))
    spark, total, history = edges.sparkSession, np.zeros((length + 1, 2)), []
    for i in range(most_batches):
        for r in sampled_cycles(edges, length, batch, seed, sampler, i * batch).collect():  # `length` rows
            total[r["length"]] += (r["positive"], r["negative"])
        all_ = total.sum(axis=1)
        history.append(total[:, 1] / np.where(all_ == 0, 1, all_))
        if len(history) > 5 and np.std(history, axis=0).max() < accuracy:
            break
    rows = [(k, float(total[k, 0]) / len(history), float(total[k, 1]) / len(history)) for k in range(2, length + 1)]
    return ratios(spark.createDataFrame(rows, "length int, positive double, negative double"))
