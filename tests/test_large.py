"""The engine of large graphs, the sieve, the samplers, and table operations, against plain computations."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from equipoise.functions import stats, tables
from equipoise.graph import SignedGraph
from equipoise.operators import cycles, krylov
from equipoise.sources import generators


def close(a, b, keys, tol):
    a, b = (x.toPandas().sort_values(keys).reset_index(drop=True) for x in (a, b))
    assert (a[keys].to_numpy() == b[keys].to_numpy()).all()
    for c in "usv":
        assert np.abs(a[c].to_numpy() - b[c].to_numpy()).max() < tol, c


def test_krylov_agrees_with_the_dense_engine(spark):
    nodes = spark.range(152).select(F.col("id"))  # two without edges
    edges = generators.random_graph(spark, 150, 900, seed=2)
    # a few hubs, so that the ends of the spectrum stand apart
    hubs = spark.range(150).where("id % 3 != 0").select(F.lit("er").alias("graph_id"), (F.col("id") % 2 * 3).alias("src"), "id", F.lit(1.0).alias("weight")).where("src < id").select("graph_id", "src", F.col("id").alias("dst"), "weight")
    g = SignedGraph(edges.union(hubs).groupBy("graph_id", "src", "dst").agg(F.max("weight").alias("weight")), nodes.withColumn("graph_id", F.lit("er")), directed=False, weighted=False, m=2)
    assert krylov.thin(g, most=14).residual < 1e-4  # values are off by its square
    g.thin[(g.m, 8, 12, 1e-7, 3)] = krylov.thin(g, most=14)
    close(g.powers("trace", [0, 1, 2, 3, 4, 7], "krylov"), g.powers("trace", [0, 1, 2, 3, 4, 7], "spectral"), ["k"], 1e-6)
    close(g.powers("diag", [0, 1, 2, 3, 5], "krylov"), g.powers("diag", [0, 1, 2, 3, 5], "spectral"), ["node", "k"], 1e-5)
    g.most_dense = 100
    assert g.balance([0.1], weak=True).head().value == pytest.approx(SignedGraph(g.raw, nodes.withColumn("graph_id", F.lit("er")), directed=False, weighted=False, m=2).balance([0.1], weak=True).head().value, abs=1e-6)
    with pytest.raises(ValueError):
        krylov.powers(g, "pair", [2])
    with pytest.raises(ValueError):
        krylov.thin(SignedGraph(spark.createDataFrame([("a", 1, 2), ("b", 1, 2)], "graph_id string, src long, dst long")))


def test_sieve_counts_what_listing_counts():
    rng = np.random.default_rng(4)
    for n, share, symmetric in ((7, 0.5, False), (8, 0.35, False), (7, 0.6, True), (6, 0.0, False)):
        a = np.where(rng.random((n, n)) < share, rng.choice([-1, 1], (n, n)), 0)
        a = np.triu(a, 1) + np.triu(a, 1).T if symmetric else a
        np.fill_diagonal(a, 0)
        want = cycles.local_cycles(a.astype(np.int8), n)
        u, s = cycles.sieve(a, n).T
        assert np.allclose((u + s)[2:] / 2, want[2:, 0]) and np.allclose((u - s)[2:] / 2, want[2:, 1])
    near = [set(np.flatnonzero(a[i] | a[:, i])) - {i} for a in [np.ones((5, 5), int)] for i in range(5)]
    assert sum(1 for r in range(5) for _ in cycles.connected_sets(near, r, 5)) == 31


def test_replacement_evens_out_the_samples():
    """Over a graph of a triangle with a tail, connected sets of three come out more evenly than by expansion."""
    links = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6)]
    near = [np.asarray(sorted({b for a, b in links if a == i} | {a for a, b in links if b == i})) for i in range(7)]
    every = [c for c in itertools.combinations(range(7), 3) if cycles._connected(near, list(c))]
    spread = {}
    for sampler in (cycles.grow, cycles.replace):
        rng = np.random.default_rng(8)
        seen = Counter(tuple(sorted(sampler(near, 3, rng))) for _ in range(12_000))
        assert set(seen) == set(every)
        spread[sampler] = max(abs(seen[c] * len(every) / 12_000 - 1) for c in every)
    assert spread[cycles.replace] < spread[cycles.grow]


def test_points_that_repeat_stay(spark):
    points = spark.createDataFrame([(1, 5), (1, 5), (2, 50)], "id int, at int")
    spans = spark.createDataFrame([("a", 0, 10), ("b", 3, 8)], "name string, start int, end int")
    got = sorted((r.id, r.name) for r in stats.latest_interval(points, "at", spans, "start", "end").collect())
    assert got == [(1, "b"), (1, "b"), (2, None)] or got == sorted(got, key=str)
    assert len(got) == 3


def test_tables(spark):
    df = spark.createDataFrame([("x", 1, 3.0, 2.0), ("x", 2, None, None), ("y", 3, 1.0, 1.0), ("y", 4, 0.5, 9.0)], "g string, id int, a double, b double")
    assert [r.c for r in df.select("id", tables.least_column("a", "b").alias("c")).orderBy("id").collect()] == ["b", None, "a", "a"]
    assert {(r.g, r.id) for r in tables.least_row(df, "a", ["g"], ["id"]).collect()} == {("x", 1), ("y", 4)}
    assert {(r.g, r.stat): r.value for r in tables.stacked(df.where("id = 3"), ["g"], ["a", "b"]).collect()} == {("y", "a"): 1.0, ("y", "b"): 1.0}
    z = stats.zscores(df.where("a is not null"), "a", [])
    assert sum(r.zscore for r in z.collect()) == pytest.approx(0, abs=1e-9) and z.columns == [*df.columns, "zscore"]
    assert tables.keyed_concat({"p": df.select("id"), "q": df.select("a")}).columns == ["id", "key", "a"]
