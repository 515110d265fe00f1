"""Powers, measures, partitions and cycles against plain matrix computations."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from equipoise.functions import logs, stats
from equipoise.graph import SignedGraph
from equipoise.operators import clusters, cycles, measures, spectral


def random_matrix(n, seed, directed=True, density=0.5):
    rng = np.random.default_rng(seed)
    a = np.sign(rng.normal(size=(n, n))) * (rng.random((n, n)) < density)
    if not directed:
        a = np.triu(a, 1) + np.triu(a, 1).T
    np.fill_diagonal(a, 0)
    return a


def frame(spark, matrices):
    rows = [(g, int(i), int(j), float(a[i, j])) for g, a in matrices.items() for i, j in zip(*np.nonzero(a), strict=True)]
    nodes = [(g, i) for g, a in matrices.items() for i in range(len(a))]
    return spark.createDataFrame(rows, "graph_id string, src long, dst long, weight double"), spark.createDataFrame(nodes, "graph_id string, id long")


def naive(a, k, semi=True):
    h = (lambda x: (x + x.T) / 2) if semi else (lambda x: x)
    out = []
    for x in (np.abs(a), a):
        out.append(np.eye(len(a)) if k == 0 else x if k == 1 else x @ x if k == 2 else np.linalg.matrix_power(h(x), k))
    p, n = h(np.maximum(a, 0)), np.maximum(-a, 0)
    out.append(sum((np.linalg.matrix_power(p, i) @ n @ np.linalg.matrix_power(p, k - 1 - i) for i in range(k)), np.zeros_like(a)))
    return out


@pytest.fixture(scope="module")
def graphs(spark):
    m = {"d": random_matrix(8, 1), "u": random_matrix(9, 2, False)}
    m["d"] = np.pad(m["d"], ((0, 1), (0, 1)))  # a node without edges
    return m, SignedGraph(*frame(spark, m), m=None)


@pytest.mark.parametrize("engine", ["spectral", "relational"])
@pytest.mark.parametrize("what", ["trace", "diag", "pair"])
def test_powers(graphs, what, engine):
    matrices, graph = graphs
    keys = {"trace": [], "diag": ["node"], "pair": ["i", "j"]}[what]
    got = {(r.graph_id, r.k, *[r[c] for c in keys]): np.array([r.u, r.s, r.v]) * math.exp(r.k * r.ln_r) for r in graph.powers(what, list(range(6)), engine).collect()}
    for g, a in matrices.items():
        for k in range(6):
            x = naive(a, k)
            cells = {"trace": {(): [np.trace(y) for y in x]}, "diag": {(i,): [y[i, i] for y in x] for i in range(len(a))}, "pair": {(i, j): [y[i, j] for y in x] for i in range(len(a)) for j in range(len(a))}}[what]
            if what == "pair" and k == 2:  # the weak part has semi-symmetrised positive steps at length 2 as well
                assert np.allclose(x[0], np.abs(a) @ np.abs(a))
            for key, want in cells.items():
                assert np.allclose(got.get((g, k, *key), np.zeros(3)), want, atol=1e-9), (g, k, key)


def test_inference(graphs, spark):
    _, graph = graphs
    rows = {r.graph_id: r for r in graph.graphs.collect()}
    assert rows["d"].directed and not rows["u"].directed and not rows["d"].weighted
    assert (rows["d"].kmin, rows["u"].kmin, rows["d"].kmax) == (2, 3, 9)
    e = spark.createDataFrame([("a", 0, 1, 2.0), ("a", 0, 1, 2.0), ("a", 1, 2, -1.0), ("a", None, 2, 1.0), ("a", 2, 0, 0.0), (None, 5, 5, -3.0)], "graph_id string, src long, dst long, weight double")
    g = SignedGraph(e, directed=False)
    assert {(r.graph_id, r.src, r.dst): r.weight for r in g.edges.collect()} == pytest.approx({("a", 0, 1): 1.6, ("a", 1, 0): 1.6, ("a", 1, 2): -0.4, ("a", 2, 1): -0.4, ("", 5, 5): -1.0})
    assert SignedGraph(e.limit(0)).balance([1.0]).count() == 0
    for bad, error in (((1.5, 3), TypeError), ((-1, 3), ValueError), ((4, 3), ValueError)):
        with pytest.raises(error):
            SignedGraph(e, kmin=bad[0], kmax=bad[1])
    with pytest.raises(AttributeError):
        SignedGraph(e, weight_col="none", weighted=True)


@pytest.mark.parametrize("signs,strong,weak", [((1, 1, 1), 1, 1), ((1, 1, -1), 0, 0), ((1, -1, -1), 1, 1), ((-1, -1, -1), 0, 1)])
def test_triangles(spark, signs, strong, weak):
    e = spark.createDataFrame([("t", 0, 1, float(signs[0])), ("t", 1, 2, float(signs[1])), ("t", 2, 0, float(signs[2]))], "graph_id string, src long, dst long, weight double")
    g = SignedGraph(e, directed=False, m=None, kmax=3)
    assert [g.k_balance(w).where("k = 3").head().value for w in (False, True)] == pytest.approx([strong, weak], abs=1e-9)


def test_measures(graphs):
    matrices, graph = graphs
    beta, fact = 0.4, math.factorial
    lengths = {"d": range(2, 10), "u": range(3, 10)}
    sums = {g: [sum(beta**k / fact(k) * naive(a, k)[i] for k in lengths[g]) for i in range(3)] for g, a in matrices.items()}
    for weak in (False, True):
        index = {g: (1 - 2 * np.trace(v) / np.trace(u)) if weak else np.trace(s) / np.trace(u) for g, (u, s, v) in sums.items()}
        assert {r.graph_id: r.value for r in graph.balance_index([beta], weak).collect()} == pytest.approx(index)
        for r in graph.node_balance([beta], weak).collect():
            u, s, v = (np.diag(x)[r.node] for x in sums[r.graph_id])
            assert r.value is None if u == 0 else r.value == pytest.approx(min(1, max(0, 1 - v / u if weak else (1 + s / u) / 2)))
    for r in graph.contrib([beta]).collect():
        assert r.value == pytest.approx(beta**r.k / fact(r.k) * np.trace(naive(matrices[r.graph_id], r.k)[0]) / np.trace(sums[r.graph_id][0]))
    shares = graph.node_contrib([beta]).groupBy("graph_id").agg(F.sum("value").alias("x")).collect()
    assert all(r.x == pytest.approx(1) for r in shares)
    t = {g: {k: np.trace(naive(a, k)[0]) for k in lengths[g]} for g, a in matrices.items()}
    want = {g: min((k + 1) * x[k] / x[k + 1] for k in x if k + 1 in x and x[k + 1]) for g, x in t.items()}
    assert {r.graph_id: r.beta for r in graph.beta_max().collect()} == pytest.approx(want)
    odd = graph.node_balance([beta], report_incorrect=True, nans_as_zeros=True)
    assert odd.where("value is null or incorrect < 0").count() == 0
    assert graph.pairwise_cohesion([beta]).where("value < -1e-9 or value > 1 + 1e-9").count() == 0
    logs_ = measures.log_powers(graph, "trace", [3]).where("graph_id = 'd'").head()
    assert math.exp(logs_.la_u) == pytest.approx(np.trace(naive(matrices["d"], 3)[0]))


def test_non_semi_and_truncated(spark):
    a = random_matrix(10, 4, density=0.7)
    g = SignedGraph(*frame(spark, {"d": a}), semi=False, m=None, kmax=6)
    for r in g.powers("trace").collect():
        assert np.allclose(np.array([r.u, r.s]) * math.exp(r.k * r.ln_r), [np.trace(x) for x in naive(a, r.k, False)[:2]])
    u = (np.abs(a) + np.abs(a).T) / 2
    few = SignedGraph(*frame(spark, {"d": a}), m=2, kmax=6).powers("trace", [5]).head()
    ev = np.linalg.eigvalsh(u)
    assert few.u * math.exp(5 * few.ln_r) == pytest.approx((ev[[0, 1, -1, -2]] ** 5).sum())
    table = spectral.eigen_table(SignedGraph(*frame(spark, {"d": a}), m=None)).collect()
    assert [r.ev for r in table] == pytest.approx(sorted(ev, reverse=True))


def test_lanczos(spark):
    a = random_matrix(120, 5, False, 0.2)
    e, _ = frame(spark, {"x": a})
    values, residual = spectral.lanczos(e, 120, m=3, tol=1e-8, keep=30)
    ev = np.linalg.eigvalsh(a)[::-1]
    assert np.allclose(values, np.concatenate((ev[:3], ev[-3:])), atol=1e-5) and residual.max() < 1e-4


def test_partitions(spark, graphs):
    matrices, graph = graphs
    a = matrices["u"]
    best = min((sum(abs(a[i, j]) for i in range(9) for j in range(9) if (c[i] == c[j]) != (a[i, j] > 0) and a[i, j]) / np.abs(a).sum()) for c in itertools.product(range(2), repeat=9))
    parts = clusters.set_partitions(spark, 9, 2).withColumn("graph_id", F.lit("u"))
    assert clusters.best_partition(graph.S.where("graph_id = 'u'"), parts).head().value == pytest.approx(best)
    assert clusters.set_partitions(spark, 4).select("part_id").distinct().count() == 15
    block = np.kron(np.array([[1, -1], [-1, 1]]), np.ones((4, 4))) - np.eye(8)
    g = SignedGraph(*frame(spark, {"b": block}), m=None)
    found = g.find_clusters([0.5]).collect()
    assert len({r.cluster for r in found if r.node < 4}) == 1 and {r.n for r in found} == {2} and found[0].frustration == 0
    assert g.find_clusters([0.5], full_results=True).count() == 16
    labels = spark.createDataFrame([("b", 0, i, i // 4) for i in range(8)], "graph_id string, part_id int, node long, cluster int")
    named = spark.createDataFrame([("b", i, "xy"[i // 4] if i else "z") for i in range(8)], "graph_id string, node long, label string")
    assert {r.node: r.label for r in clusters.label_clusters(labels, named).collect()} == {i: "xy"[i // 4] for i in range(8)}
    same = spark.createDataFrame([("g", i % 3, (i % 3) + 5) for i in range(12)] + [("h", i % 2, i // 6) for i in range(12)], "graph_id string, a int, b int")
    ami = {r.graph_id: r.ami for r in clusters.adjusted_mi(same).collect()}
    assert ami["g"] == pytest.approx(1) and abs(ami["h"]) < 0.2


def brute_cycles(a, most):
    out = {k: [0, 0] for k in range(2, most + 1)}
    for k in out:
        for c in itertools.permutations(range(len(a)), k):
            if c[0] == min(c):
                w = np.prod([a[c[i], c[(i + 1) % k]] for i in range(k)])
                out[k][0] += w > 0
                out[k][1] += w < 0
    return out


def test_cycles(spark):
    a = random_matrix(7, 6)
    e, nodes = frame(spark, {"c": a})
    want = brute_cycles(a, 5)
    assert {r.length: [r.positive, r.negative] for r in cycles.count_cycles(e, 5).collect()} == want
    assert {k: list(v) for k, v in enumerate(cycles.local_cycles(a, 5)) if k > 1} == want
    assert {r.length: [r.positive, r.negative] for r in cycles.sampled_cycles(e, 7, 20).where("length < 6").collect()} == want
    for sampler in (cycles.grow, cycles.replace):
        est = cycles.sampled_ratio(e, 3, accuracy=0.05, batch=200, sampler=sampler).where("length = 3").head()
        assert 0 <= est.unbalanced <= 1
    tail = spark.createDataFrame([("c", 6, 50, 1.0), ("c", 50, 51, 1.0)], e.schema)
    assert cycles.clean(e.union(tail)).where("dst >= 50").count() == 0
    far = spark.createDataFrame([("c", 90 + i, 91 + i, 1.0) for i in range(9)], e.schema)
    comp = {r.id: r.component for r in cycles.weak_components(nodes.union(spark.createDataFrame([("c", 90 + i) for i in range(10)] + [("c", 777)], nodes.schema)), e.union(far)).collect()}
    assert comp[99] == 90 and comp[777] == 777 and comp[3] == 0
    assert not cycles.is_symmetric(e).head().symmetric


def test_statistics(spark):
    rng = np.random.default_rng(0)
    x = np.round(np.abs(rng.normal(size=50)), 1)
    df = spark.createDataFrame([("a", float(v)) for v in x], "g string, x double")
    s = np.sort(x)
    want = 2 * (np.arange(1, 51) * s).sum() / (50 * s.sum()) - 51 / 50
    assert stats.gini(df, "x", ["g"]).head().gini == pytest.approx(want)
    assert [r.value for r in stats.quantiles(df, "x", ["g"], [0.1, 0.5]).orderBy("share").collect()] == pytest.approx(list(np.quantile(x, [0.1, 0.5])))
    row = spark.range(1).select(logs.log_sum_exp(F.array(F.lit(800.0), F.lit(799.0)), F.array(F.lit(1.0), F.lit(-1.0))).alias("z")).head().z
    assert row.la == pytest.approx(800 + math.log(1 - math.exp(-1))) and row.sg == 1
    codes = stats.first_codes(spark.createDataFrame([("g", "b", 0), ("g", "a", 1), ("g", "b", 2)], "g string, l string, at int"), "l", "at", ["g"])
    assert {r.l: r.code for r in codes.collect()} == {"b": 0, "a": 1}
