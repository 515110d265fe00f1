"""Powers of signed matrices from grouped eigen-decompositions, and a distributed Lanczos for one large graph.

A graph's matrices are decomposed in one task (dense, some thousand nodes at most); any number of graphs are
handled side by side. Powers are scaled: a row's value is that of the matrix over r = exp(ln_r), the spectral
radius of the unsigned matrix, to the power k. So no power overflows, sums of scaled values are plain sums, and
the logarithm of a power is ln|value| + k * ln_r.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

KEYS = {"trace": [], "diag": ["node"], "pair": ["i", "j"]}
SCHEMA = {w: "graph_id string, " + "".join(f"{c} long, " for c in keys) + "k int, u double, s double, v double, ln_r double" for w, keys in KEYS.items()}


def eigenpairs(x: np.ndarray, m: int | None, symmetric: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, Q, W) by descending real part: all, or m from either end."""
    values, q = np.linalg.eigh(x) if symmetric else np.linalg.eig(x)
    order = np.argsort(-values.real, kind="stable")
    if m is not None and 2 * m < len(x) - 1:
        order = np.concatenate((order[:m], order[-m:]))
    values, q = values[order], q[:, order]
    return values, q, q.T if symmetric else np.linalg.pinv(q)


def scaled_powers(a: np.ndarray, lengths: list[int], what: str, m: int | None, semi: bool) -> tuple[float, dict[int, tuple]]:
    """ln_r and for each k the scaled (U, S, V) parts asked for; lengths 0 to 2 of U and S are exact and never semi-symmetrised."""
    half = (lambda x: (x + x.T) / 2) if semi else (lambda x: x)
    u, s, p, n = np.abs(a), a, np.maximum(a, 0), np.maximum(-a, 0)
    symmetric = semi or bool(np.array_equal(a, a.T))
    parts = {name: eigenpairs(half(x), m, symmetric) for name, x in (("u", u), ("s", s), ("p", p))}
    r = max((float(np.abs(e[0]).max()) for e in parts.values() if len(e[0])), default=0.0) or 1.0
    values, q, w = parts["p"]
    mid = w @ n @ q
    take = {"trace": np.trace, "diag": np.diag, "pair": lambda x: x}[what]

    def strong(x: np.ndarray, name: str, k: int) -> np.ndarray:
        if k == 0:
            return take(np.eye(len(x)))
        if k == 1:
            return take(x / r)
        if k == 2:
            return {"trace": lambda: (x * x.T).sum(), "diag": lambda: (x * x.T).sum(axis=1), "pair": lambda: x @ x}[what]() / r**2
        e, q_, w_ = parts[name]
        f = (e / r) ** k
        return {"trace": lambda: f.sum(), "diag": lambda: np.einsum("ij,j,ji->i", q_, f, w_), "pair": lambda: (q_ * f) @ w_}[what]().real

    def weak(k: int) -> np.ndarray:
        if k == 0:
            return take(np.zeros_like(a))
        e = values / r
        if what == "trace":
            return (k * (e ** (k - 1) * np.diag(mid)).sum() / r).real
        high = e[None, :] ** np.arange(k)[:, None]
        inner = (high.T @ high[::-1]) * mid / r
        return (np.einsum("ij,jk,ki->i", q, inner, w) if what == "diag" else q @ inner @ w).real

    return float(np.log(r)), {k: (strong(u, "u", k), strong(s, "s", k), weak(k)) for k in lengths}


def powers(graph, what: str, K: list[int] | None = None) -> DataFrame:
    """graph_id, (node | i, j), k, u, s, v, ln_r: scaled traces, diagonals or entries of U^k, S^k and of V_k.

    V_k holds the closed or open walks of length k with just one negative step; its positive steps are semi-symmetrised for k = 2 too.
    Nodes without edges have rows as others. One shuffle, by graph.
    """
    ship_package(graph.edges.sparkSession)
    m, semi = graph.m, graph.semi_mode

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf.loc[pdf["kind"] == 0, "src"].to_numpy())
        e = pdf[pdf["kind"] == 1]
        kmin, kmax = int(pdf["kmin"].iloc[0]), int(pdf["kmax"].iloc[0])
        a = np.zeros((len(ids), len(ids)))
        a[np.searchsorted(ids, e["src"]), np.searchsorted(ids, e["dst"])] = e["weight"]
        ln_r, found = scaled_powers(a, K if K is not None else list(range(kmin, kmax + 1)), what, m, semi)
        out = []
        for k, values in found.items():
            flat = [np.ravel(x) for x in values]
            keys = {"trace": {}, "diag": {"node": ids}, "pair": {"i": np.repeat(ids, len(ids)), "j": np.tile(ids, len(ids))}}[what]
            out.append(pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], **keys, "k": k, "u": flat[0], "s": flat[1], "v": flat[2], "ln_r": ln_r}, index=range(len(flat[0]))))
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in SCHEMA[what].split(", ")])

    rows = graph.nodes.select("graph_id", F.lit(0).alias("kind"), F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(0.0).alias("weight"))
    rows = rows.union(graph.edges.select("graph_id", F.lit(1), "src", "dst", "weight")).join(graph.graphs.select("graph_id", "kmin", "kmax"), "graph_id")
    return rows.groupBy("graph_id").applyInPandas(run, SCHEMA[what])


def eigen_table(graph, matrix: str = "U", m: int | None = None) -> DataFrame:
    """graph_id, idx, ev, q, w: eigenpairs of one semi-symmetrised matrix of each graph, by descending value; an exact zero becomes the machine epsilon."""
    ship_package(graph.edges.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf.loc[pdf["kind"] == 0, "src"].to_numpy())
        e = pdf[pdf["kind"] == 1]
        a = np.zeros((len(ids), len(ids)))
        a[np.searchsorted(ids, e["src"]), np.searchsorted(ids, e["dst"])] = e["weight"]
        ev, q, w = eigenpairs((a + a.T) / 2, m, True)
        ev = np.where(ev == 0, np.finfo(float).eps, ev)
        return pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], "idx": range(len(ev)), "ev": ev, "q": list(q.T), "w": list(w)})

    rows = graph.nodes.select("graph_id", F.lit(0).alias("kind"), F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(0.0).alias("weight"))
    rows = rows.union(getattr(graph, matrix).select("graph_id", F.lit(1), "src", "dst", "weight"))
    return rows.groupBy("graph_id").applyInPandas(run, "graph_id string, idx int, ev double, q array<double>, w array<double>")


def lanczos(edges: DataFrame, n: int, m: int = 5, tol: float = 1e-6, keep: int = 60, most: int = 400, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The m largest and m smallest eigenvalues (descending) of a symmetric matrix with nodes 0 to n - 1, and their residuals.

    For one graph that is too large for a task. Each step is one scan of the edges (src, dst, weight): tasks multiply
    their edges with the broadcast vector (8 n bytes, so n is bounded by the driver, some ten million) and send
    block sums, which Spark adds up. Thick restarts keep the Ritz vectors of both ends until all residuals are under
    `tol` times the largest value, or `most` products are used up.
    """
    spark = edges.sparkSession
    ship_package(spark)
    held = edges.select("src", "dst", "weight").persist()
    width = 4096

    def times(x: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(x)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n)
            for b in batches:
                total += np.bincount(b.column(0).to_numpy(), b.column(2).to_numpy() * sent.value[b.column(1).to_numpy()], n)
            for i in range(0, n, width):
                part = total[i : i + width]
                at = np.flatnonzero(part)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(at + i), pa.array(part[at])], ["i", "y"])

        out = held.mapInArrow(run, "i long, y double").groupBy("i").agg(F.sum("y").alias("y")).toArrow()
        sent.unpersist()
        y = np.zeros(n)
        y[out.column("i").to_numpy()] = out.column("y").to_numpy()
        return y

    try:
        rng = np.random.default_rng(seed)
        first = rng.normal(size=n)
        basis, images = [first / np.linalg.norm(first)], []
        for _ in range(most):
            images.append(times(basis[-1]))
            q, aq = np.stack(basis, axis=1), np.stack(images, axis=1)
            values, y = np.linalg.eigh((q.T @ aq + aq.T @ q) / 2)
            ends = np.arange(len(values)) if len(values) <= 2 * m else np.concatenate((np.arange(m), np.arange(len(values) - m, len(values))))
            vectors = q @ y[:, ends]
            off = aq @ y[:, ends] - vectors * values[ends]
            residual = np.linalg.norm(off, axis=0)
            if len(basis) >= n or len(values) > 2 * m and residual.max() <= tol * np.abs(values).max():
                break
            nxt = images[-1] - q @ (q.T @ images[-1])
            nxt -= q @ (q.T @ nxt)
            if np.linalg.norm(nxt) < 1e-12 * np.abs(values).max():
                nxt = rng.normal(size=n)
                nxt -= q @ (q.T @ nxt)
            if len(basis) >= keep:
                wide = np.argsort(-np.abs(values))[: keep // 2]
                wide = np.union1d(wide, np.concatenate((np.arange(2 * m), np.arange(len(values) - 2 * m, len(values)))))
                basis, images = list((q @ y[:, wide]).T), list((aq @ y[:, wide]).T)
                kept = np.stack(basis, axis=1)
                nxt -= kept @ (kept.T @ nxt)
            basis.append(nxt / np.linalg.norm(nxt))
        return values[ends][::-1], residual[::-1]
    finally:
        held.unpersist()
