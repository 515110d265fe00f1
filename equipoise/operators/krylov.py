"""Leading eigenpairs of one large graph by block Lanczos on distributed vectors, and the powers that measures are made of.

The vectors are rows of a table, one for each node, with the components of three bases: of U, S and P, semi-symmetrised.
A step is one scan of the edges for all three, an aggregate, and two rounds of orthogonalisation against all that
went before; only small matrices (basis by block) come to the driver, whatever the number of nodes. Powers then
follow from the thin table: traces from the values alone, diagonals from a row's own components. Each step is written to
the shared folder, so the plan stays short and a lost executor costs one step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from ..storage import drop, store

FAMILIES = "usp"


@dataclass
class Thin:
    """values: eigenvalues of U, S and P by descending value; mid: Q' N Q for the vectors of P; rows: (node, u, s, p) with their components; low: (node, l_u, l_s, t_u, t_s), diagonals of the first and second power as given; residual: the largest, over the largest value."""

    graph_id: str
    n: int
    values: dict[str, np.ndarray]
    mid: np.ndarray
    rows: DataFrame
    low: DataFrame
    residual: float
    kmin: int
    kmax: int

    @property
    def radius(self) -> float:
        return max((float(np.abs(v).max()) for v in self.values.values() if len(v)), default=0.0) or 1.0


def _entries(edges: DataFrame) -> DataFrame:
    """(src, dst, u, s, p): half of each entry and half of its mirror image."""
    w = F.col("weight") / 2
    parts = [F.abs(w).alias("u"), w.alias("s"), F.greatest(w, F.lit(0.0)).alias("p")]
    both = edges.select("src", "dst", *parts).union(edges.select("dst", "src", *parts))
    return store(both.groupBy("src", "dst").agg(*[F.sum(c).alias(c) for c in FAMILIES]))


def _times(entries: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(node, w): each family's matrix times its `width` vectors, from rows (node, x) with 3 * width components."""
    met = entries.join(rows.select(F.col("node").alias("dst"), "x"), "dst")
    sums = [F.sum(F.col(f) * F.get("x", i * width + j)).alias(f"y{i * width + j}") for i, f in enumerate(FAMILIES) for j in range(width)]
    return met.groupBy("src").agg(*sums).select(F.col("src").alias("node"), F.array(*[f"y{i}" for i in range(3 * width)]).alias("w"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width)


def _sums(rows: DataFrame, columns: list[str], part: Callable[[list[np.ndarray]], np.ndarray], size: int) -> np.ndarray:
    """Sums of a small array that each task makes of its rows' arrays; `size` numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += part([_matrix(c, len(c.flatten()) // len(c)) for c in b.columns]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "y"])

    out = np.zeros(size)
    for r in rows.select(*columns).mapInArrow(run, "i long, y double").groupBy("i").agg(F.sum("y").alias("y")).collect():
        out[r["i"]] = r["y"]
    return out


def _mapped(rows: DataFrame, columns: list[str], made: dict[str, Callable[[list[np.ndarray]], np.ndarray]]) -> DataFrame:
    """(node, and an array for each name) from each row's arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [_matrix(c, len(c.flatten()) // max(1, len(c))) for c in b.columns[1:]]
            out = [f(held) for f in made.values()] if b.num_rows else [np.zeros((0, 1)) for _ in made]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(x), pa.list_(pa.float64())) for x in out]], ["node", *made])

    return rows.select("node", *columns).mapInArrow(run, "node long, " + ", ".join(f"{c} array<double>" for c in made))


def _split(x: np.ndarray, many: int = 3) -> list[np.ndarray]:
    return np.split(x, many, axis=1)


def _whiten(gram: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """C so that vectors with this Gram matrix times C are orthonormal, or zero where they depend on each other; and the square root that undoes it."""
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    fine = value > 1e-20 * max(scale, 1e-300) ** 2
    root = np.sqrt(np.where(fine, value, 1.0))
    return vector * np.where(fine, 1 / root, 0.0), (vector * np.where(fine, root, 0.0)).T


def _order(values: np.ndarray, m: int | None, n: int) -> np.ndarray:
    order = np.argsort(-values, kind="stable")
    return np.concatenate((order[:m], order[-m:])) if m is not None and 2 * m < n - 1 else order


def thin(graph, block: int = 8, most: int = 12, tol: float = 1e-7, seed: int = 3) -> Thin:
    """Eigenpairs of the one graph in `graph`: m from either end, or all where the bases span everything.

    Blocks of `block` vectors are added until the residuals of all pairs asked for are under `tol` times the largest value, or
    there are `most` blocks; Thin.residual says how far it came. Kept for the graph object, so every measure uses the same pairs.
    """
    key = (graph.m, block, most, tol, seed)
    if key in graph.thin:
        return graph.thin[key]
    about = graph.graphs.select("graph_id", "n_nodes", "directed", "kmin", "kmax").take(2)
    if len(about) != 1:
        raise ValueError("this engine takes one graph; many are handled side by side by the spectral engine")
    about = about[0]
    if about["directed"] and not graph.semi_mode:
        raise ValueError("this engine needs symmetric matrices: an undirected graph, or semi mode")
    n, edges = about["n_nodes"], graph.edges
    if graph.m is None and n > block * most:
        raise ValueError(f"{n} nodes: give the number of eigenpairs m")
    ship_package(edges.sparkSession)
    entries, nodes = _entries(edges), graph.nodes.select(F.col("id").alias("node")).distinct()
    spread = F.transform(F.sequence(F.lit(0), F.lit(3 * block - 1)), lambda i: F.xxhash64("node", i, F.lit(seed)) / F.lit(float(1 << 63)))
    rows = store(nodes.select("node", spread.alias("x")))
    gram = _sums(rows, ["x"], lambda a: np.stack([x.T @ x for x in _split(a[0])]), 3 * block * block).reshape(3, block, block)
    start = [_whiten(g, float(np.sqrt(np.trace(g))))[0] for g in gram]
    basis = store(_mapped(rows, ["x"], {"x": lambda a: np.concatenate([x @ c for x, c in zip(_split(a[0]), start, strict=True)], axis=1)}).withColumn("q", F.col("x")))
    drop(rows)
    projected = [np.zeros((0, 0))] * 3
    for many in range(1, most + 1):
        # q holds the blocks one after the other, each with its three families
        def family(q: np.ndarray, f: int, many: int = many) -> np.ndarray:
            return q.reshape(len(q), many, 3, block)[:, :, f].reshape(len(q), many * block)

        met = store(basis.join(_times(entries, basis, block), "node", "left").select("node", "q", F.coalesce("w", F.array_repeat(F.lit(0.0), 3 * block)).alias("w")))
        size = (many * block + block) * block

        def products(a: list[np.ndarray], family: Callable = family) -> np.ndarray:
            return np.concatenate([np.concatenate((family(a[0], f).T @ w, w.T @ w)).ravel() for f, w in enumerate(_split(a[1]))])

        found = _sums(met, ["q", "w"], products, 3 * size).reshape(3, many * block + block, block)
        next_, roots, done = [], [], []
        for f in range(3):
            cross, own = found[f][:-block], found[f][-block:]
            wide = np.zeros((many * block, many * block))
            wide[: len(projected[f]), : len(projected[f])] = projected[f]
            wide[:, -block:], wide[-block:, :] = cross, cross.T
            projected[f] = wide
            c, root = _whiten(own - cross.T @ cross, float(np.sqrt(np.trace(own))) + 1e-300)
            next_.append((cross, c)), roots.append(root)
            value, vector = np.linalg.eigh((wide + wide.T) / 2)
            chosen = _order(value, graph.m, n)
            off = np.linalg.norm(root @ vector[-block:, chosen], axis=0)
            done.append(float(off.max() / max(np.abs(value).max(), 1e-300)))
        if max(done) <= tol or many == most or n <= many * block:
            break

        def cleaned(a: list[np.ndarray], family: Callable = family, next_: list = next_) -> np.ndarray:
            return np.concatenate([(w - family(a[0], f) @ next_[f][0]) @ next_[f][1] for f, w in enumerate(_split(a[1]))], axis=1)

        once = store(_mapped(met, ["q", "w"], {"q": lambda a: a[0], "w": cleaned}))
        drop(met), drop(basis)
        found = _sums(once, ["q", "w"], products, 3 * size).reshape(3, many * block + block, block)
        again = []
        for f in range(3):
            cross, own = found[f][:-block], found[f][-block:]
            again.append((cross, _whiten(own - cross.T @ cross, 1e-3)[0]))

        def settled(a: list[np.ndarray], family: Callable = family, again: list = again) -> np.ndarray:
            return np.concatenate([(w - family(a[0], f) @ again[f][0]) @ again[f][1] for f, w in enumerate(_split(a[1]))], axis=1)

        basis = store(_mapped(once, ["q", "w"], {"x": settled, "q": lambda a, s=settled: np.concatenate((a[0], s(a)), axis=1)}))
        drop(once)
    values, turns = {}, []
    for f, name in enumerate(FAMILIES):
        wide = (projected[f] + projected[f].T) / 2
        live = np.abs(wide).max(axis=1) > 1e-13 * max(np.abs(wide).max(), 1e-300)  # a vector that became zero has no part in it
        value, vector = np.linalg.eigh(wide[np.ix_(live, live)])
        chosen = _order(value, graph.m, n)
        full = np.zeros((len(wide), len(chosen)))
        full[live] = vector[:, chosen]
        turns.append(full if len(chosen) else np.zeros((len(wide), 1)))
        values[name] = value[chosen] if len(chosen) else np.zeros(1)
    thin_rows = store(_mapped(basis, ["q"], {name: (lambda a, f=f, family=family: family(a[0], f) @ turns[f]) for f, name in enumerate(FAMILIES)}))
    drop(met), drop(basis), drop(entries)
    wide = len(values["p"])
    step = edges.where("weight < 0").join(thin_rows.select(F.col("node").alias("dst"), "p"), "dst")
    image = step.groupBy("src").agg(*[F.sum(-F.col("weight") * F.get("p", i)).alias(f"y{i}") for i in range(wide)]).select(F.col("src").alias("node"), F.array(*[f"y{i}" for i in range(wide)]).alias("w"))
    mid = _sums(thin_rows.join(image, "node"), ["p", "w"], lambda a: a[0].T @ a[1], wide * wide).reshape(wide, wide)
    back = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("weight").alias("back"))
    first = edges.where("src = dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.abs("weight")).alias("l_u"), F.sum("weight").alias("l_s"))
    second = edges.join(back, ["src", "dst"]).groupBy(F.col("src").alias("node")).agg(F.sum(F.abs(F.col("weight") * F.col("back"))).alias("t_u"), F.sum(F.col("weight") * F.col("back")).alias("t_s"))
    low = store(nodes.join(first, "node", "left").join(second, "node", "left").na.fill(0.0))
    graph.thin[key] = Thin(about["graph_id"], n, values, mid, thin_rows, low, max(done), about["kmin"], about["kmax"])
    return graph.thin[key]


def powers(graph, what: str, K: list[int] | None = None) -> DataFrame:
    """As operators.spectral.powers, for traces and diagonals of one large graph."""
    if what == "pair":
        raise ValueError("entries of powers of a large graph are too many; ask for traces or diagonals")
    t = thin(graph)
    lengths, r, spark = list(K) if K is not None else list(range(t.kmin, t.kmax + 1)), t.radius, graph.edges.sparkSession
    ln_r, e = float(np.log(r)), {f: v / r for f, v in t.values.items()}

    def inner(k: int) -> np.ndarray:
        high = e["p"][None, :] ** np.arange(k)[:, None]
        return (high.T @ high[::-1]) * t.mid / r

    if what == "trace":
        low = t.low.agg(*[F.sum(c).alias(c) for c in ("l_u", "l_s", "t_u", "t_s")]).head()
        rows = []
        for k in lengths:
            strong = [float((e[f] ** k).sum()) for f in "us"]
            if k < 3:
                strong = [[float(t.n)] * 2, [(low[f"l_{f}"] or 0.0) / r for f in "us"], [(low[f"t_{f}"] or 0.0) / r**2 for f in "us"]][k]
            weak = float((k * e["p"] ** (k - 1) * np.diag(t.mid)).sum() / r) if k else 0.0
            rows.append((t.graph_id, k, *strong, weak, ln_r))
        return spark.createDataFrame(rows, "graph_id string, k int, u double, s double, v double, ln_r double")
    weights = {f: np.stack([e[f] ** k for k in lengths], axis=1) if lengths else np.zeros((len(e[f]), 0)) for f in "us"}
    middles = [inner(k) if k else np.zeros((len(e["p"]),) * 2) for k in lengths]

    width = {f: len(v) for f, v in t.values.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not lengths:
                continue
            q = {f: _matrix(b.column(1 + i), width[f]) for i, f in enumerate(FAMILIES)}
            out = {f: q[f] ** 2 @ weights[f] for f in "us"}
            weak = np.stack([np.einsum("ij,jk,ik->i", q["p"], x, q["p"]) for x in middles], axis=1)
            low = [b.column(4 + i).to_numpy() for i in range(4)]
            for i, k in enumerate(lengths):
                if k < 3:
                    out["u"][:, i], out["s"][:, i] = [(1.0, 1.0), (low[0] / r, low[1] / r), (low[2] / r**2, low[3] / r**2)][k]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), len(lengths))), pa.array(np.tile(np.asarray(lengths, dtype=np.int32), b.num_rows)), *[pa.array(x.ravel()) for x in (out["u"], out["s"], weak)]], ["node", "k", "u", "s", "v"])

    rows = t.rows.join(t.low, "node").select("node", *FAMILIES, "l_u", "l_s", "t_u", "t_s").mapInArrow(run, "node long, k int, u double, s double, v double")
    return rows.select(F.lit(t.graph_id).alias("graph_id"), "node", "k", "u", "s", "v", F.lit(ln_r).alias("ln_r"))
