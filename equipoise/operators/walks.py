"""The relational engine: powers by iterated join and aggregation, exact, for graphs of some hundred nodes each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop, store


def steps(graph) -> DataFrame:
    """Semi-edges with all matrices side by side: graph_id, a, b, u, s, p (semi), n (as given), over exp(ln_r), the largest row sum of U."""
    e = graph.edges
    back = e.select("graph_id", F.col("src").alias("b"), F.col("dst").alias("a"), "weight")
    half = 0.5 if graph.semi_mode else 1.0
    w = F.col("weight")
    zero = F.lit(0.0)
    one = e.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"), (F.abs(w) * half).alias("u"), (w * half).alias("s"), (F.greatest(w, zero) * half).alias("p"), F.greatest(-w, zero).alias("n"))
    two = back.select("graph_id", "a", "b", F.abs(w) * half, w * half, F.greatest(w, zero) * half, zero)
    rows = one.union(two) if graph.semi_mode else one
    sums = rows.groupBy("graph_id", "a", "b").agg(*[F.sum(c).alias(c) for c in "uspn"])
    top = sums.groupBy("graph_id", "a").agg(F.sum("u").alias("d")).groupBy("graph_id").agg(F.max("d").alias("r"))
    return sums.join(top, "graph_id").select("graph_id", "a", "b", *[(F.col(c) / F.col("r")).alias(c) for c in "uspn"], F.log("r").alias("ln_r"))


def low_orders(graph, what: str, scale: DataFrame, k: int) -> DataFrame | None:
    """U and S of length 0 to 2, exact and never semi-symmetrised; graph_id, keys, u, s."""
    e, w = graph.edges, F.col("weight")
    keys = {"trace": [], "diag": ["node"], "pair": ["i", "j"]}[what]
    named = lambda df, i, j: df.withColumns({"node": F.col(i), "i": F.col(i), "j": F.col(j)})
    if k == 0:
        rows = named(graph.nodes.withColumns({"u": F.lit(1.0), "s": F.lit(1.0)}), "id", "id")
    elif k == 1:
        rows = named(e if what == "pair" else e.where("src = dst"), "src", "dst").withColumns({"u": F.abs(w), "s": w})
    else:
        f = e.select(F.col("graph_id").alias("g"), F.col("src").alias("mid"), F.col("dst").alias("end"), F.col("weight").alias("x"))
        met = e.join(f, (F.col("graph_id") == F.col("g")) & (F.col("dst") == F.col("mid"))).select("graph_id", "src", "end", (w * F.col("x")).alias("s"))
        rows = named(met if what == "pair" else met.where("src = end"), "src", "end").withColumn("u", F.abs("s"))
    sums = rows.groupBy("graph_id", *keys).agg(F.sum("u").alias("u"), F.sum("s").alias("s")).join(scale, "graph_id")
    return sums.select("graph_id", *keys, *[(F.col(c) / F.exp(k * F.col("ln_r"))).alias(c) for c in "us"])


def powers(graph, what: str, K: list[int] | None = None) -> DataFrame:
    """The same rows as operators.spectral.powers gives at full spectrum, but for entries that no walk reaches; scaled by the largest row sum.

    U^k, S^k, P^k and V_k advance together, one join and one aggregate a step, each step written before
    the next: V_k = P V_(k-1) + N P^(k-1). A matrix fills up to n * n rows, so this is for many small
    graphs or a few hundred nodes; hub nodes are skewed joins that the planner splits.
    """
    e = store(steps(graph))
    scale = e.groupBy("graph_id").agg(F.max("ln_r").alias("ln_r"))
    scale = store(graph.graphs.select("graph_id", "kmin", "kmax").join(scale, "graph_id", "left").withColumn("ln_r", F.coalesce("ln_r", F.lit(0.0))))
    last = max(K) if K is not None else (scale.agg(F.max("kmax")).head()[0] or 0)
    keys = {"trace": [], "diag": ["node"], "pair": ["i", "j"]}[what]
    own = F.col("k").isin(K) if K is not None else F.col("k").between(F.col("kmin"), F.col("kmax"))
    b = e.select("graph_id", F.col("a").alias("mid"), F.col("b").alias("to"), F.col("u").alias("eu"), F.col("s").alias("es"), F.col("p").alias("ep"), F.col("n").alias("en"))
    now, out, old = None, [], []
    for k in range(last + 1):
        if k == 1:
            now = e.select("graph_id", F.col("a").alias("i"), F.col("b").alias("j"), "u", "s", "p", F.col("n").alias("v"))
        elif k > 1:
            # from the left: (X^k)_ij = sum over the first step i -> mid of X_(i mid) (X^(k-1))_(mid j)
            first = b.select("graph_id", F.col("mid").alias("i0"), F.col("to").alias("i"), "eu", "es", "ep", "en")
            met = now.join(first, ["graph_id", "i"])
            now = store(met.groupBy("graph_id", F.col("i0").alias("i"), "j").agg(F.sum(F.col("eu") * F.col("u")).alias("u"), F.sum(F.col("es") * F.col("s")).alias("s"), F.sum(F.col("ep") * F.col("p")).alias("p"), F.sum(F.col("ep") * F.col("v") + F.col("en") * F.col("p")).alias("v")))
            old.append(now)
        if K is not None and k not in K:
            continue
        zero = [F.lit(0.0).alias(c) for c in "usv"]
        if k == 0:
            rows = low_orders(graph, what, scale, 0).select("graph_id", *keys, "u", "s", F.lit(0.0).alias("v"))
        else:
            at = now if what == "pair" else now.where("i = j").withColumn("node", F.col("i"))
            sums = at.groupBy("graph_id", *keys).agg(*[F.sum(c).alias(c) for c in "usv"])
            if k <= 2:
                exact = low_orders(graph, what, scale, k)
                part = sums.select("graph_id", *keys, F.lit(0.0).alias("u"), F.lit(0.0).alias("s"), "v").union(exact.select("graph_id", *keys, "u", "s", F.lit(0.0)))
                sums = part.groupBy("graph_id", *keys).agg(*[F.sum(c).alias(c) for c in "usv"])
            rows = sums
        if what != "pair":  # nodes and graphs without such walks have zeros
            every = (graph.nodes.select("graph_id", F.col("id").alias("node")) if what == "diag" else scale.select("graph_id")).select("graph_id", *keys, *zero)
            rows = rows.select("graph_id", *keys, "u", "s", "v").union(every).groupBy("graph_id", *keys).agg(*[F.sum(c).alias(c) for c in "usv"])
        out.append(rows.withColumn("k", F.lit(k)))
    joined = reduce(DataFrame.union, [x.select("graph_id", *keys, "k", "u", "s", "v") for x in out])
    done = store(joined.join(scale, "graph_id").where(own).select("graph_id", *keys, "k", "u", "s", "v", "ln_r"))
    for x in old:
        drop(x)
    return done
