"""Measures of balance, as aggregates over scaled powers.

Lengths are weighted by beta^k / k!. With powers over r^k the weight is exp(k ln(beta r) - ln k! - beta r), never
above one, so numerators and denominators are plain sums and their common factor cancels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logs import lnfact


def betas(graph, beta: list[float] | float | DataFrame | None, engine: str) -> DataFrame:
    """graph_id, beta. Given numbers hold for every graph; None is each graph's own maximum."""
    if isinstance(beta, DataFrame):
        return beta
    if beta is None:
        return graph.beta_max(engine=engine)
    values = beta if isinstance(beta, list | tuple) else [beta]
    return graph.graphs.select("graph_id", F.explode(F.array(*[F.lit(float(b)) for b in values])).alias("beta"))


def weight(beta: str = "beta") -> Column:
    x = F.log(F.col(beta)) + F.col("ln_r")
    return F.exp(F.col("k") * x - lnfact(F.col("k")) - F.exp(x))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where there are no walks to compare with."""
    return F.when(b != 0, F.try_divide(a, b))


def log_parts(value: Column) -> tuple[Column, Column]:
    """(log of the absolute value with -inf for zero, sign) of a scaled power."""
    return F.when(value == 0, F.lit(float("-inf"))).otherwise(F.log(F.abs(value)) + F.col("k") * F.col("ln_r")), F.signum(value)


def log_powers(graph, what: str, K: list[int] | None = None, engine: str = "spectral") -> DataFrame:
    """Log-absolute value and sign of U^k, S^k and V_k: graph_id, keys, k, la_u, la_s, sg_s, la_v."""
    p = graph.powers(what, K, engine)
    return p.select(*[c for c in p.columns if c not in ("u", "s", "v", "ln_r")], log_parts(F.col("u"))[0].alias("la_u"), log_parts(F.col("s"))[0].alias("la_s"), log_parts(F.col("s"))[1].alias("sg_s"), log_parts(F.col("v"))[0].alias("la_v"))


def exponentials(graph, what: str, beta=None, K: list[int] | None = None, engine: str = "spectral") -> DataFrame:
    """graph_id, keys, beta, u, s, v, ln_scale: sums over k of beta^k / k! times the powers, over exp(ln_scale)."""
    p = graph.powers(what, K, engine)
    keys = [c for c in p.columns if c not in ("k", "u", "s", "v", "ln_r")]
    rows = p.join(betas(graph, beta, engine), "graph_id").withColumn("c", weight())
    sums = rows.groupBy(*keys, "beta").agg(*[F.sum(F.col(c) * F.col("c")).alias(c) for c in "usv"], F.max("ln_r").alias("ln_r"))
    return sums.withColumn("ln_scale", F.col("beta") * F.exp("ln_r"))


def beta_max(graph, K: list[int] | None = None, engine: str = "spectral", eps: float = 1e-9) -> DataFrame:
    """graph_id, beta: the least (k + 1) tr U^k / tr U^(k+1) over consecutive lengths, eps at least."""
    after = Window.partitionBy("graph_id").orderBy("k")
    t = graph.powers("trace", K, engine).select("graph_id", "k", "u", "ln_r", F.lead("u").over(after).alias("next"))
    step = F.when(F.col("next") > 0, (F.col("k") + 1) * F.col("u") / (F.col("next") * F.exp("ln_r")))
    return t.groupBy("graph_id").agg(F.greatest(F.min(step), F.lit(eps)).alias("beta"))


def beta_grid(graph, bmin: float = 0.0, bmax: float | None = None, size: int = 10) -> DataFrame:
    """graph_id, beta: `size` even steps from bmin (0: the machine epsilon) to bmax (None: the graph's maximum)."""
    top = graph.beta_max() if bmax is None else graph.graphs.select("graph_id", F.lit(float(bmax)).alias("beta"))
    low = bmin if bmin > 0 else math.ulp(1.0)
    spot = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.lit(low) + i * (F.col("beta") - F.lit(low)) / F.lit(float(max(1, size - 1))))
    return top.select("graph_id", F.explode(spot).alias("beta"))


def balance_index(graph, beta=None, weak: bool = False, K: list[int] | None = None, engine: str = "spectral") -> DataFrame:
    """graph_id, beta, value: texp(S) / texp(U), or 1 - 2 V / U."""
    t = exponentials(graph, "trace", beta, K, engine)
    index = 1 - 2 * ratio(F.col("v"), F.col("u")) if weak else ratio(F.col("s"), F.col("u"))
    return t.select("graph_id", "beta", index.alias("value"))


def k_balance(graph, weak: bool = False, K: list[int] | None = None, engine: str = "spectral") -> DataFrame:
    """graph_id, k, value: the share of balanced closed walks of each length."""
    value = 1 - ratio(F.col("v"), F.col("u")) if weak else (1 + ratio(F.col("s"), F.col("u"))) / 2
    return graph.powers("trace", K, engine).select("graph_id", "k", value.alias("value"))


def contrib(graph, beta=None, extra_kmax: int = 0, K: list[int] | None = None, engine: str = "spectral") -> DataFrame:
    """graph_id, beta, k, value: the share of each length in texp(U).

    With extra_kmax = e > 0 the denominator runs to kmax + e - 1 and shares aren't made to sum to one.
    """
    if extra_kmax > 0 and K is None:
        top = graph.graphs.agg(F.min("kmin"), F.max("kmax")).head()
        K = list(range(top[0], top[1] + extra_kmax))
        inside = F.col("k").between(F.col("kmin"), F.col("kmax"))
        used = (F.col("k") >= F.col("kmin")) & (F.col("k") <= F.col("kmax") + max(0, extra_kmax - 1))
    else:
        inside = used = F.lit(True)
    rows = graph.powers("trace", K, engine).join(betas(graph, beta, engine), "graph_id").join(graph.graphs.select("graph_id", "kmin", "kmax"), "graph_id").where(used)
    share = rows.withColumn("c", F.col("u") * weight())
    total = F.sum("c").over(Window.partitionBy("graph_id", "beta"))
    return share.withColumn("value", ratio(F.col("c"), total)).where(inside).select("graph_id", "beta", "k", "value")


def node_balance(graph, beta=None, weak: bool = False, clip: bool = True, report_incorrect: bool = False, nans_as_zeros: bool = False, K: list[int] | None = None, engine: str = "spectral") -> DataFrame:
    """graph_id, node, beta, value (null for a node without closed walks, or 0 if asked for), and incorrect if asked for: the share of a graph's values outside [0, 1], taken before clipping."""
    t = exponentials(graph, "diag", beta, K, engine)
    raw = 1 - ratio(F.col("v"), F.col("u")) if weak else (1 + ratio(F.col("s"), F.col("u"))) / 2
    if nans_as_zeros:
        raw = F.coalesce(raw, F.lit(0.0))
    out = t.select("graph_id", "node", "beta", raw.alias("value"))
    if report_incorrect:
        outside = F.coalesce((F.col("value") < 0) | (F.col("value") > 1), F.lit(False)).cast("double")
        share = out.groupBy("graph_id", "beta").agg(F.avg(outside).alias("incorrect"))
        out = out.join(share, ["graph_id", "beta"]).select("graph_id", "node", "beta", "value", "incorrect")
    if clip:
        out = out.withColumn("value", F.when(F.col("value").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "value"))))
    return out


def node_contrib(graph, beta=None, normalize: bool = False, K: list[int] | None = None, engine: str = "spectral") -> DataFrame:
    """graph_id, node, beta, value: a node's share of the closed walks; sums to one, or to the number of nodes if normalised."""
    t = exponentials(graph, "diag", beta, K, engine)
    sums = t.groupBy("graph_id", "beta").agg(F.sum("u").alias("__u"), F.count(F.lit(1)).alias("__n"))
    value = ratio(F.col("u"), F.col("__u")) * (F.col("__n") if normalize else 1)
    return t.join(sums, ["graph_id", "beta"]).select("graph_id", "node", "beta", value.alias("value"))


def pairwise_index(graph, beta=None, weak: bool = False, K: list[int] | None = None, engine: str = "spectral") -> DataFrame:
    """graph_id, i, j, beta, value; lengths start at 2 whatever kmin is."""
    if K is None:
        K = list(range(2, (graph.graphs.agg(F.max("kmax")).head()[0] or 1) + 1))
    t = exponentials(graph, "pair", beta, K, engine)
    index = 1 - 2 * ratio(F.col("v"), F.col("u")) if weak else ratio(F.col("s"), F.col("u"))
    return t.select("graph_id", "i", "j", "beta", index.alias("value"))
