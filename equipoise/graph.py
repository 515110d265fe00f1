"""Signed graphs as DataFrames: edges, nodes, and what is inferred about each graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import krylov, measures, spectral, walks
from .storage import store

EDGES = "graph_id string, src long, dst long, weight double"


def mirrored(edges: DataFrame) -> DataFrame:
    """Undirected edges in both directions; a loop once."""
    back = edges.where("src != dst").select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return edges.select("graph_id", "src", "dst", "weight").unionByName(back)


def normalized(edges: DataFrame) -> DataFrame:
    """Weights over the mean absolute weight of their graph's stored entries; the means are an aggregate, joined back."""
    means = edges.groupBy("graph_id").agg(F.avg(F.abs("weight")).alias("__mean"))
    return edges.join(means, "graph_id").withColumn("weight", F.col("weight") / F.col("__mean")).select(*edges.columns)


def erased(edges: DataFrame) -> DataFrame:
    """Signs in place of weights."""
    return edges.withColumn("weight", F.signum("weight"))


def semi(edges: DataFrame) -> DataFrame:
    """(X + X transposed) / 2."""
    back = edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return edges.select("graph_id", "src", "dst", "weight").unionByName(back).groupBy("graph_id", "src", "dst").agg((F.sum("weight") / 2).alias("weight"))


def check_range(kmin: int | None, kmax: int | None) -> None:
    for k in (kmin, kmax):
        if k is not None and (isinstance(k, bool) or not isinstance(k, int)):
            raise TypeError("'kmin' and 'kmax' have to be integers")
        if k is not None and k < 0:
            raise ValueError("'kmin' and 'kmax' can't be negative")
    if kmin is not None and kmax is not None and kmin > kmax:
        raise ValueError("'kmin' can't be greater than 'kmax'")


class SignedGraph:
    """Any number of signed graphs, keyed by graph_id; every operator handles all of them in one plan.

    edges: (graph_id, src, dst, weight); rows for one entry are added up, entries of weight 0 are no edges, rows with a null
    end or weight are left out, a null graph_id is the graph ''. An undirected graph's edges are given
    once and mirrored, or already mirrored. nodes: (graph_id, id, ...), by default the ends of edges; a node without
    edges counts. directed, weighted: None infers them graph by graph. Weights become signs, or are divided by the mean
    absolute weight if weighted. kmin: None is 2 for directed graphs and 3 for others; kmax is held to
    the number of nodes.
    """

    most_dense = 3_000

    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None, *, directed: bool | None = None, weighted: bool | None = None, kmin: int | None = None, kmax: int = 30, m: int | None = 5, semi: bool = True, weight_col: str = "weight"):
        check_range(kmin, kmax)
        if weight_col not in edges.columns:
            if weighted:
                raise AttributeError(f"weighted graphs need the edge column '{weight_col}'")
            edges = edges.withColumn(weight_col, F.lit(1.0))
        if "graph_id" not in edges.columns:
            edges = edges.withColumn("graph_id", F.lit(""))
        raw = edges.select(F.coalesce(F.col("graph_id").cast("string"), F.lit("")).alias("graph_id"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col(weight_col).cast("double").alias("weight"))
        raw = raw.where("src is not null and dst is not null and weight is not null").groupBy("graph_id", "src", "dst").agg(F.sum("weight").alias("weight")).where("weight != 0")
        if directed is False:
            pair = [F.least("src", "dst"), F.greatest("src", "dst")]
            both = raw.alias("a").join(raw.alias("b"), (F.col("a.graph_id") == F.col("b.graph_id")) & (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src")), "left")
            one = both.select("a.*", F.col("b.weight").alias("back")).where("src <= dst or back is null").select("graph_id", pair[0].alias("src"), pair[1].alias("dst"), "weight")
            raw = mirrored(one)
        self.raw = store(raw)
        self.kmin, self.kmax, self.m, self.semi_mode = kmin, kmax, m, semi
        self._large: bool | None = None
        self._powers: dict[tuple, DataFrame] = {}
        self.thin: dict[tuple, krylov.Thin] = {}
        ends = self.raw.select("graph_id", F.col("src").alias("id")).union(self.raw.select("graph_id", F.col("dst").alias("id"))).distinct()
        self.nodes = ends if nodes is None else nodes.select(*(["graph_id"] if "graph_id" in nodes.columns else [F.lit("").alias("graph_id")]), *[c for c in nodes.columns if c != "graph_id"])
        self.graphs = store(self._infer(directed, weighted))
        signs = self.raw.join(self.graphs.select("graph_id", "weighted", "mean_abs"), "graph_id")
        self.edges = signs.select("graph_id", "src", "dst", F.when(F.col("weighted"), F.col("weight") / F.col("mean_abs")).otherwise(F.signum("weight")).alias("weight"))

    def _infer(self, directed: bool | None, weighted: bool | None) -> DataFrame:
        """graph_id, n_nodes, n_edges, directed, weighted, mean_abs, kmin, kmax: one row for each graph."""
        e = self.raw
        back = e.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("back"))
        met = e.join(back, ["graph_id", "src", "dst"], "left")
        sums = met.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges"), F.avg(F.abs("weight")).alias("mean_abs"), F.max(~F.col("weight").eqNullSafe(F.col("back"))).alias("odd"), F.max(F.abs("weight") != 1).alias("unlike"))
        n = self.nodes.groupBy("graph_id").agg(F.countDistinct("id").alias("n_nodes"))
        is_directed = F.lit(directed) if directed is not None else F.coalesce("odd", F.lit(False))
        is_weighted = F.lit(weighted) if weighted is not None else F.coalesce("unlike", F.lit(False))
        out = n.join(sums, "graph_id", "left").select("graph_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), is_directed.alias("directed"), is_weighted.alias("weighted"), "mean_abs")
        kmin = F.lit(self.kmin) if self.kmin is not None else F.when(F.col("directed"), 2).otherwise(3)
        return out.withColumns({"kmin": kmin.cast("int"), "kmax": F.least(F.lit(self.kmax), F.col("n_nodes")).cast("int")})

    def __repr__(self) -> str:
        return f"SignedGraph(kmin={self.kmin}, kmax={self.kmax}, m={self.m}, semi={self.semi_mode}, edges={self.edges.columns})"

    # projections and filters
    @property
    def S(self) -> DataFrame:
        return self.edges

    @property
    def U(self) -> DataFrame:
        return self.edges.withColumn("weight", F.abs("weight"))

    @property
    def P(self) -> DataFrame:
        return self.edges.where("weight > 0")

    @property
    def N(self) -> DataFrame:
        return self.edges.where("weight < 0").withColumn("weight", -F.col("weight"))

    def strength(self) -> DataFrame:
        """graph_id, id, strength: row sums of U, 0 for nodes without edges."""
        sums = self.edges.groupBy("graph_id", F.col("src").alias("id")).agg(F.sum(F.abs("weight")).alias("strength"))
        return self.nodes.select("graph_id", "id").join(sums, ["graph_id", "id"], "left").withColumn("strength", F.coalesce("strength", F.lit(0.0)))

    def set_range(self, kmin: int | None = None, kmax: int | None = None) -> "SignedGraph":
        """Change the lengths of walks; what isn't given stays."""
        check_range(kmin, kmax)
        self.kmin, self.kmax = self.kmin if kmin is None else kmin, self.kmax if kmax is None else kmax
        low = F.lit(self.kmin) if self.kmin is not None else F.when(F.col("directed"), 2).otherwise(3)
        self.graphs = self.graphs.withColumns({"kmin": low.cast("int"), "kmax": F.least(F.lit(self.kmax), F.col("n_nodes")).cast("int")})
        return self

    # powers of the matrices: engine "spectral" (grouped eigenpairs), "relational" (joins) or "krylov" (leading eigenpairs of one large graph)
    def powers(self, what: str, K: list[int] | None = None, engine: str = "spectral") -> DataFrame:
        """Scaled traces, diagonals or entries of U^k, S^k and of V_k; see operators.spectral. Traces and diagonals are stored, and used again by every measure that asks for the same. One graph of more than `most_dense` nodes goes to "krylov" by itself, where m is given and it has symmetric matrices."""
        if engine == "spectral" and what != "pair" and self.m is not None and self._too_large():
            engine = "krylov"
        key = (what, tuple(K) if K is not None else (self.kmin, self.kmax), engine, self.m, self.semi_mode)
        if key not in self._powers:
            found = {"relational": walks, "spectral": spectral, "krylov": krylov}[engine].powers(self, what, K)
            if what == "pair":
                return found
            self._powers[key] = store(found)
        return self._powers[key]

    def _too_large(self) -> bool:
        if self._large is None:
            top = self.graphs.agg(F.count(F.lit(1)), F.max("n_nodes"), F.max("directed")).head()
            self._large = top[0] == 1 and top[1] > self.most_dense and (self.semi_mode or not top[2])
        return self._large

    def k_grid(self, K: list[int] | None = None) -> DataFrame:
        """graph_id, k: the lengths of walks of each graph."""
        grid = F.array(*map(F.lit, K)) if K is not None else F.sequence("kmin", "kmax")
        return self.graphs.select("graph_id", F.explode(grid).alias("k"))

    # measures; see operators.measures
    def beta_max(self, K: list[int] | None = None, engine: str = "spectral", eps: float = 1e-9) -> DataFrame:
        return measures.beta_max(self, K, engine, eps)

    def beta_grid(self, bmin: float = 0.0, bmax: float | None = None, size: int = 10) -> DataFrame:
        return measures.beta_grid(self, bmin, bmax, size)

    def balance_index(self, beta: list[float] | DataFrame | None = None, weak: bool = False, **kw) -> DataFrame:
        return measures.balance_index(self, beta, weak, **kw)

    def balance(self, beta: list[float] | DataFrame | None = None, weak: bool = False, **kw) -> DataFrame:
        return measures.balance_index(self, beta, weak, **kw).withColumn("value", (F.col("value") + 1) / 2)

    def k_balance(self, weak: bool = False, **kw) -> DataFrame:
        return measures.k_balance(self, weak, **kw)

    def contrib(self, beta: list[float] | DataFrame | None = None, extra_kmax: int = 0, **kw) -> DataFrame:
        return measures.contrib(self, beta, extra_kmax, **kw)

    def node_balance(self, beta: list[float] | DataFrame | None = None, weak: bool = False, **kw) -> DataFrame:
        return measures.node_balance(self, beta, weak, **kw)

    def node_contrib(self, beta: list[float] | DataFrame | None = None, normalize: bool = False, **kw) -> DataFrame:
        return measures.node_contrib(self, beta, normalize, **kw)

    def pairwise_index(self, beta: list[float] | DataFrame | None = None, weak: bool = False, **kw) -> DataFrame:
        return measures.pairwise_index(self, beta, weak, **kw)

    def pairwise_cohesion(self, beta: list[float] | DataFrame | None = None, weak: bool = False, **kw) -> DataFrame:
        return measures.pairwise_index(self, beta, weak, **kw).withColumn("value", (F.col("value") + 1) / 2)

    def find_clusters(self, beta: list[float] | DataFrame | None = None, **kw) -> DataFrame:
        from .operators import clusters

        return clusters.find_clusters(self, beta, **kw)


def count_if(c: Column) -> Column:
    return F.sum(c.cast("int"))
