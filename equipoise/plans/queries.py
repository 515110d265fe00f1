"""The registered queries of the signed-graph operators, over the graphs of sources.fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, tables
from ..graph import SignedGraph, normalized, semi
from ..operators import clusters, cycles, measures
from ..sources import fixtures, generators, graphml
from ..sources.fixtures import table, trade, trade_edges, undirected_trade, yearly_trade
from ..storage import shared_folder

BETAS = [0.1, 0.5, 1.0]


def r6(c, name: str = "value"):
    return F.round(c, 6).alias(name)


def value(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, r6(F.col("value"))).where("value is not null")


def at_beta(df: DataFrame, *keys: str) -> DataFrame:
    return value(df.withColumn("beta", F.round("beta", 6)), *keys, "beta")


def entries(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", r6(F.col("weight")))


def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    g = trade(spark, d)
    signs = g.edges.groupBy("graph_id").agg(F.sum((F.col("weight") > 0).cast("long")).alias("n_pos"), F.sum((F.col("weight") < 0).cast("long")).alias("n_neg"))
    return g.graphs.join(signs, "graph_id").select("n_nodes", "n_edges", "n_pos", "n_neg", r6(F.col("mean_abs"), "mean_abs"))


def strength(spark, d):
    return trade(spark, d).strength().select("id", F.col("strength").alias("value"))


def normalize_weights(spark, d):
    return entries(normalized(trade_edges(spark, d)))


def erase_weights(spark, d):
    return entries(trade(spark, d).S)


def positive_part(spark, d):
    return entries(trade(spark, d).P)


def negative_part(spark, d):
    return entries(trade(spark, d).N)


def unsigned(spark, d):
    return entries(trade(spark, d).U)


def semi_adjacency(spark, d):
    return entries(semi(trade(spark, d).S))


def reciprocity_k2(spark, d):
    return trade(spark, d).powers("trace", [2]).select(F.round(F.col("s") * F.exp(2 * F.col("ln_r")), 6).alias("value"))


def _traces(spark, d, c: str) -> DataFrame:
    """Lengths to 7, where the counts still have six decimals in a double."""
    rows = trade(spark, d, kmax=7).powers("trace", engine="relational")
    return rows.select("k", r6(F.col(c) * F.exp(F.col("k") * F.col("ln_r"))))


def trace_powers_unsigned(spark, d):
    """Logarithms: the counts themselves outgrow six decimals."""
    return trade(spark, d, kmax=7).powers("trace", engine="relational").select("k", r6(F.log("u") + F.col("k") * F.col("ln_r")))


def trace_powers_signed(spark, d):
    return _traces(spark, d, "s")


def weak_trace_powers(spark, d):
    return _traces(spark, d, "v")


def _full(df: DataFrame, *keys: str) -> DataFrame:
    return df.where("u > 1e-15").select(*keys, *[r6(F.col(c) * F.exp(F.col("k") * F.col("ln_r")), c) for c in "usv"])


def diag_powers(spark, d):
    return _full(trade(spark, d, kmax=5).powers("diag", engine="relational"), "k", "node")


def matrix_powers(spark, d):
    return _full(trade(spark, d, kmax=4).powers("pair", engine="relational"), "k", "i", "j")


def _ln(df: DataFrame, *keys: str) -> DataFrame:
    return df.where("u > 0").select(*keys, r6(F.log("u") + F.col("ln_scale")))


def trace_texp(spark, d):
    return _ln(measures.exponentials(trade(spark, d), "trace", BETAS).withColumn("beta", F.round("beta", 6)), "beta")


def diag_texp(spark, d):
    return _ln(measures.exponentials(trade(spark, d), "diag", BETAS).withColumn("beta", F.round("beta", 6)), "node", "beta")


def matrix_texp(spark, d):
    return _ln(measures.exponentials(trade(spark, d), "pair", [0.5]), "i", "j")


def beta_max(spark, d):
    return trade(spark, d).beta_max().select(r6(F.col("beta")))


def beta_grid(spark, d):
    return measures.beta_grid(trade(spark, d)).select(r6(F.col("beta")))


def k_grid(spark, d):
    return trade(spark, d).k_grid().select("k")


def set_krange(spark, d):
    return trade(spark, d).set_range(4, 9).k_grid().select("k")


def balance_index_strong(spark, d):
    return at_beta(trade(spark, d).balance_index(BETAS))


def balance_index_weak(spark, d):
    return at_beta(trade(spark, d).balance_index(BETAS, weak=True))


def balance_strong(spark, d):
    return at_beta(trade(spark, d).balance(BETAS))


def balance_weak(spark, d):
    return at_beta(trade(spark, d).balance(BETAS, weak=True))


def balance_at_beta_max(spark, d):
    g = trade(spark, d)
    strong, weak = (g.balance(weak=w).select("graph_id", "value") for w in (False, True))
    return strong.join(weak.withColumnRenamed("value", "weak"), "graph_id").select(r6(F.col("value"), "strong"), r6(F.col("weak"), "weak"))


def k_balance_strong(spark, d):
    return value(trade(spark, d).k_balance(), "k")


def k_balance_weak(spark, d):
    return value(trade(spark, d).k_balance(weak=True), "k")


def contrib(spark, d):
    return value(trade(spark, d).contrib(), "k")


def contrib_extra_kmax(spark, d):
    return value(trade(spark, d, kmax=10).contrib([0.1], extra_kmax=3), "k")


def contrib_argmax(spark, d):
    return trade(spark, d).contrib(BETAS).groupBy(F.round("beta", 6).alias("beta")).agg(F.max_by("k", "value").alias("k"))


def node_balance_strong(spark, d):
    return at_beta(trade(spark, d).node_balance(BETAS), "node")


def node_balance_weak(spark, d):
    return at_beta(trade(spark, d).node_balance(BETAS, weak=True), "node")


def node_contrib(spark, d):
    return at_beta(trade(spark, d).node_contrib(BETAS), "node")


def pairwise_cohesion_strong(spark, d):
    return value(trade(spark, d).pairwise_cohesion([0.5]), "i", "j")


def pairwise_cohesion_weak(spark, d):
    return value(trade(spark, d).pairwise_cohesion([0.5], weak=True), "i", "j")


def _regions(spark, d) -> DataFrame:
    return fixtures.nations(spark, d).select(F.lit("trade").alias("graph_id"), F.lit(0).alias("part_id"), F.col("id").alias("node"), F.col("region").alias("cluster"))


def frustration_region(spark, d):
    return value(clusters.frustration(trade(spark, d).S, _regions(spark, d)))


def frustration_raw(spark, d):
    return clusters.frustration(trade_edges(spark, d), _regions(spark, d), normalized=False).select("value")


def label_clusters(spark, d):
    n = fixtures.nations(spark, d).withColumns({"graph_id": F.lit(""), "part_id": F.lit(0), "node": F.col("id"), "cluster": F.col("id") % 4, "label": F.col("region").cast("int")})
    return clusters.label_clusters(n.select("graph_id", "part_id", "node", "cluster"), n).select("node", "cluster", "label")


def gini_strength(spark, d):
    e = trade_edges(spark, d).groupBy(F.col("src").alias("id")).agg(F.sum(F.abs("weight")).alias("x"))
    x = fixtures.nations(spark, d).join(e, "id", "left").select(F.lit(0).alias("g"), F.coalesce("x", F.lit(0.0)).alias("x"))
    return stats.gini(x, "x", ["g"]).select(r6(F.col("gini")))


def cycle_counts_exact(spark, d):
    """Cycles of up to four nodes of the whole graph."""
    return cycles.count_cycles(trade(spark, d).S, 4).select("length", "positive", "negative")


def cycle_ratio_exact(spark, d):
    return cycles.ratios(cycles.count_cycles(trade(spark, d).S, 4)).select("length", r6(F.col("unbalanced"), "unbalanced"), r6(F.col("balanced"), "balanced"))


def clean_graph(spark, d):
    return cycles.clean(trade(spark, d).S).select("src", "dst", "weight")


def weak_components(spark, d):
    g = trade(spark, d)
    return cycles.weak_components(g.nodes, g.S).select("id", "component")


def yearly_balance(spark, d):
    """Walks up to length 6, as far as the SQL beside it counts them."""
    return value(yearly_trade(spark, d, kmax=6).balance([0.5]), "graph_id")


def yearly_stats(spark, d):
    g = yearly_trade(spark, d)
    w = F.col("weight")
    out = g.S.groupBy("graph_id", F.col("src").alias("id")).agg(F.sum(F.abs(w)).alias("d"), F.sum((w > 0).cast("long")).alias("p"), F.sum((w < 0).cast("long")).alias("q"))
    each = g.nodes.select("graph_id", "id").join(out, ["graph_id", "id"], "left").na.fill(0)
    return each.groupBy("graph_id").agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), r6(F.avg("d"), "mean_degree"), r6(F.stddev_pop("d"), "std_degree"), r6(F.stddev_pop("d") / F.avg("d"), "cv"))


def zscore_nodes(spark, d):
    e = trade_edges(spark, d).groupBy(F.col("src").alias("id")).agg(F.sum(F.abs("weight")).alias("x"))
    x = fixtures.nations(spark, d).join(e, "id", "left").select("id", F.lit(0).alias("g"), F.coalesce("x", F.lit(0.0)).alias("x"))
    return stats.zscores(x, "x", ["g"], "value").select("id", r6(F.col("value")))


def top2_cluster_share(spark, d):
    n = fixtures.nations(spark, d).select(F.col("region").cast("int").alias("region"), (F.col("id") % 3).alias("cluster"))
    return stats.top_share(n, ["region"], "cluster").select("region", r6(F.col("share"), "share"))


def interval_join(spark, d):
    days = spark.range(22).select((F.col("id") + 93).cast("int").alias("congress"), F.make_date((2 * F.col("id") + 1973).cast("int"), F.lit(1), F.lit(3)).alias("day"))
    return stats.latest_interval(days, "day", fixtures.presidents(spark), "start", "end").select("congress", "surname")


def regr_loglog(spark, d):
    out = stats.regression(table(spark, d, "lineitem"), F.log2("l_extendedprice"), F.log2("l_quantity"), ["l_returnflag"])
    return out.select(F.col("l_returnflag").alias("flag"), *[r6(F.col(c), c) for c in ("slope", "intercept", "r2")])


def quantiles(spark, d):
    q = stats.quantiles(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"], [0.1, 0.5, 0.9])
    return q.groupBy(F.col("l_returnflag").alias("flag")).pivot("share", [0.1, 0.5, 0.9]).agg(F.first("value")).toDF("flag", "a", "b", "c").select("flag", r6(F.col("a"), "q10"), r6(F.col("b"), "q50"), r6(F.col("c"), "q90"))


def correlation_error(spark, d):
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, d, "lineitem").agg(r6(F.corr(x, y), "r"), r6(stats.relative_error(x, y), "error"))


def undirected_mean_collapse(spark, d):
    return entries(generators.collapsed(trade_edges(spark, d)))


def _region_partitions(spark, d):
    edges = fixtures.region_trade(spark, d).withColumn("weight", F.signum("weight"))
    return edges, clusters.set_partitions(spark, 5).withColumn("graph_id", F.lit("trade"))


def set_partitions_best(spark, d):
    """Every partition of the graph of all five regions."""
    edges, parts = _region_partitions(spark, d)
    return clusters.frustration(edges, parts).agg(F.count(F.lit(1)).alias("partitions"), r6(F.min("value")))


def best_partition(spark, d):
    edges, parts = _region_partitions(spark, d)
    return clusters.best_partition(edges, parts).select("part_id", r6(F.col("value")))


def undirected_mirror(spark, d):
    return entries(undirected_trade(spark, d).S)


def undirected_balance(spark, d):
    return at_beta(undirected_trade(spark, d, weighted=False).balance(BETAS))


def undirected_node_balance(spark, d):
    return at_beta(undirected_trade(spark, d, weighted=False).node_balance(BETAS), "node")


def undirected_k_balance_weak(spark, d):
    return value(undirected_trade(spark, d, weighted=False).k_balance(weak=True), "k")


def weighted_balance(spark, d):
    return at_beta(trade(spark, d, weighted=True).balance(BETAS))


def weighted_balance_weak(spark, d):
    return at_beta(trade(spark, d, weighted=True).balance(BETAS, weak=True))


def weighted_pairwise_cohesion(spark, d):
    return value(trade(spark, d, weighted=True).pairwise_cohesion([0.5]), "i", "j")


def non_semi_balance(spark, d):
    return at_beta(trade(spark, d, semi=False).balance([1.0]))


def non_semi_k_balance(spark, d):
    return value(trade(spark, d, semi=False).k_balance(), "k")


def krylov_balance(spark, d):
    """The engine of large graphs, at full spectrum."""
    return at_beta(trade(spark, d).balance(BETAS, engine="krylov"))


def krylov_node_balance_weak(spark, d):
    return at_beta(trade(spark, d).node_balance(BETAS, weak=True, engine="krylov"), "node")


def market_balance(spark, d):
    """Three eigenpairs from either end of the graph of all customers and suppliers; it is bipartite, so only even lengths have closed walks."""
    g = SignedGraph(fixtures.customer_supplier(spark, d), directed=False, weighted=False, m=3)
    return g.balance([0.01], K=[4, 6, 8], engine="krylov")


def graphml_round_trip(spark, d):
    """The trade graph written as gzipped GraphML and read again."""
    g = trade(spark, d)
    path = f"{shared_folder(spark)}/trade.graphml"
    graphml.write(trade_edges(spark, d), g.nodes, path)
    edges, nodes, _ = graphml.read(spark, path)
    name = lambda end: nodes.select(F.col("id").alias(end), F.col("name_id").cast("long").alias(f"__{end}"))
    return edges.join(name("src"), "src").join(name("dst"), "dst").select(F.col("__src").alias("src"), F.col("__dst").alias("dst"), r6(F.col("weight")))


def random_graph(spark, d):
    e = generators.random_graph(spark, 200, 900, seed=4)
    return e.agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("src", "dst").alias("distinct_edges"), F.sum((F.col("src") >= F.col("dst")).cast("long")).alias("not_ordered"))


def cycle_counts_sieve(spark, d):
    return cycles.sieve_cycles(trade(spark, d).S, 4)


def is_symmetric(spark, d):
    both = {"given": cycles.is_symmetric(trade_edges(spark, d)), "mirrored": cycles.is_symmetric(undirected_trade(spark, d).S)}
    return tables.keyed_concat(both, "graph").select("graph", "symmetric")


def ami_partition(spark, d):
    n = fixtures.nations(spark, d).select(F.lit("trade").alias("graph_id"), F.col("region").alias("a"), (F.col("id") % 4).alias("b"))
    return clusters.adjusted_mi(n).select(r6(F.col("ami"), "ami"))


def party_labels(spark, d):
    parts = table(spark, d, "customer").select(F.upper(F.substring("c_name", -1, 1)).alias("x"))
    letter = F.when(F.col("x") == "1", "D").when(F.col("x") == "2", "R").otherwise(F.col("x"))
    return parts.select(stats.party(letter).alias("party")).groupBy("party").agg(F.count(F.lit(1)).alias("n"))


def first_codes(spark, d):
    n = fixtures.nations(spark, d).select(F.lit(0).alias("g"), "id", "region")
    return stats.first_codes(n, "region", "id", ["g"]).select("id", F.col("code").cast("long").alias("code"))


def labels_differing(spark, d):
    """Nations whose codes by first appearance differ between two labellings."""
    n = fixtures.nations(spark, d).select(F.lit(0).alias("g"), "id", "region", (F.col("id") % 5).alias("other"))
    both = stats.first_codes(n, "region", "id", ["g"]).withColumnRenamed("code", "a").drop("region")
    both = stats.first_codes(both, "other", "id", ["g"])
    return both.agg(F.sum((F.col("a") != F.col("code")).cast("long")).alias("differing"))


def clip_values(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), r6(stats.clip(F.col("s_acctbal") / 5000)))


def strength_bounds(spark, d):
    return tables.bounds(yearly_trade(spark, d).strength(), "strength", ["graph_id"])


def least_column_row(spark, d):
    """Each year's first nation with the least of positive and negative edges, and which of them it is."""
    e = yearly_trade(spark, d).S
    n = e.groupBy("graph_id", F.col("src").alias("id")).agg(F.sum((F.col("weight") > 0).cast("long")).alias("pos"), F.sum((F.col("weight") < 0).cast("long")).alias("neg"))
    n = n.select("graph_id", "id", F.least("pos", "neg").alias("least"), tables.least_column("pos", "neg").alias("column"))
    return tables.least_row(n, "least", ["graph_id"], ["id"])


def group_positions(spark, d):
    return tables.positions(fixtures.nations(spark, d), ["region"], [F.desc("id")]).select("region", "id", F.col("position").cast("long").alias("position"))


def positional_join(spark, d):
    n = fixtures.nations(spark, d)
    return tables.positional_join(n.select("region", "id"), n.select("region", F.col("id").alias("other")), [F.asc("id")], [F.desc("other")], ["region"]).select("region", "id", "other")


def stacked_stats(spark, d):
    return tables.stacked(yearly_stats(spark, d), ["graph_id"], ["mean_degree", "std_degree", "cv"])


def suffix_columns(spark, d):
    n = yearly_stats(spark, d).withColumnsRenamed({"mean_degree": "mean_stat", "std_degree": "std_stat"})
    return tables.by_suffix(n, ["graph_id"], "_stat").select("graph_id", "mean", "std")


def keyed_concat(spark, d):
    g = trade(spark, d)
    parts = {"positive": g.P.groupBy("src").agg(F.count(F.lit(1)).alias("n")), "negative": g.N.groupBy("src").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("dst"), "mean_dst"))}
    return tables.keyed_concat(parts, "sign").select("sign", "src", "n", F.coalesce("mean_dst", F.lit(0.0)).alias("mean_dst"))


def _crossing(spark, d):
    return tables.crossing(trade_edges(spark, d), fixtures.nations(spark, d).select("id", F.col("region").alias("group")), 0.5)


def crossing_edges_reweighted(spark, d):
    return entries(_crossing(spark, d))


def heavy_edges(spark, d):
    """Edges whose weight is above the mean of all, in absolute terms."""
    e = trade_edges(spark, d)
    return entries(e.join(e.agg(F.avg(F.abs("weight")).alias("mean")), F.abs("weight") > F.col("mean")))


def beta_curve_mean(spark, d):
    curve = tables.curve_mean(trade(spark, d).contrib(BETAS), ["graph_id", "k"])
    return curve.select("k", r6(F.col("mean"), "mean"))


# what SQL can't express: rows only
def spectral_balance_m(spark, d):
    return trade(spark, d, m=3).balance(BETAS)


def find_clusters(spark, d):
    return trade(spark, d).find_clusters([0.5], fill=0.5)


def cycle_ratio_sampled(spark, d):
    return cycles.sampled_ratio(trade(spark, d).S, 5)


def cycle_ratio_accuracy(spark, d):
    return cycles.sampled_ratio(trade(spark, d).S, 4, accuracy=0.01)


def ami(spark, d):
    pairs = trade(spark, d).find_clusters([0.5], fill=0.5).join(fixtures.nations(spark, d).withColumnRenamed("id", "node"), "node")
    return clusters.adjusted_mi(pairs.select("graph_id", F.col("cluster").alias("a"), F.col("region").alias("b")))


NAMES = """graph_counts strength normalize_weights erase_weights positive_part negative_part unsigned semi_adjacency reciprocity_k2 trace_powers_unsigned
trace_powers_signed weak_trace_powers trace_texp diag_powers diag_texp matrix_powers matrix_texp beta_max beta_grid balance_index_strong balance_index_weak
balance_strong balance_weak balance_at_beta_max k_balance_strong k_balance_weak contrib contrib_extra_kmax contrib_argmax node_balance_strong
node_balance_weak node_contrib pairwise_cohesion_strong pairwise_cohesion_weak frustration_region frustration_raw label_clusters gini_strength
cycle_counts_exact cycle_ratio_exact clean_graph weak_components yearly_balance yearly_stats zscore_nodes top2_cluster_share interval_join regr_loglog
quantiles correlation_error undirected_mean_collapse set_partitions_best best_partition spectral_balance_m non_semi_balance non_semi_k_balance find_clusters
cycle_ratio_sampled cycle_ratio_accuracy ami ami_partition k_grid set_krange undirected_mirror undirected_balance undirected_node_balance undirected_k_balance_weak
weighted_balance weighted_balance_weak weighted_pairwise_cohesion krylov_balance krylov_node_balance_weak market_balance graphml_round_trip random_graph
cycle_counts_sieve is_symmetric party_labels first_codes labels_differing clip_values strength_bounds least_column_row group_positions positional_join
stacked_stats suffix_columns keyed_concat crossing_edges_reweighted heavy_edges beta_curve_mean""".split()
QUERIES = {name: globals()[name] for name in NAMES}
