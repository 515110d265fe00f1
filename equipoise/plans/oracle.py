"""DuckDB SQL for the registered queries: walks by recursive joins, everything else on top."""

from __future__ import annotations

BASE = """lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey"""
RAW = f"raw AS (SELECT CAST(c_nationkey AS BIGINT) src, CAST(s_nationkey AS BIGINT) dst, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -2.0 ELSE 1.0 END) AS DOUBLE) w FROM {BASE} WHERE c_nationkey <> s_nationkey GROUP BY 1, 2 HAVING w <> 0)"
YEARLY = f"raw AS (SELECT CAST(year(o_orderdate) AS VARCHAR) g, CAST(c_nationkey AS BIGINT) src, CAST(s_nationkey AS BIGINT) dst, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -2.0 ELSE 1.0 END) AS DOUBLE) w FROM {BASE} WHERE c_nationkey <> s_nationkey GROUP BY 1, 2, 3 HAVING w <> 0)"
SIGNS = "e AS (SELECT src, dst, CAST(sign(w) AS DOUBLE) w FROM raw)"
SEMI = "half AS (SELECT a, b, sum(u) u, sum(s) s, sum(p) p, sum(n) n FROM (SELECT src a, dst b, abs(w) / 2 u, w / 2 s, greatest(w, 0) / 2 p, greatest(-w, 0) n FROM e UNION ALL SELECT dst, src, abs(w) / 2, w / 2, greatest(w, 0) / 2, 0.0 FROM e) t GROUP BY a, b)"


def walks(most: int = 25) -> str:
    step = f"SELECT k + 1, m.a, w.j, sum(m.u * w.u), sum(m.s * w.s), sum(m.p * w.p), sum(m.p * w.v + m.n * w.p) FROM walk w JOIN half m ON m.b = w.i WHERE k < {most} GROUP BY k, m.a, w.j"
    return f"WITH RECURSIVE {RAW}, {SIGNS}, {SEMI}, walk(k, i, j, u, s, p, v) AS (SELECT 1, a, b, CAST(u AS DOUBLE), CAST(s AS DOUBLE), CAST(p AS DOUBLE), CAST(n AS DOUBLE) FROM half UNION ALL {step})"


TWO = "two AS (SELECT x.src i, y.dst j, sum(abs(x.w * y.w)) u, sum(x.w * y.w) s FROM e x JOIN e y ON x.dst = y.src GROUP BY 1, 2)"
ONE = "one AS (SELECT src i, dst j, abs(w) u, w s FROM e)"


def powers(where: str = "k >= 2", most: int = 25) -> str:
    """x(k, i, j, u, s, v): exact at lengths 1 and 2."""
    low = "SELECT 1 k, i, j, u, s, 0.0 v FROM one UNION ALL SELECT 2, i, j, u, s, 0.0 FROM two UNION ALL SELECT k, i, j, 0.0, 0.0, v FROM walk WHERE k <= 2 UNION ALL SELECT k, i, j, u, s, v FROM walk WHERE k > 2"
    return f"{walks(most)}, {ONE}, {TWO}, x AS (SELECT k, i, j, sum(u) u, sum(s) s, sum(v) v FROM ({low}) t WHERE {where} GROUP BY 1, 2, 3)"


def traces(most: int = 25, where: str = "k >= 2") -> str:
    return f"{powers(where, most)}, t AS (SELECT k, sum(u) u, sum(s) s, sum(v) v FROM x WHERE i = j GROUP BY k)"


BETAS = "b AS (SELECT unnest([CAST('0.1' AS DOUBLE), CAST('0.5' AS DOUBLE), CAST('1.0' AS DOUBLE)]) beta)"
C = "exp(k * ln(beta) - lgamma(k + 1))"
BMAX = "bm AS (SELECT min((a.k + 1) * a.u / c.u) beta FROM t a JOIN t c ON c.k = a.k + 1)"


def diagonal(value: str) -> str:
    return f"{powers()}, {BETAS} SELECT i AS node, round(beta, 6) AS beta, round({value}, 6) AS value FROM x, b WHERE i = j GROUP BY i, beta HAVING sum(u) > 0"


def texp(weak: bool, index: bool) -> str:
    r = f"sum(v * {C}) / sum(u * {C})" if weak else f"sum(s * {C}) / sum(u * {C})"
    value = f"1 - 2 * {r}" if weak else r
    return f"{traces()}, {BETAS} SELECT round(beta, 6) AS beta, round({value if index else f'(1 + {value}) / 2'}, 6) AS value FROM t, b GROUP BY beta"


def pairs(weak: bool) -> str:
    r = f"sum(v * {C}) / sum(u * {C})" if weak else f"(1 + sum(s * {C}) / sum(u * {C})) / 2"
    return f"{powers()}, b AS (SELECT CAST('0.5' AS DOUBLE) beta) SELECT i, j, round({'1 - ' + r if weak else r}, 6) AS value FROM x, b GROUP BY i, j HAVING sum(u) > 0"


SIMPLE = f"WITH {RAW}, {SIGNS}"
STRENGTH = "st AS (SELECT CAST(n_nationkey AS BIGINT) id, coalesce(sum(abs(w)), 0) x FROM nation LEFT JOIN e ON src = n_nationkey GROUP BY 1)"
CYCLES = f"""WITH RECURSIVE {RAW}, {SIGNS}, p(a, z, path, neg, k) AS (
  SELECT src, dst, [src, dst], CAST(w < 0 AS INT), 1 FROM e WHERE dst > src
  UNION ALL SELECT a, e.dst, list_append(path, e.dst), neg + CAST(w < 0 AS INT), k + 1 FROM p JOIN e ON e.src = z WHERE e.dst > a AND NOT list_contains(path, e.dst) AND k < 3),
  c AS (SELECT k + 1 AS length, sum(CAST((neg + CAST(w < 0 AS INT)) % 2 = 0 AS BIGINT)) positive, sum(CAST((neg + CAST(w < 0 AS INT)) % 2 = 1 AS BIGINT)) negative FROM p JOIN e ON e.src = z AND e.dst = a GROUP BY k)"""
FRUST = "sum(CASE WHEN a.n_regionkey = b.n_regionkey AND w < 0 THEN -w WHEN a.n_regionkey <> b.n_regionkey AND w > 0 THEN w ELSE 0 END)"
ENDS = "JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst"
PRES = "VALUES ('Nixon', DATE '1969-01-02', DATE '1974-08-09'), ('Ford', DATE '1974-08-04', DATE '1977-01-20'), ('Carter', DATE '1977-01-20', DATE '1981-01-20'), ('Reagan', DATE '1981-01-20', DATE '1989-01-20'), ('Bush', DATE '1989-01-20', DATE '1993-01-20'), ('Clinton', DATE '1993-01-20', DATE '2001-01-20'), ('Bush', DATE '2001-01-20', DATE '2009-01-20'), ('Obama', DATE '2009-01-20', DATE '2017-01-20')"
YSIGN = f"WITH {YEARLY}, e AS (SELECT g, src, dst, CAST(sign(w) AS DOUBLE) w FROM raw)"
YSTEP = "SELECT k + 1, m.g, m.a, w.j, sum(m.u * w.u), sum(m.s * w.s) FROM walk w JOIN half m ON m.b = w.i AND m.g = w.g WHERE k < 6 GROUP BY k, m.g, m.a, w.j"
YWALK = f"""WITH RECURSIVE {YEARLY}, e AS (SELECT g, src, dst, CAST(sign(w) AS DOUBLE) w FROM raw),
 half AS (SELECT g, a, b, sum(u) u, sum(s) s FROM (SELECT g, src a, dst b, abs(w) / 2 u, w / 2 s FROM e UNION ALL SELECT g, dst, src, abs(w) / 2, w / 2 FROM e) t GROUP BY 1, 2, 3),
 walk(k, g, i, j, u, s) AS (SELECT 1, g, a, b, CAST(u AS DOUBLE), CAST(s AS DOUBLE) FROM half UNION ALL {YSTEP}),
 x AS (SELECT k, g, sum(u) u, sum(s) s FROM walk WHERE i = j AND k > 2 GROUP BY 1, 2 UNION ALL SELECT 2, a.g, sum(abs(a.w * b.w)), sum(a.w * b.w) FROM e a JOIN e b ON a.g = b.g AND a.src = b.dst AND a.dst = b.src GROUP BY a.g)"""
PRUNE_ROUNDS = 8


def pruned() -> str:
    out, last = [f"{RAW}, {SIGNS}, q0 AS (SELECT src, dst, w FROM e)"], 0
    for i in range(PRUNE_ROUNDS):
        out.append(f"q{i + 1} AS (SELECT * FROM q{i} WHERE src IN (SELECT dst FROM q{i}) AND dst IN (SELECT src FROM q{i}))")
        last = i + 1
    return f"WITH {', '.join(out)} SELECT src, dst, w AS weight FROM q{last}"


REGIONS = f"WITH RECURSIVE {RAW}, reg AS (SELECT a.n_regionkey s, b.n_regionkey d, CAST(sign(sum(w)) AS DOUBLE) w FROM raw JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey <> b.n_regionkey GROUP BY 1, 2 HAVING sum(w) <> 0)"
PARTS = f"""{REGIONS},
 r(n, code, top) AS (SELECT 1, [0], 0 UNION ALL SELECT n + 1, list_append(code, c), greatest(top, c) FROM r, (SELECT unnest(range(5)) c) cs WHERE n < 5 AND c <= top + 1),
 sc AS (SELECT code, sum(CASE WHEN code[s + 1] = code[d + 1] AND w < 0 THEN -w WHEN code[s + 1] <> code[d + 1] AND w > 0 THEN w ELSE 0 END) / sum(abs(w)) v FROM r, reg WHERE n = 5 GROUP BY code)"""
COMP = f"""WITH RECURSIVE {RAW}, {SIGNS}, both_ AS (SELECT src a, dst b FROM e UNION SELECT dst, src FROM e), r(a, b) AS (SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT) FROM nation UNION SELECT r.a, both_.b FROM r JOIN both_ ON both_.a = r.b)
 SELECT a AS id, min(b) AS component FROM r GROUP BY a"""

SQL = {
    "graph_counts": f"{SIMPLE} SELECT CAST((SELECT count(*) FROM nation) AS BIGINT) AS n_nodes, CAST(count(*) AS BIGINT) AS n_edges, CAST(sum(CASE WHEN w > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos, CAST(sum(CASE WHEN w < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg, CAST((SELECT round(avg(abs(w)), 6) FROM raw) AS DOUBLE) AS mean_abs FROM e",
    "strength": f"{SIMPLE}, {STRENGTH} SELECT id, x AS value FROM st",
    "normalize_weights": f"WITH {RAW} SELECT src, dst, round(w / (SELECT avg(abs(w)) FROM raw), 6) AS value FROM raw",
    "erase_weights": f"{SIMPLE} SELECT src, dst, w AS value FROM e",
    "positive_part": f"{SIMPLE} SELECT src, dst, w AS value FROM e WHERE w > 0",
    "negative_part": f"{SIMPLE} SELECT src, dst, -w AS value FROM e WHERE w < 0",
    "unsigned": f"{SIMPLE} SELECT src, dst, abs(w) AS value FROM e",
    "semi_adjacency": f"{SIMPLE}, {SEMI} SELECT a AS src, b AS dst, CAST(s AS DOUBLE) AS value FROM half",
    "reciprocity_k2": f"{SIMPLE} SELECT CAST(sum(x.w * y.w) AS DOUBLE) AS value FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src",
    "trace_powers_unsigned": f"{traces(7)} SELECT k, round(ln(u), 6) AS value FROM t",
    "trace_powers_signed": f"{traces(7)} SELECT k, round(s, 6) AS value FROM t",
    "weak_trace_powers": f"{traces(7)} SELECT k, round(v, 6) AS value FROM t",
    "trace_texp": f"{traces()}, {BETAS} SELECT round(beta, 6) AS beta, round(ln(sum(u * {C})), 6) AS value FROM t, b GROUP BY beta",
    "diag_powers": f"{powers('k BETWEEN 2 AND 5', 5)} SELECT k, i AS node, round(u, 6) AS u, round(s, 6) AS s, round(v, 6) AS v FROM x WHERE i = j AND u > 0",
    "diag_texp": f"{powers()}, {BETAS} SELECT i AS node, round(beta, 6) AS beta, round(ln(sum(u * {C})), 6) AS value FROM x, b WHERE i = j GROUP BY i, beta HAVING sum(u) > 0",
    "matrix_powers": f"{powers('k BETWEEN 2 AND 4', 4)} SELECT k, i, j, round(u, 6) AS u, round(s, 6) AS s, round(v, 6) AS v FROM x WHERE u > 0",
    "matrix_texp": f"{powers()}, b AS (SELECT CAST('0.5' AS DOUBLE) beta) SELECT i, j, round(ln(sum(u * {C})), 6) AS value FROM x, b GROUP BY i, j HAVING sum(u) > 0",
    "beta_max": f"{traces()}, {BMAX} SELECT round(beta, 6) AS value FROM bm",
    "beta_grid": f"{traces()}, {BMAX} SELECT i, round(5e-324 + i * (beta - 5e-324) / 9, 6) AS value FROM bm, (SELECT unnest(range(10)) i) r",
    "balance_index_strong": texp(False, True),
    "balance_index_weak": texp(True, True),
    "balance_strong": texp(False, False),
    "balance_weak": texp(True, False),
    "balance_at_beta_max": f"{traces()}, {BMAX} SELECT round((1 + sum(s * {C}) / sum(u * {C})) / 2, 6) AS strong, round(1 - sum(v * {C}) / sum(u * {C}), 6) AS weak FROM t, bm",
    "k_balance_strong": f"{traces()} SELECT k, round((1 + s / u) / 2, 6) AS value FROM t",
    "k_balance_weak": f"{traces()} SELECT k, round(1 - v / u, 6) AS value FROM t",
    "contrib": f"{traces()}, {BMAX} SELECT k, round(u * {C} / sum(u * {C}) OVER (), 6) AS value FROM t, bm",
    "contrib_extra_kmax": f"{traces(12)}, b AS (SELECT CAST('0.1' AS DOUBLE) beta), c AS (SELECT k, u * {C} / sum(u * {C}) OVER () r FROM t, b) SELECT k, round(r, 6) AS value FROM c WHERE k <= 10",
    "node_balance_strong": diagonal(f"greatest(0, least(1, (1 + sum(s * {C}) / sum(u * {C})) / 2))"),
    "node_balance_weak": diagonal(f"greatest(0, least(1, 1 - sum(v * {C}) / sum(u * {C})))"),
    "node_contrib": f"{powers()}, {BETAS}, y AS (SELECT i, beta, sum(u * {C}) u FROM x, b WHERE i = j GROUP BY i, beta) SELECT i AS node, round(beta, 6) AS beta, round(u / sum(u) OVER (PARTITION BY beta), 6) AS value FROM y",
    "pairwise_cohesion_strong": pairs(False),
    "pairwise_cohesion_weak": pairs(True),
    "frustration_region": f"{SIMPLE} SELECT round({FRUST} / sum(abs(w)), 6) AS value FROM e {ENDS}",
    "frustration_raw": f"WITH {RAW} SELECT CAST({FRUST} AS DOUBLE) AS value FROM raw {ENDS}",
    "label_clusters": "WITH c AS (SELECT n_nationkey % 4 cluster, n_regionkey label, count(*) n FROM nation GROUP BY 1, 2), b AS (SELECT cluster, label, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) r FROM c) SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(n_nationkey % 4 AS BIGINT) AS cluster, label FROM nation JOIN b ON b.cluster = n_nationkey % 4 WHERE r = 1",
    "gini_strength": f"WITH {RAW}, {STRENGTH.replace('JOIN e', 'JOIN raw')}, o AS (SELECT x, row_number() OVER (ORDER BY x) i, count(*) OVER () n FROM st) SELECT round(2 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1) / CAST(max(n) AS DOUBLE), 6) AS value FROM o",
    "cycle_counts_exact": f"{CYCLES} SELECT length, CAST(positive AS BIGINT) AS positive, CAST(negative AS BIGINT) AS negative FROM c",
    "cycle_ratio_exact": f"{CYCLES} SELECT length, round(negative / CAST(positive + negative AS DOUBLE), 6) AS unbalanced, round(positive / CAST(positive + negative AS DOUBLE), 6) AS balanced FROM c",
    "clean_graph": pruned(),
    "weak_components": COMP,
    "yearly_balance": f"{YWALK} SELECT g AS graph_id, round((1 + sum(s * exp(k * ln(CAST('0.5' AS DOUBLE)) - lgamma(k + 1))) / sum(u * exp(k * ln(CAST('0.5' AS DOUBLE)) - lgamma(k + 1)))) / 2, 6) AS value FROM x GROUP BY g",
    "yearly_stats": f"{YSIGN}, n AS (SELECT g, n_nationkey id FROM (SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) g FROM orders) y CROSS JOIN nation), d AS (SELECT n.g, id, coalesce(sum(abs(w)), 0) d, coalesce(sum(CASE WHEN w > 0 THEN 1 ELSE 0 END), 0) p, coalesce(sum(CASE WHEN w < 0 THEN 1 ELSE 0 END), 0) q FROM n LEFT JOIN e ON e.g = n.g AND e.src = n.id GROUP BY 1, 2) SELECT g AS graph_id, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg, round(avg(d), 6) AS mean_degree, round(stddev_pop(d), 6) AS std_degree, round(stddev_pop(d) / avg(d), 6) AS cv FROM d GROUP BY g",
    "zscore_nodes": f"WITH {RAW}, {STRENGTH.replace('JOIN e', 'JOIN raw')} SELECT id, round((x - avg(x) OVER ()) / stddev_samp(x) OVER (), 6) AS value FROM st",
    "top2_cluster_share": "WITH c AS (SELECT n_regionkey, n_nationkey % 3 cluster, count(*) n FROM nation GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n DESC, cluster) r FROM c) SELECT n_regionkey AS region, round(sum(CASE WHEN r <= 2 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS share FROM r GROUP BY 1",
    "interval_join": f"WITH p(surname, a, z) AS ({PRES}), d AS (SELECT 93 + i AS congress, make_date(1973 + 2 * CAST(i AS INT), 1, 3) AS day FROM (SELECT unnest(range(22)) i) r) SELECT CAST(congress AS INT) AS congress, arg_max(surname, a) AS surname FROM d LEFT JOIN p ON day >= a AND day < z GROUP BY congress",
    "regr_loglog": "SELECT l_returnflag AS flag, round(regr_slope(log2(l_extendedprice), log2(l_quantity)), 6) AS slope, round(regr_intercept(log2(l_extendedprice), log2(l_quantity)), 6) AS intercept, round(regr_r2(log2(l_extendedprice), log2(l_quantity)), 6) AS r2 FROM lineitem GROUP BY 1",
    "quantiles": "SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.1), 6) AS q10, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.9), 6) AS q90 FROM lineitem GROUP BY 1",
    "correlation_error": "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(avg(abs((l_quantity - l_extendedprice) / l_extendedprice)), 6) AS error FROM lineitem",
    "undirected_mean_collapse": f"WITH {RAW} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(avg(w), 6) AS value FROM raw GROUP BY 1, 2",
    "contrib_argmax": f"{traces()}, {BETAS}, c AS (SELECT beta, k, u * {C} c FROM t, b) SELECT round(beta, 6) AS beta, arg_max(k, c) AS k FROM c GROUP BY beta",
    "set_partitions_best": f"{PARTS} SELECT CAST(count(*) AS BIGINT) AS partitions, round(min(v), 6) AS value FROM sc",
    "best_partition": f"{PARTS} SELECT array_to_string(code, ',') AS part_id, round(v, 6) AS value FROM sc ORDER BY round(v, 12), array_to_string(code, ',') LIMIT 1",
}

# the same walks over other matrices
_BODY = RAW.removeprefix("raw AS ")
UNDIRECTED = f"raw0 AS {_BODY}, und AS (SELECT least(src, dst) a, greatest(src, dst) b, avg(w) w FROM raw0 GROUP BY 1, 2 HAVING avg(w) <> 0), raw AS (SELECT a src, b dst, w FROM und UNION ALL SELECT b, a, w FROM und WHERE a <> b)"
SCALED = "e AS (SELECT src, dst, w / (SELECT avg(abs(w)) FROM raw) w FROM raw)"
AS_GIVEN = "half AS (SELECT src a, dst b, abs(w) u, w s, greatest(w, 0) p, greatest(-w, 0) n FROM e)"


def undirected(sql: str) -> str:
    """Over the mean of both directions, with lengths from 3."""
    return sql.replace(RAW, UNDIRECTED).replace("k >= 2", "k >= 3")


def scaled(sql: str) -> str:
    return sql.replace(SIGNS, SCALED)


def given(sql: str) -> str:
    return sql.replace(SEMI, AS_GIVEN)


YEAR_NODES = f"{YSIGN}, n AS (SELECT g, CAST(n_nationkey AS BIGINT) id FROM (SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) g FROM orders) y CROSS JOIN nation)"
YSTATS = SQL["yearly_stats"]
CODES = "f AS (SELECT n_regionkey r, min(n_nationkey) first FROM nation GROUP BY 1), code AS (SELECT r, row_number() OVER (ORDER BY first) - 1 c FROM f)"
AMI = """WITH c AS (SELECT n_regionkey a, n_nationkey % 4 b, CAST(count(*) AS DOUBLE) n FROM nation GROUP BY 1, 2), x AS (SELECT a, sum(n) x FROM c GROUP BY 1), y AS (SELECT b, sum(n) y FROM c GROUP BY 1), t AS (SELECT sum(n) t FROM c),
 mi AS (SELECT sum(n / t * ln(t * n / (x * y))) mi FROM c JOIN x USING (a) JOIN y USING (b), t),
 k AS (SELECT x, y, t, unnest(generate_series(CAST(greatest(1, x + y - t) AS BIGINT), CAST(least(x, y) AS BIGINT))) k FROM x, y, t),
 em AS (SELECT sum(k / t * ln(t * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(t - x + 1) + lgamma(t - y + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(t - x - y + k + 1))) em FROM k),
 h AS (SELECT (SELECT -sum(x / t * ln(x / t)) FROM x, t) hx, (SELECT -sum(y / t * ln(y / t)) FROM y, t) hy)
 SELECT round((mi - em) / ((hx + hy) / 2 - em), 6) AS ami FROM mi, em, h"""
ONE_BETA = f"{traces()}, b AS (SELECT CAST('1.0' AS DOUBLE) beta) SELECT round(beta, 6) AS beta, round((1 + sum(s * {C}) / sum(u * {C})) / 2, 6) AS value FROM t, b GROUP BY beta"

SQL |= {
    "beta_grid": f"{traces()}, {BMAX} SELECT round(2.220446049250313e-16 + i * (beta - 2.220446049250313e-16) / 9, 6) AS value FROM bm, (SELECT unnest(range(10)) i) r",
    "k_grid": "SELECT CAST(unnest(range(2, 26)) AS INT) AS k",
    "set_krange": "SELECT CAST(unnest(range(4, 10)) AS INT) AS k",
    "undirected_mirror": undirected(f"WITH {RAW} SELECT src, dst, round(w / (SELECT avg(abs(w)) FROM raw), 6) AS value FROM raw"),
    "undirected_balance": undirected(texp(False, False)),
    "undirected_node_balance": undirected(diagonal(f"greatest(0, least(1, (1 + sum(s * {C}) / sum(u * {C})) / 2))")),
    "undirected_k_balance_weak": undirected(SQL["k_balance_weak"]),
    "weighted_balance": scaled(texp(False, False)),
    "weighted_balance_weak": scaled(texp(True, False)),
    "weighted_pairwise_cohesion": scaled(pairs(False)),
    "non_semi_balance": given(ONE_BETA),
    "non_semi_k_balance": given(SQL["k_balance_strong"]),
    "krylov_balance": SQL["balance_strong"],
    "krylov_node_balance_weak": SQL["node_balance_weak"],
    "graphml_round_trip": f"WITH {RAW} SELECT src, dst, w AS value FROM raw",
    "random_graph": "SELECT CAST(900 AS BIGINT) AS n_edges, CAST(900 AS BIGINT) AS distinct_edges, CAST(0 AS BIGINT) AS not_ordered",
    "cycle_counts_sieve": f"{CYCLES} SELECT CAST(length AS INT) AS length, CAST(positive AS BIGINT) AS positive, CAST(negative AS BIGINT) AS negative FROM c",
    "is_symmetric": f"WITH {RAW} SELECT 'given' AS graph, (SELECT count(*) FROM raw a LEFT JOIN raw b ON a.src = b.dst AND a.dst = b.src AND a.w = b.w WHERE b.src IS NULL) = 0 AS symmetric UNION ALL SELECT 'mirrored', true",
    "ami_partition": AMI,
    "party_labels": "SELECT CASE right(c_name, 1) WHEN '1' THEN 'D' WHEN '2' THEN 'R' ELSE CASE WHEN upper(right(c_name, 1)) IN ('R', 'D') THEN upper(right(c_name, 1)) ELSE 'O' END END AS party, count(*) AS n FROM customer GROUP BY 1",
    "first_codes": f"WITH {CODES} SELECT CAST(n_nationkey AS BIGINT) AS id, c AS code FROM nation JOIN code ON r = n_regionkey",
    "labels_differing": f"WITH {CODES} SELECT CAST(sum(CASE WHEN c <> n_nationkey % 5 THEN 1 ELSE 0 END) AS BIGINT) AS differing FROM nation JOIN code ON r = n_regionkey",
    "clip_values": "SELECT CAST(s_suppkey AS BIGINT) AS id, round(greatest(0.0, least(1.0, s_acctbal / 5000)), 6) AS value FROM supplier",
    "strength_bounds": f"{YEAR_NODES}, d AS (SELECT n.g, id, coalesce(sum(abs(w)), 0) d FROM n LEFT JOIN e ON e.g = n.g AND e.src = n.id GROUP BY 1, 2) SELECT g AS graph_id, min(d) AS low, max(d) AS high FROM d GROUP BY 1",
    "least_column_row": f"{YSIGN}, n AS (SELECT g, src id, CAST(sum(CASE WHEN w > 0 THEN 1 ELSE 0 END) AS BIGINT) pos, CAST(sum(CASE WHEN w < 0 THEN 1 ELSE 0 END) AS BIGINT) neg FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY least(pos, neg), id) k FROM n) SELECT g AS graph_id, id, least(pos, neg) AS least, CASE WHEN pos <= neg THEN 'pos' ELSE 'neg' END AS column FROM r WHERE k = 1",
    "group_positions": "SELECT CAST(n_regionkey AS BIGINT) AS region, CAST(n_nationkey AS BIGINT) AS id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) - 1 AS position FROM nation",
    "positional_join": "WITH a AS (SELECT n_regionkey r, n_nationkey i, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) k FROM nation), b AS (SELECT n_regionkey r, n_nationkey i, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) k FROM nation) SELECT CAST(a.r AS BIGINT) AS region, CAST(a.i AS BIGINT) AS id, CAST(b.i AS BIGINT) AS other FROM a JOIN b ON a.r = b.r AND a.k = b.k",
    "stacked_stats": f"SELECT graph_id, unnest(['mean_degree', 'std_degree', 'cv']) AS stat, unnest([mean_degree, std_degree, cv]) AS value FROM ({YSTATS}) y",
    "suffix_columns": f"SELECT graph_id, mean_degree AS mean, std_degree AS std FROM ({YSTATS}) y",
    "keyed_concat": f"{SIMPLE} SELECT src, count(*) AS n, 'positive' AS sign, 0.0::DOUBLE AS mean_dst FROM e WHERE w > 0 GROUP BY 1 UNION ALL SELECT src, count(*), 'negative', round(avg(dst), 6) FROM e WHERE w < 0 GROUP BY 1",
    "crossing_edges_reweighted": f"WITH {RAW} SELECT src, dst, round(CASE WHEN a.n_regionkey <> b.n_regionkey THEN w * 0.5 ELSE w END, 6) AS value FROM raw {ENDS}",
    "heavy_edges": f"WITH {RAW} SELECT src, dst, w AS value FROM raw WHERE abs(w) > (SELECT avg(abs(w)) FROM raw)",
    "beta_curve_mean": f"{traces()}, {BETAS}, c AS (SELECT beta, k, u * {C} / sum(u * {C}) OVER (PARTITION BY beta) c FROM t, b) SELECT k, round(avg(c), 6) AS mean FROM c GROUP BY k",
}
