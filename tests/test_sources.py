"""Sources, generators, the stream of windows and the registered queries against DuckDB."""

import gzip

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from equipoise import streaming
from equipoise.graph import SignedGraph
from equipoise.sources import generators, graphml

DATA = "/root/testdata/sf0.001"

XML = """<?xml version="1.0" encoding="UTF-8"?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
<key id="v_name" for="node" attr.name="name" attr.type="string"/><key id="e_w" for="edge" attr.name="weight" attr.type="double"/><key id="e_x" for="edge" attr.name="x" attr.type="double"/>
<graph id="G" edgedefault="{kind}">
<node id="n0"><data key="v_name">ann</data></node><node id="n1"><data key="v_name">bob</data></node><node id="n10"/>
<edge source="n0" target="n1"><data key="e_w">-2</data><data key="e_x">5</data></edge><edge source="n1" target="n10"><data key="e_w">1</data><data key="e_x">6</data></edge>
</graph></graphml>"""


def test_graphml(spark, tmp_path):
    for name, kind in (("t1", "undirected"), ("t2", "directed")):
        with gzip.open(tmp_path / f"{name}.graphml.gz", "wt") as f:
            f.write(XML.format(kind=kind))
    edges, nodes, graphs = graphml.read(spark, str(tmp_path / "*.graphml.gz"))
    assert {(r.graph_id, r.src, r.dst, r.weight) for r in edges.collect()} == {("t1", 0, 1, -2), ("t1", 1, 0, -2), ("t1", 1, 2, 1), ("t1", 2, 1, 1), ("t2", 0, 1, -2), ("t2", 1, 2, 1)}
    assert {(r.id, (r.attrs or {}).get("name")) for r in nodes.where("graph_id = 't1'").collect()} == {(0, "ann"), (1, "bob"), (2, None)}
    assert {r.graph_id: r.directed for r in graphs.collect()} == {"t1": False, "t2": True}


def test_generators(spark, tmp_path):
    for n, m in ((100, 300), (10, 40)):
        e = generators.random_graph(spark, n, m).collect()
        assert len({(r.src, r.dst) for r in e}) == m and all(r.src < r.dst < n and abs(r.weight) == 1 for r in e)
    degrees = spark.range(200).withColumn("degree", F.lit(6))
    e = generators.configuration_graph(degrees)
    assert e.count() > 450 and e.where("src >= dst").count() == 0
    (tmp_path / "p.json").write_text('[{"name": "A", "start": "1974-08-04", "end": "1977-01-20"}]')
    assert str(generators.read_records(spark, str(tmp_path / "p.json")).head().start) == "1974-08-04"


def test_stream_of_windows(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", 0, 1, 1.0), ("2024-01-01 00:02:00", 1, 2, 1.0), ("2024-01-01 00:03:00", 2, 0, -1.0), ("2024-01-01 01:00:00", 0, 1, 1.0)], "at string, src long, dst long, weight double").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    writer = streaming.measure_stream(stream, "at", "1 hour", str(tmp_path / "edges"), lambda g: g.k_balance(), lambda df, n: seen.extend(df.collect()), directed=False, m=None, kmax=3)
    q = writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.graph_id, r.k): r.value for r in seen if r.k == 3} == pytest.approx({("2024-01-01T00:00:00", 3): 0.0})


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1


@pytest.mark.parametrize("name", ["graph_counts", "balance_strong", "balance_weak", "node_balance_weak", "pairwise_cohesion_weak", "trace_powers_signed", "cycle_counts_exact", "clean_graph", "set_partitions_best", "yearly_stats", "interval_join"])
def test_query_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "supplier", "nation"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    norm = lambda rows: sorted(tuple(round(float(x), 5) if isinstance(x, float) else str(x) for x in r) for r in rows)
    rows = norm(tuple(r[c] for c in columns) for r in got.collect())
    sql = con.sql(__spark_entry__.oracle_sql()[name])
    place = [sql.columns.index(c) for c in columns]
    assert rows == norm(tuple(r[i] for i in place) for r in con.execute(__spark_entry__.oracle_sql()[name]).fetchall())


def test_symmetric_input_is_undirected(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "src long, dst long, weight double")
    assert not SignedGraph(e).graphs.head().directed
