"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

import json
import os
import time

from equipoise.plans.queries import QUERIES
from equipoise.session import local_session
from equipoise.sources.fixtures import customer_supplier, trade

HEADLINE = ["balance_strong", "balance_weak", "k_balance_strong", "k_balance_weak", "node_balance_strong", "node_balance_weak", "contrib", "pairwise_cohesion_strong", "frustration_region", "cycle_counts_exact", "yearly_balance", "find_clusters", "quantiles", "undirected_mean_collapse"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "8g"), max(8, cpus))
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    took = {}

    def clock(name, make) -> None:
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)

    for name in HEADLINE:
        clock(name, lambda n=name: QUERIES[n](spark, sf_dir))
    clock("market_edges", lambda: customer_supplier(spark, sf_dir))
    for m in (1, 2, 4, 8, 16):  # the grid of the efficiency study; construction is outside the clock, as there
        graph = trade(spark, sf_dir, m=m)
        for name, run in (("balance", lambda g=graph: g.balance([0.5])), ("k_balance", lambda g=graph: g.k_balance()), ("node_balance", lambda g=graph: g.node_balance([0.5]))):
            clock(f"{name}_m{m}", run)
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
