"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line of the best of three warm runs each."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom import queries as Q
from graphloom.workload import engine

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

#: The six shapes of the published benchmark, over the driver's tables, and others of this engine.
SHAPES = {
    "q1_count": "SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }",
    "q2_group_sum_order": "SELECT ?name (COUNT(?order) AS ?n) (SUM(?amount) AS ?spend) WHERE { ?order :o_custkey ?c ; :o_totalprice ?amount . ?c :c_name ?name } GROUP BY ?name ORDER BY DESC(?spend) ?name LIMIT 20",
    "q3_three_joins": "SELECT ?name ?k ?p WHERE { ?l :l_orderkey ?o ; :l_partkey ?x ; :l_quantity ?q . ?o :o_custkey ?c ; :o_orderkey ?k . ?c :c_name ?name . ?x :p_name ?p FILTER(?q > 45) } LIMIT 1000",
    "q4_optional_distinct": "SELECT ?seg (COUNT(DISTINCT ?o) AS ?n) WHERE { ?c :c_mktsegment ?seg OPTIONAL { ?o :o_custkey ?c ; :o_totalprice ?t FILTER(?t > 1000) } } GROUP BY ?seg",
    "q5_construct": "CONSTRUCT { ?o <urn:x:by> ?c . ?o <urn:x:for> ?t } WHERE { ?o :o_custkey ?c ; :o_totalprice ?t ; :o_orderstatus 'P' }",
}


def update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional change over orders as quads: the shape of the sixth query."""
    from pyspark.sql import functions as F

    from graphloom.store import Store
    from graphloom.update import Updater

    orders = Q.table(spark, sf_dir, "orders")
    price = F.concat(F.lit('"'), F.col("o_totalprice").cast("string"), F.lit('"^^<http://www.w3.org/2001/XMLSchema#double>'))
    quads = Q.triples(orders, Q.iri("orders", "o_orderkey"), "<urn:tpch:o_totalprice>", price).select(F.lit(None).cast("string").alias("g"), "s", "p", "o")
    store = Store.of(quads)
    Updater(spark, store, {"": "urn:tpch:"}).run("DELETE { ?o :o_totalprice ?t } INSERT { ?o :o_large ?t } WHERE { ?o :o_totalprice ?t FILTER(?t > 300000) }")
    return store.quads


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    work: dict[str, Callable[[], DataFrame]] = {n: (lambda t=t: engine(spark, SF).select(t)) for n, t in SHAPES.items()}
    work["q6_update"] = lambda: update(spark, SF)
    for name in ("bgp_cycle4", "bgp_snowflake", "path_plus_ground", "sum_avg_min_max", "closure_strict"):
        work[name] = lambda name=name: Q.queries()[name](spark, SF)
    seconds = {}
    for name, make in work.items():
        best = float("inf")
        for _ in range(3):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        seconds[name] = round(best, 3)
    print(json.dumps({"metric": "headline graph queries, sum of best of three", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
