"""The driver's tables as a virtual graph, and the headline queries over it with their equivalents in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .engine import Engine
from .mapping import MappedGraph, Table

BASE = "urn:tpch:"
TABLES = [
    Table("region", "r_regionkey"),
    Table("nation", "n_nationkey", {"n_regionkey": "region"}),
    Table("customer", "c_custkey", {"c_nationkey": "nation"}),
    Table("supplier", "s_suppkey", {"s_nationkey": "nation"}),
    Table("part", "p_partkey"),
    Table("orders", "o_orderkey", {"o_custkey": "customer"}),
    Table("lineitem", None, {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    Table("events", "event_id"),
    Table("documents", "doc_id"),
    Table("labels", "doc_id"),
    Table("pages", "page_id"),
    Table("benchmark", "item_id"),
    Table("conversations", None, {}),
]


_LAST: list[tuple[SparkSession, str, MappedGraph]] = []


def graph(spark: SparkSession, sf_dir: str) -> MappedGraph:
    """The mapping of a folder's tables; the last one is kept, so that schemas are read once."""
    if not (_LAST and _LAST[0][0] is spark and _LAST[0][1] == sf_dir):
        _LAST[:] = [(spark, sf_dir, MappedGraph(spark, TABLES, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), BASE))]
    return _LAST[0][2]


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, graph(spark, sf_dir), prefixes={"": BASE, "xsd": "http://www.w3.org/2001/XMLSchema#", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"})
