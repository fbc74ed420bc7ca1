"""Registered queries of files, results and interfaces: what is written comes back."""

from __future__ import annotations

import csv
import io
import json
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .graph_api import Graph, Namespace
from .queries import _all, _links, _ranks, order_quads
from .registry import QUAD, TRIPLE, one_file, register, table, workplace
from .service import Service
from .sources import files, loading, results
from .store import Store
from .terms import Term
from .update import Updater
from .workload import BASE, engine

_S, _P, _O = "'<urn:tpch:orders/' || o_orderkey || '>'", "'<urn:tpch:o_orderpriority>'", "'\"' || o_orderpriority || '\"'"
_PLAIN = f"SELECT {_S} AS s, {_P} AS p, {_O} AS o FROM orders"
_NATIONS = "SELECT '<urn:tpch:nation/' || n_nationkey || '>' AS s, '\"' || n_name || '\"' AS o FROM nation"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_quads(spark, sf_dir).where(F.col("g").isNotNull()).withColumn("g", F.lit(None).cast("string"))


def _turtle(spark: SparkSession, sf_dir: str) -> str:
    """A file of orders in Turtle with prefixes, lists of predicates and objects, and a blank node for each."""
    o = table(spark, sf_dir, "orders")
    line = F.format_string('o:%s t:o_orderpriority "%s" ; t:note [ t:of o:%s ] .', F.col("o_orderkey").cast("string"), "o_orderpriority", F.col("o_orderkey").cast("string"))
    return one_file(o.select(line.alias("value")), workplace(spark) + "/orders.ttl", "@prefix t: <urn:tpch:> .\n@prefix o: <urn:tpch:orders/> .\n")


@register(_PLAIN)
def load_ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workplace(spark) + "/nt"
    files.write_lines(_ranked(spark, sf_dir), path)
    return files.read_lines(spark, path, named=False).select("s", "p", "o")


@register(_all(_links(), _ranks()))
def load_nquads(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workplace(spark) + "/nq"
    files.write_lines(order_quads(spark, sf_dir), path, named=True)
    return files.read_lines(spark, path, named=True)


@register(f"{_PLAIN} UNION ALL SELECT '_:', '<urn:tpch:of>', {_S} FROM orders UNION ALL SELECT {_S}, '<urn:tpch:note>', '_:' FROM orders")
def load_turtle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Turtle file; blank nodes are told by their kind alone."""
    path = _turtle(spark, sf_dir)
    blank = lambda c: F.when(F.col(c).startswith("_:"), "_:").otherwise(F.col(c)).alias(c)
    return files.read(spark, path).select(blank("s"), "p", blank("o"))


@register("SELECT '<urn:tpch:region/' || n_regionkey || '>' AS g, '<urn:tpch:nation/' || n_nationkey || '>' AS s, '<urn:tpch:n_name>' AS p, '\"' || n_name || '\"' AS o FROM nation")
def load_trig(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    line = F.format_string('<urn:tpch:region/%s> { <urn:tpch:nation/%s> <urn:tpch:n_name> "%s" . }', F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"), "n_name")
    return files.read(spark, one_file(n.select(line.alias("value")), workplace(spark) + "/nations.trig"))


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """Two N-Triples files with one blank label in both and one triple in both, and an N-Quads file."""
    path = workplace(spark)
    nt = spark.createDataFrame([('_:b <urn:x:p> "1" .',), ("<urn:x:a> <urn:x:p> <urn:x:b> .",), ("# a note",)], "value string")
    one_file(nt, f"{path}/one.nt")
    one_file(nt, f"{path}/two.nt")
    named = order_quads(spark, sf_dir).where("g is not null")
    line = F.concat_ws(" ", "s", "p", "o", "g", F.lit("."))
    one_file(named.select(line.alias("value")), f"{path}/orders.nq")
    return path


@register(f"SELECT g, s, p, o FROM ({_ranks()}) UNION ALL SELECT NULL, '_:', '<urn:x:p>', unnest(['\"1\"', '\"1\"']) UNION ALL SELECT NULL, '<urn:x:a>', '<urn:x:p>', '<urn:x:b>'")
def load_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files below a folder as one set: a triple of two files is one, and blank nodes of two files are two."""
    found = files.read_all(spark, [_folder(spark, sf_dir)])
    return found.select("g", F.when(F.col("s").startswith("_:"), "_:").otherwise(F.col("s")).alias("s"), "p", "o")


@register("SELECT 3 AS files, 4 + count(*) AS read, 3 + count(*) AS quads, 1 AS repeated, 1 + count(DISTINCT o_orderstatus) AS graphs FROM orders")
def load_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load read and kept."""
    _, stats = loading.load(spark, [_folder(spark, sf_dir)])
    return spark.createDataFrame([(stats.files, stats.read, stats.quads, stats.repeated, stats.graphs)], "files long, read long, quads long, repeated long, graphs long")


@register(f"SELECT '<urn:x:into>' AS g, s, p, o FROM ({_PLAIN}) UNION ALL SELECT '<urn:x:into>', '_:', '<urn:tpch:of>', {_S} FROM orders UNION ALL SELECT '<urn:x:into>', {_S}, '<urn:tpch:note>', '_:' FROM orders")
def update_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOAD into a graph, and a silent one of what is not there."""
    path = _turtle(spark, sf_dir)
    state = Store.empty(spark)
    Updater(spark, state).run(f"LOAD <file://{quote(path)}> INTO GRAPH <urn:x:into> ; LOAD SILENT <http://x/none.nt>")
    blank = lambda c: F.when(F.col(c).startswith("_:"), "_:").otherwise(F.col(c)).alias(c)
    return state.quads.select("g", blank("s"), "p", blank("o"))


@register("SELECT '<urn:tpch:nation/' || n_nationkey || '>' AS s, CASE WHEN n_nationkey % 5 = 0 THEN '<urn:graphloom:not/broadMatch>' ELSE '<http://www.w3.org/2004/02/skos/core#broadMatch>' END AS p, '<urn:tpch:region/' || n_regionkey || '>' AS o, n_nationkey / 100.0::DOUBLE AS confidence FROM nation")
def load_sssom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An SSSOM table: a curie map, negated mappings and confidences."""
    n = table(spark, sf_dir, "nation")
    head = ["#curie_map:", "#  t: urn:tpch:", "#  skos: http://www.w3.org/2004/02/skos/core#", "subject_id\tpredicate_id\tpredicate_modifier\tobject_id\tconfidence"]
    line = F.concat_ws("\t", F.concat(F.lit("t:nation/"), F.col("n_nationkey").cast("string")), F.lit("skos:broadMatch"), F.when(F.expr("n_nationkey % 5 = 0"), "Not").otherwise(""), F.concat(F.lit("t:region/"), F.col("n_regionkey").cast("string")), (F.col("n_nationkey") / 100).cast("string"))
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(head)], "k int, value string").unionByName(n.select(F.lit(9).alias("k"), line.alias("value")))
    path = one_file(lines.coalesce(1).sortWithinPartitions("k").select("value"), workplace(spark) + "/nations.sssom.tsv")
    return files.read_sssom(spark, path).select("s", "p", "o", "confidence")


@register(_PLAIN)
def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workplace(spark) + "/snapshot"
    files.write_snapshot(_ranked(spark, sf_dir), path)
    return files.read_snapshot(spark, path).select("s", "p", "o")


# results


_ASKED = "SELECT ?s ?o WHERE { ?s :n_name ?o }"


@register(_NATIONS)
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = json.loads("".join(results.to_json(engine(spark, sf_dir).select(_ASKED, terms=True))))
    cell = lambda x: f"<{x['value']}>" if x["type"] == "uri" else f"\"{x['value']}\""
    return spark.createDataFrame([(cell(b["s"]), cell(b["o"])) for b in data["results"]["bindings"]], "s string, o string")


@register(_NATIONS)
def result_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    from xml.etree import ElementTree

    root = ElementTree.fromstring("".join(results.to_xml(engine(spark, sf_dir).select(_ASKED, terms=True))))
    at = "{http://www.w3.org/2005/sparql-results#}"
    found = [{b.get("name"): b[0].text for b in r.iter(f"{at}binding")} for r in root.iter(f"{at}result")]
    return spark.createDataFrame([(f"<{r['s']}>", f"\"{r['o']}\"") for r in found], "s string, o string")


@register("SELECT 'urn:tpch:nation/' || n_nationkey AS s, n_name AS o FROM nation")
def result_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the service, as a client asks for it."""
    service = Service(spark, Store.of(_nations(spark, sf_dir)))
    kind, body = service.query("SELECT ?s ?o WHERE { ?s <urn:tpch:n_name> ?o }", "text/csv")
    head, *found = csv.reader(io.StringIO(body))
    return spark.createDataFrame([tuple(r) for r in found] if (kind, head) == ("text/csv", ["s", "o"]) else [], "s string, o string")


@register(_NATIONS)
def result_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = "".join(results.to_tsv(engine(spark, sf_dir).select(_ASKED, terms=True))).splitlines()
    return spark.createDataFrame([tuple(x.split("\t")) for x in lines[1:]], "s string, o string")


@register("SELECT unnest(['json', 'xml']) AS form, unnest(['{\"head\": {}, \"boolean\": true}', 'true']) AS answer")
def result_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = engine(spark, sf_dir).query("ASK { ?r :r_regionkey 1 }")
    xml = results.ask_xml(answer).partition("<boolean>")[2].partition("<")[0]
    return spark.createDataFrame([("json", results.ask_json(answer)), ("xml", xml)], "form string, answer string")


@register("SELECT '<urn:tpch:nation/' || n_nationkey || '>' AS s, '<urn:x:name>' AS p, '\"' || n_name || '\"' AS o FROM nation")
def result_ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CONSTRUCT result in N-Triples, read again."""
    from .parser.rdf import parse_line

    out = engine(spark, sf_dir).select("CONSTRUCT { ?s <urn:x:name> ?o } WHERE { ?s :n_name ?o }")
    lines = "".join(results.graph_lines(out)).splitlines()
    return spark.createDataFrame([parse_line(x)[1:] for x in lines], TRIPLE)


# interfaces


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.lit(None).cast("string").alias("g"), F.format_string("<urn:tpch:nation/%s>", F.col("n_nationkey").cast("string")).alias("s"), F.lit("<urn:tpch:n_name>").alias("p"), F.concat(F.lit('"'), "n_name", F.lit('"')).alias("o"))


@register(_NATIONS)
def graph_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serialised by one graph object and parsed by another, whose patterns give the rows."""
    t = Namespace(BASE)
    first = Graph(spark, Store.of(_nations(spark, sf_dir)))
    first.bind("t", t)
    second = Graph(spark).parse(first.serialize())
    return spark.createDataFrame([(s.stored, o.stored) for s, _, o in second.triples((None, t.n_name, None))], "s string, o string")


@register("SELECT 'SELECT' AS type, 's,o' AS vars, count(*) AS n, count(*) > 0 AS truth FROM nation UNION ALL SELECT 'ASK', '', 1, true UNION ALL SELECT 'CONSTRUCT', 's,p,o', count(*), true FROM nation")
def result_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, variables, length, truth and rows of results."""
    g = Graph(spark, Store.of(_nations(spark, sf_dir)))
    g.bind("t", BASE)
    found = []
    for text in ("SELECT ?s ?o WHERE { ?s t:n_name ?o }", "ASK { ?s t:n_name ?o }", "CONSTRUCT { ?o <urn:x:of> ?s . ?s <urn:x:is> ?o } WHERE { ?s t:n_name ?o }"):
        r = g.result(text)
        n = len(r)
        assert sum(1 for _ in r) == n and all(isinstance(t, (Term, bool)) for row in r for t in (row if isinstance(row, tuple) else (row,)))
        found.append((r.type, ",".join(r.vars), n, bool(r)))
    return spark.createDataFrame(found, "type string, vars string, n long, truth boolean")


@register("SELECT 'select' AS form, true AS planned, c_custkey AS k FROM customer WHERE c_acctbal > 9000")
def explain_and_pragma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXPLAIN names the form and the scans; with passes switched off the rows are the same."""
    text = "SELECT ?k WHERE { ?c :c_custkey ?k ; :c_acctbal ?b FILTER(?b > 9000 && 1 = 1) }"
    ask = engine(spark, sf_dir)
    plan = json.loads(ask.query(f"EXPLAIN JSON {text}"))
    off = ask.select("PRAGMA disable = disable-pass-push-filters PRAGMA x = inline-equality PRAGMA x = coalesce-patterns PRAGMA x = fold-constants " + text)
    return off.select(F.lit(plan["form"]).alias("form"), F.lit("PushedFilters" in plan["physical"] and "Filter" in ask.query(f"EXPLAIN {text}")).alias("planned"), "k")


@register("SELECT 'simple' AS regime, 0::BIGINT AS n UNION ALL SELECT 'owl-rl', count(*) FROM nation")
def entailment_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same query under simple entailment and under OWL 2 RL."""
    from .regimes import answer

    schema = spark.createDataFrame([(None, "<urn:tpch:n_name>", "<http://www.w3.org/2000/01/rdf-schema#domain>", "<urn:x:Nation>")], QUAD)
    quads = _nations(spark, sf_dir).unionByName(schema)
    text = "SELECT (COUNT(*) AS ?n) WHERE { ?s a <urn:x:Nation> }"
    found = [answer(Engine(spark, quads), text, name).select(F.lit(name).alias("regime"), "n") for name in ("simple", "owl-rl")]
    return found[0].unionByName(found[1])
