"""The registered queries of the graph operators, each over whole tables, and their equivalents in SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import incremental, rulebook, store
from .catalogue import SPARQL
from .engine import Engine
from .operators import closure
from .reason.engine import canonical, fixpoint, folded
from .reason.mappings import chained_confidence, infer
from .reason.rules import owl_rules, parse_rules
from .registry import FOUND, Query, iri, register, rows, table, text, triples
from .streaming.ticks import tumbling
from .terms import OWL, RDF_TYPE, RDFS, SKOS
from .update import Updater
from .workload import BASE, engine

def _sparql(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    text = SPARQL[name][0]
    out = engine(spark, sf_dir)
    if text.startswith("ASK"):
        return out.ask_row(text)
    df = out.select(text)
    return df.withColumn("spend", F.round("spend", 2)) if name == "flagship" else df


OF, IN = f"<{BASE}n_regionkey>", f"<{BASE}c_nationkey>"
# quads: the nations in the default graph, a graph for each region


def nation_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's region in the default graph, and its name in the graph of its region; region 0's names in the default graph too."""
    n = table(spark, sf_dir, "nation")
    default = triples(n, iri("nation", "n_nationkey"), OF, iri("region", "n_regionkey")).select(F.lit(None).cast("string").alias("g"), "s", "p", "o")
    name = F.concat(F.lit('"'), "n_name", F.lit('"'))
    named = n.select(iri("region", "n_regionkey").alias("g"), iri("nation", "n_nationkey").alias("s"), F.lit(f"<{BASE}n_name>").alias("p"), name.alias("o"))
    twice = named.where(F.col("g") == f"<{BASE}region/0>").withColumn("g", F.lit(None).cast("string"))
    return default.unionByName(named).unionByName(twice)


def over_quads(spark: SparkSession, sf_dir: str, text: str, strict: bool = False) -> DataFrame:
    return Engine(spark, nation_quads(spark, sf_dir), strict, {"": BASE}).select(text)


_Q = "'<urn:tpch:nation/' || n_nationkey || '>'"


@register(f"SELECT {_Q} AS s, '\"' || n_name || '\"' AS o FROM nation WHERE n_regionkey = 2")
def graph_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_quads(spark, sf_dir, "SELECT ?s ?o WHERE { GRAPH <urn:tpch:region/2> { ?s :n_name ?o } }")


@register(f"SELECT '<urn:tpch:region/' || n_regionkey || '>' AS g, {_Q} AS s, '\"' || n_name || '\"' AS o FROM nation")
def graph_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_quads(spark, sf_dir, "SELECT ?g ?s ?o WHERE { GRAPH ?g { ?s :n_name ?o } }")


@register(f"SELECT {_Q} AS s, '\"' || n_name || '\"' AS o FROM nation WHERE n_regionkey IN (0, 1)")
def graph_from_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_quads(spark, sf_dir, "SELECT ?s ?o FROM <urn:tpch:region/0> FROM <urn:tpch:region/1> WHERE { ?s :n_name ?o }")


@register("SELECT '<urn:tpch:region/' || n_regionkey || '>' AS g, count(*) AS n FROM nation WHERE n_regionkey = 3 GROUP BY n_regionkey")
def graph_from_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_quads(spark, sf_dir, "SELECT ?g (COUNT(*) AS ?n) FROM NAMED <urn:tpch:region/3> WHERE { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g")


@register("SELECT count(*) * 2 AS n FROM nation")
def graph_default_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_quads(spark, sf_dir, "SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }")


@register("SELECT count(*) + count(*) FILTER (n_regionkey = 0) AS n FROM nation")
def graph_strict_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_quads(spark, sf_dir, "SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }", strict=True)


@register(f"SELECT {_Q} AS s, '<urn:tpch:region/' || n_regionkey || '>' AS r, '\"' || n_name || '\"' AS name FROM nation")
def graph_joined_to_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_quads(spark, sf_dir, "SELECT ?s ?r ?name WHERE { ?s :n_regionkey ?r GRAPH ?r { ?s :n_name ?name } }")


# updates: every order's customer in the default graph, and its priority in the graph of its status


def order_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    default = triples(o, iri("orders", "o_orderkey"), f"<{BASE}o_custkey>", iri("customer", "o_custkey")).select(F.lit(None).cast("string").alias("g"), "s", "p", "o")
    named = triples(o, iri("orders", "o_orderkey"), f"<{BASE}o_orderpriority>", text("o_orderpriority"))
    return default.unionByName(o.select(iri("status", "o_orderstatus").alias("g"), iri("orders", "o_orderkey").alias("s")).join(named, "s").select("g", "s", "p", "o"))


def updated(spark: SparkSession, sf_dir: str, request: str) -> DataFrame:
    state = store.Store.of(order_quads(spark, sf_dir))
    Updater(spark, state, {"": BASE}).run(request)
    return state.quads


_O, _STATUS = "'<urn:tpch:orders/' || o_orderkey || '>'", "'<urn:tpch:status/' || o_orderstatus || '>'"
_CUST, _PRIORITY = "'<urn:tpch:customer/' || o_custkey || '>'", "'\"' || o_orderpriority || '\"'"


def _links(where: str = "true", p: str = "o_custkey", g: str = "NULL::VARCHAR") -> str:
    return f"SELECT {g} AS g, {_O} AS s, '<urn:tpch:{p}>' AS p, {_CUST} AS o FROM orders WHERE {where}"


def _ranks(where: str = "true", g: str = _STATUS, p: str = "o_orderpriority") -> str:
    return f"SELECT {g} AS g, {_O} AS s, '<urn:tpch:{p}>' AS p, {_PRIORITY} AS o FROM orders WHERE {where}"


def _all(*parts: str) -> str:
    return " UNION ALL ".join(parts)


_ONE, _TWO = ('"1"^^<http://www.w3.org/2001/XMLSchema#integer>', '"2"^^<http://www.w3.org/2001/XMLSchema#integer>')


@register(_all(_links(), _ranks(), f"SELECT '<urn:x:g>', '<urn:tpch:a>', '<urn:tpch:b>', unnest(['{_ONE}', '{_TWO}'])"))
def update_insert_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updated(spark, sf_dir, "INSERT DATA { GRAPH <urn:x:g> { :a :b 1 , 2 , 1 } :a :o_custkey <urn:tpch:customer/1> } ; DELETE DATA { :a :o_custkey <urn:tpch:customer/1> }")


@register(_all(_links("o_custkey <> 7"), _ranks()))
def update_delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updated(spark, sf_dir, "DELETE WHERE { ?s :o_custkey <urn:tpch:customer/7> }")


_URGENT = "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"


@register(_all(_links(f"NOT ({_URGENT})"), _links(_URGENT, "first"), _ranks()))
def update_modify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updated(spark, sf_dir, "DELETE { ?s :o_custkey ?c } INSERT { ?s :first ?c } WHERE { ?s :o_custkey ?c GRAPH <urn:tpch:status/F> { ?s :o_orderpriority '1-URGENT' } }")


@register(_all(_links(), _ranks("o_orderstatus <> 'P'"), _ranks("o_orderstatus = 'P'", p="was")))
def update_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updated(spark, sf_dir, "WITH <urn:tpch:status/P> DELETE { ?s :o_orderpriority ?o } INSERT { ?s :was ?o } WHERE { ?s :o_orderpriority ?o }")


@register(_all(_links(), _ranks("o_orderstatus <> 'F'"), _ranks("o_orderstatus IN ('F', 'P')", "'<urn:x:using>'")))
def update_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern sees the graphs of USING and nothing else; USING NAMED names them for GRAPH."""
    first = "DELETE { GRAPH <urn:tpch:status/F> { ?s ?p ?o } } INSERT { GRAPH <urn:x:using> { ?s ?p ?o } } USING <urn:tpch:status/F> WHERE { ?s ?p ?o }"
    second = "INSERT { GRAPH <urn:x:using> { ?s ?p ?o } } USING NAMED <urn:tpch:status/P> WHERE { GRAPH ?g { ?s ?p ?o } }"
    return updated(spark, sf_dir, f"{first} ; {second}")


@register(_all(_links(), _ranks(), _links(p="of", g=_CUST)))
def update_graph_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variable as the graph of a template."""
    return updated(spark, sf_dir, "INSERT { GRAPH ?c { ?s :of ?c } } WHERE { ?s :o_custkey ?c }")


@register(_all(_links(), _ranks("o_orderstatus <> 'P'")))
def update_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updated(spark, sf_dir, "CLEAR GRAPH <urn:tpch:status/P> ; DROP SILENT GRAPH <urn:x:none> ; CREATE GRAPH <urn:x:new>")


@register(_all(_links(), _ranks("o_orderstatus <> 'P'"), _ranks("o_orderstatus = 'F'", "'<urn:tpch:status/P>'")))
def update_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updated(spark, sf_dir, "COPY <urn:tpch:status/F> TO <urn:tpch:status/P>")


@register(_all(_links(), _ranks("o_orderstatus = 'O'"), _ranks("o_orderstatus = 'F'", "'<urn:tpch:status/P>'")))
def update_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updated(spark, sf_dir, "MOVE <urn:tpch:status/F> TO <urn:tpch:status/P>")


@register(_all(_links(), _ranks(), _ranks("o_orderstatus = 'F'", "'<urn:tpch:status/P>'")))
def update_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updated(spark, sf_dir, "ADD <urn:tpch:status/F> TO <urn:tpch:status/P>")


@register(f"SELECT g, s, p, o, 1 AS mult, 1 AS version FROM (SELECT NULL::VARCHAR AS g, '<urn:tpch:a>' AS s, '<urn:tpch:b>' AS p, unnest(['{_ONE}', '{_TWO}']) AS o) UNION ALL SELECT g, s, p, o, -1, 2 FROM ({_links('o_custkey = 7')})")
def store_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = store.Store.of(order_quads(spark, sf_dir))
    Updater(spark, state, {"": BASE}).run("INSERT DATA { :a :b 1 , 2 } ; INSERT DATA { :a :b 1 } ; DELETE WHERE { ?s :o_custkey <urn:tpch:customer/7> }")
    return state.changes()


def _history(spark: SparkSession, sf_dir: str) -> store.Store:
    """Three versions: as it was, without one customer's links, and with these again and one graph empty."""
    state = store.Store.of(order_quads(spark, sf_dir))
    Updater(spark, state, {"": BASE}).run("DELETE WHERE { ?s :o_custkey <urn:tpch:customer/7> }")
    again = store.visible(state.intervals(), 0).where((F.col("o") == f"<{BASE}customer/7>") & F.col("g").isNull())
    state.apply(state.quads.where(F.col("g") == f"<{BASE}status/P>"), again)
    return state


_VERSIONS = f"SELECT 0 AS version, g, s, p, o FROM ({_all(_links(), _ranks())}) UNION ALL SELECT 1, g, s, p, o FROM ({_all(_links('o_custkey <> 7'), _ranks())}) UNION ALL SELECT 2, g, s, p, o FROM ({_all(_links(), _ranks(_STATUS + ' <> ' + chr(39) + '<urn:tpch:status/P>' + chr(39)))})"


@register(_VERSIONS)
def store_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version from the intervals in which quads are there."""
    marks = _history(spark, sf_dir).intervals()
    found = [store.visible(marks, v).select(F.lit(v).alias("version"), "g", "s", "p", "o") for v in range(3)]
    return found[0].unionByName(found[1]).unionByName(found[2])


@register(_VERSIONS.replace("SELECT 0 AS version, g, s, p, o", "SELECT 0 AS version, g, s, p, o").split(" UNION ALL SELECT 1,")[0].replace("SELECT 0", "SELECT 3") + " WHERE false UNION ALL SELECT 1," + _VERSIONS.split(" UNION ALL SELECT 1,")[1])
def store_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that are read after compaction: a pinned one stays, with all after it."""
    state = _history(spark, sf_dir)
    state.pin(1)
    state.compact()
    found = [state.at(v).select(F.lit(v).alias("version"), "g", "s", "p", "o") for v in (1, 2)]
    return found[0].unionByName(found[1])


# storage


@register(f"SELECT '{OF}' AS p, count(*) AS triples, count(*) AS subjects, count(DISTINCT n_regionkey) AS objects, 1::BIGINT AS max_degree FROM nation UNION ALL SELECT '<urn:tpch:n_name>', count(*) + count(*) FILTER (n_regionkey = 0), count(*), count(DISTINCT n_name), CASE WHEN count(*) FILTER (n_regionkey = 0) > 0 THEN 2 ELSE 1 END FROM nation")
def store_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.statistics(nation_quads(spark, sf_dir))


@register(f"SELECT '<urn:tpch:n_name>' AS p, count(*) + count(*) FILTER (n_regionkey = 0) AS n FROM nation")
def store_top_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.top_predicates(nation_quads(spark, sf_dir), 1)


@register(f"SELECT DISTINCT unnest([g, s, p, o]) AS term FROM ({_all(_links(), _ranks())}) WHERE g IS NOT NULL UNION SELECT DISTINCT unnest([s, p, o]) FROM ({_links()})")
def store_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of ids; ids are distinct and give the quads back, or there are no rows."""
    quads = order_quads(spark, sf_dir)
    terms = closure.checkpointed(store.dictionary(quads))
    back = store.decode_ids(store.encode_ids(quads, terms), terms)
    same = quads.exceptAll(back).isEmpty() and back.exceptAll(quads).isEmpty() and terms.groupBy("id").count().where("count > 1").isEmpty()
    return terms.select("term") if same else terms.select("term").limit(0)


# closures


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each turn of a conversation to the next."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    name = lambda turn: F.concat_ws("-", "conv_id", turn)
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit(True).alias("has"))
    return c.join(nxt, ["conv_id", "turn"]).select(name("turn").alias("src"), name((F.col("turn") + 1)).alias("dst"))


_TURNS = "WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn FROM conversations), e AS (SELECT a.conv_id || '-' || a.turn AS src, a.conv_id || '-' || b.turn AS dst FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)"


@register(f"{_TURNS} SELECT src, dst FROM r")
def closure_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.transitive(turns(spark, sf_dir))


@register(f"{_TURNS} SELECT src, dst FROM r UNION SELECT src, src FROM e UNION SELECT dst, dst FROM e")
def closure_reflexive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.transitive(turns(spark, sf_dir), reflexive=True)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations whose suppliers serve customers of another nation often: a cyclic graph."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = joined.groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.where("src < dst").groupBy("src").agg(F.max_by("dst", F.struct("n", "dst")).alias("dst")).unionByName(pairs.where("src > dst").groupBy("src").agg(F.max_by("dst", F.struct("n", "dst")).alias("dst")))


_TRADES = """WITH RECURSIVE p AS (SELECT s_nationkey::BIGINT AS src, c_nationkey::BIGINT AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
e AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src, src < dst ORDER BY n DESC, dst DESC) AS k FROM p WHERE src <> dst) WHERE k = 1)"""


@register(f"{_TRADES}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r")
def closure_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.transitive(trades(spark, sf_dir))


@register(f"{_TURNS} SELECT node, least(node, min(o)) AS canon FROM (SELECT src AS node, dst AS o FROM r UNION SELECT dst, src FROM r) GROUP BY node")
def closure_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.components(turns(spark, sf_dir))


_WEIGHTED = f"{_TRADES}, w AS (SELECT src, dst, 1.0 / (2 + (src * 7 + dst * 3) % 4) AS c FROM e), r AS (SELECT src, dst, c::DOUBLE AS c, 1 AS d FROM w UNION SELECT r.src, w.dst, r.c * w.c, d + 1 FROM r JOIN w ON r.dst = w.src WHERE d < 25)"


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades(spark, sf_dir).select("src", "dst", (1.0 / (2 + (F.col("src") * 7 + F.col("dst") * 3) % 4)).alias("confidence"))


@register("""WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn FROM conversations), e AS (SELECT a.conv_id, a.turn AS x, 1.0::DOUBLE / (1 + a.turn % 2) AS c FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
r AS (SELECT conv_id, x, x + 1 AS y, c FROM e UNION ALL SELECT r.conv_id, r.x, e.x + 1, r.c * e.c FROM r JOIN e ON r.conv_id = e.conv_id AND e.x = r.y)
SELECT conv_id || '-' || x AS src, conv_id || '-' || y AS dst, c AS confidence FROM r""")
def closure_best_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.substring_index("src", "-", -1).cast("int")
    return closure.best_confidence(turns(spark, sf_dir).select("src", "dst", (F.lit(1.0) / (1 + turn % 2)).alias("confidence")))


@register(f"{_TURNS} SELECT src, dst FROM r")
def closure_insert_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure of all turns, the last ones of each conversation added to that of the others."""
    edges = turns(spark, sf_dir)
    late = F.substring_index("src", "-", -1).cast("int") >= 2
    base = closure.checkpointed(edges.where(~late))
    whole, _ = closure.insert_edges(base, closure.transitive(base), edges.where(late))
    return whole.select("src", "dst")


@register("WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn FROM conversations), e AS (SELECT a.conv_id || '-' || a.turn AS src, a.conv_id || '-' || b.turn AS dst FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.turn <> 1), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r")
def closure_delete_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = closure.checkpointed(turns(spark, sf_dir))
    gone = edges.where(F.substring_index("src", "-", -1) == "1")
    left, _ = closure.delete_edges(edges, closure.transitive(edges), gone)
    return left.select("src", "dst")


# reasoning


def world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small schema over nations, regions and customers, with the facts of the tables."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    t, sub, sup, dom, rng = RDF_TYPE, f"<{RDFS}subClassOf>", f"<{RDFS}subPropertyOf>", f"<{RDFS}domain>", f"<{RDFS}range>"
    schema = rows(
        spark,
        (f"<{BASE}Nation>", sub, f"<{BASE}Area>"), (f"<{BASE}Region>", sub, f"<{BASE}Area>"), (f"<{BASE}Area>", sub, f"<{BASE}Thing>"),
        (OF, dom, f"<{BASE}Nation>"), (OF, rng, f"<{BASE}Region>"), (OF, sup, f"<{BASE}within>"), (IN, sup, f"<{BASE}within>"),
        (f"<{BASE}within>", t, f"<{OWL}TransitiveProperty>"), (f"<{BASE}within>", f"<{OWL}inverseOf>", f"<{BASE}holds>"),
    )
    return schema.unionByName(triples(n, iri("nation", "n_nationkey"), OF, iri("region", "n_regionkey"))).unionByName(triples(c, iri("customer", "c_custkey"), IN, iri("nation", "c_nationkey")))


def inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixpoint(world(spark, sf_dir), owl_rules(), {"scm-sco": RDFS + "subClassOf", "scm-spo": RDFS + "subPropertyOf"}).triples


@register("SELECT '<urn:tpch:' || c || '>' AS o, n FROM (SELECT unnest([{'c': 'Nation', 'n': n}, {'c': 'Region', 'n': r}, {'c': 'Area', 'n': n + r}, {'c': 'Thing', 'n': n + r}], recursive := true) FROM (SELECT count(*) AS n, count(DISTINCT n_regionkey) AS r FROM nation))")
def owl_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cax-sco``, ``scm-sco``, ``prp-dom`` and ``prp-rng`` over all facts."""
    found = inferred(spark, sf_dir).where((F.col("p") == RDF_TYPE) & F.col("o").startswith(f"<{BASE}"))
    return found.groupBy("o").agg(F.count(F.lit(1)).alias("n"))


_WITHIN = "SELECT {a} AS s, {b} AS o FROM {t}"


@register("""SELECT '<urn:tpch:region/' || n_regionkey || '>' AS s, '<urn:tpch:customer/' || c_custkey || '>' AS o FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT '<urn:tpch:nation/' || c_nationkey || '>', '<urn:tpch:customer/' || c_custkey || '>' FROM customer UNION ALL SELECT '<urn:tpch:region/' || n_regionkey || '>', '<urn:tpch:nation/' || n_nationkey || '>' FROM nation""")
def owl_transitive_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prp-spo1``, ``prp-trp`` and ``prp-inv1`` together: what holds what."""
    return inferred(spark, sf_dir).where(F.col("p") == f"<{BASE}holds>").select("s", "o")


def _one_rule(spark: SparkSession, sf_dir: str, axioms: list[tuple[str, str, str]], names: tuple[str, ...], p: str | None = None) -> DataFrame:
    """What the named rules alone give over customers' nations and some axioms."""
    facts = triples(table(spark, sf_dir, "customer"), iri("customer", "c_custkey"), IN, iri("nation", "c_nationkey"))
    out = fixpoint(facts.unionByName(rows(spark, *axioms)), [r for r in owl_rules() if r.name in names]).inferred
    return (out.where(F.col("p") == p) if p else out).select("s", "p", "o")


_C, _N = "'<urn:tpch:customer/' || c_custkey || '>'", "'<urn:tpch:nation/' || c_nationkey || '>'"
_T = RDF_TYPE
#: rule: axioms and the SQL of what follows from them.
RULES: dict[str, tuple[list[tuple[str, str, str]], str]] = {
    "prp-dom": ([(IN, f"<{RDFS}domain>", "<urn:x:C>")], f"SELECT {_C} AS s, '{_T}' AS p, '<urn:x:C>' AS o FROM customer"),
    "prp-rng": ([(IN, f"<{RDFS}range>", "<urn:x:N>")], f"SELECT DISTINCT {_N} AS s, '{_T}' AS p, '<urn:x:N>' AS o FROM customer"),
    "prp-symp": ([(IN, _T, f"<{OWL}SymmetricProperty>")], f"SELECT {_N} AS s, '{IN}' AS p, {_C} AS o FROM customer"),
    "prp-spo1": ([(IN, f"<{RDFS}subPropertyOf>", "<urn:x:p>")], f"SELECT {_C} AS s, '<urn:x:p>' AS p, {_N} AS o FROM customer"),
    "prp-eqp1": ([(IN, f"<{OWL}equivalentProperty>", "<urn:x:p>")], f"SELECT {_C} AS s, '<urn:x:p>' AS p, {_N} AS o FROM customer"),
    "prp-eqp2": ([("<urn:x:p>", f"<{OWL}equivalentProperty>", IN)], f"SELECT {_C} AS s, '<urn:x:p>' AS p, {_N} AS o FROM customer"),
    "prp-inv1": ([(IN, f"<{OWL}inverseOf>", "<urn:x:p>")], f"SELECT {_N} AS s, '<urn:x:p>' AS p, {_C} AS o FROM customer"),
    "prp-inv2": ([("<urn:x:p>", f"<{OWL}inverseOf>", IN)], f"SELECT {_N} AS s, '<urn:x:p>' AS p, {_C} AS o FROM customer"),
    "cls-svf2": ([("<urn:x:R>", f"<{OWL}someValuesFrom>", f"<{OWL}Thing>"), ("<urn:x:R>", f"<{OWL}onProperty>", IN)], f"SELECT {_C} AS s, '{_T}' AS p, '<urn:x:R>' AS o FROM customer"),
    "cls-hv2": ([("<urn:x:R>", f"<{OWL}hasValue>", "<urn:tpch:nation/3>"), ("<urn:x:R>", f"<{OWL}onProperty>", IN)], f"SELECT {_C} AS s, '{_T}' AS p, '<urn:x:R>' AS o FROM customer WHERE c_nationkey = 3"),
    "prp-irp": ([(IN, _T, f"<{OWL}IrreflexiveProperty>"), ("<urn:x:a>", IN, "<urn:x:a>")], f"SELECT '<urn:x:a>' AS s, '{_T}' AS p, '<{OWL}Nothing>' AS o"),
    "prp-asyp": ([(IN, _T, f"<{OWL}AsymmetricProperty>"), ("<urn:tpch:nation/3>", IN, "<urn:tpch:customer/1>")], f"SELECT unnest(['<urn:tpch:customer/1>', '<urn:tpch:nation/3>']) AS s, '{_T}' AS p, '<{OWL}Nothing>' AS o FROM customer WHERE c_custkey = 1 AND c_nationkey = 3"),
    "prp-pdw": ([(IN, f"<{OWL}propertyDisjointWith>", "<urn:x:p>"), ("<urn:tpch:customer/1>", "<urn:x:p>", "<urn:tpch:nation/3>")], f"SELECT {_C} AS s, '{_T}' AS p, '<{OWL}Nothing>' AS o FROM customer WHERE c_custkey = 1 AND c_nationkey = 3"),
    "prp-fp": ([(IN, _T, f"<{OWL}FunctionalProperty>")], f"SELECT DISTINCT {_N} AS s, '<{OWL}sameAs>' AS p, {_N} AS o FROM customer"),
    "eq-rep-p": ([(IN, f"<{OWL}sameAs>", "<urn:x:p>")], f"SELECT {_C} AS s, '<urn:x:p>' AS p, {_N} AS o FROM customer"),
    "eq-rep-s": ([("<urn:tpch:customer/1>", f"<{OWL}sameAs>", "<urn:x:a>")], f"SELECT '<urn:x:a>' AS s, '{IN}' AS p, {_N} AS o FROM customer WHERE c_custkey = 1"),
    "eq-rep-o": ([("<urn:tpch:nation/3>", f"<{OWL}sameAs>", "<urn:x:n>")], f"SELECT {_C} AS s, '{IN}' AS p, '<urn:x:n>' AS o FROM customer WHERE c_nationkey = 3"),
}


def _rule_query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _one_rule(spark, sf_dir, RULES[name][0], (name,))
    # the symmetric and transitive closure of owl:sameAs runs beside every rule
    return out.where(F.col("p") != f"<{OWL}sameAs>") if name.startswith("eq-rep") else out


@register("SELECT '<urn:tpch:customer/' || c_custkey || '>' AS s FROM customer WHERE c_acctbal > 9000 AND c_nationkey < 12")
def owl_disjoint_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cax-dw``: customers in two disjoint classes."""
    c = table(spark, sf_dir, "customer")
    rich = triples(c.where("c_acctbal > 9000"), iri("customer", "c_custkey"), RDF_TYPE, F.lit("<urn:x:Rich>"))
    near = triples(c.where("c_nationkey < 12"), iri("customer", "c_custkey"), RDF_TYPE, F.lit("<urn:x:Near>"))
    facts = rich.unionByName(near).unionByName(rows(spark, ("<urn:x:Rich>", f"<{OWL}disjointWith>", "<urn:x:Near>")))
    return fixpoint(facts, [r for r in owl_rules() if r.name == "cax-dw"]).faults()


@register("SELECT '<urn:tpch:customer/' || c_custkey || '>' AS s FROM customer WHERE c_acctbal > 9000 AND c_nationkey < 12 AND c_mktsegment = 'BUILDING'")
def owl_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cls-int1`` over a list of three classes."""
    c, first, rest = table(spark, sf_dir, "customer"), "<http://www.w3.org/1999/02/22-rdf-syntax-ns#first>", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#rest>"
    parts = [triples(c.where(w), iri("customer", "c_custkey"), RDF_TYPE, F.lit(f"<urn:x:{k}>")) for k, w in (("A", "c_acctbal > 9000"), ("B", "c_nationkey < 12"), ("C", "c_mktsegment = 'BUILDING'"))]
    cells = [("<urn:x:K>", f"<{OWL}intersectionOf>", "_:1"), ("_:1", first, "<urn:x:A>"), ("_:1", rest, "_:2"), ("_:2", first, "<urn:x:B>"), ("_:2", rest, "_:3"), ("_:3", first, "<urn:x:C>"), ("_:3", rest, "<http://www.w3.org/1999/02/22-rdf-syntax-ns#nil>")]
    facts = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(rows(spark, *cells))
    out = fixpoint(facts, [], None, lists=True).inferred
    return out.where((F.col("p") == RDF_TYPE) & (F.col("o") == "<urn:x:K>")).select("s")


@register("SELECT '<urn:tpch:customer/' || c_custkey || '>' AS node, min('<urn:tpch:customer/' || c_custkey || '>') OVER (PARTITION BY c_nationkey, c_mktsegment) AS canon FROM customer QUALIFY count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) > 1")
def owl_key_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prp-key``: equal nation and segment make customers the same; every member with the representative of its class."""
    c, first, rest = table(spark, sf_dir, "customer"), "<http://www.w3.org/1999/02/22-rdf-syntax-ns#first>", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#rest>"
    facts = triples(c, iri("customer", "c_custkey"), RDF_TYPE, F.lit("<urn:x:A>")).unionByName(triples(c, iri("customer", "c_custkey"), IN, iri("nation", "c_nationkey")))
    facts = facts.unionByName(triples(c, iri("customer", "c_custkey"), "<urn:x:seg>", text("c_mktsegment")))
    cells = [("<urn:x:A>", f"<{OWL}hasKey>", "_:1"), ("_:1", first, IN), ("_:1", rest, "_:2"), ("_:2", first, "<urn:x:seg>"), ("_:2", rest, "<http://www.w3.org/1999/02/22-rdf-syntax-ns#nil>")]
    return folded(facts.unionByName(rows(spark, *cells)), [], {}, lists=True).classes


@register("SELECT least('<urn:tpch:nation/' || n_nationkey || '>', '<urn:x:n' || n_nationkey || '>') AS s, n_nationkey::BIGINT AS k FROM nation")
def owl_same_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``owl:sameAs`` classes folded to their least member."""
    n = table(spark, sf_dir, "nation")
    same = triples(n, iri("nation", "n_nationkey"), f"<{OWL}sameAs>", F.concat(F.lit("<urn:x:n"), F.col("n_nationkey").cast("string"), F.lit(">")))
    keys = triples(n, F.concat(F.lit("<urn:x:n"), F.col("n_nationkey").cast("string"), F.lit(">")), "<urn:x:k>", F.concat(F.lit('"'), F.col("n_nationkey").cast("string"), F.lit('"')))
    out = canonical(same.unionByName(keys)).where("p = '<urn:x:k>'")
    return out.select("s", F.regexp_extract("o", "[0-9]+", 0).cast("long").alias("k"))


# mappings

_EXACT, _BROAD, _NARROW = (f"<{SKOS}{n}Match>" for n in ("exact", "broad", "narrow"))


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations match their names exactly, and names have broader matches in regions."""
    n = table(spark, sf_dir, "nation")
    name = F.concat(F.lit("<urn:x:"), "n_name", F.lit(">"))
    return triples(n, iri("nation", "n_nationkey"), _EXACT, name).unionByName(triples(n, name, _BROAD, iri("region", "n_regionkey")))


@register(f"SELECT s, p, o FROM (SELECT unnest([{{'s': a, 'p': '{_BROAD}', 'o': r}}, {{'s': r, 'p': '{_NARROW}', 'o': a}}, {{'s': r, 'p': '{_NARROW}', 'o': x}}], recursive := true) FROM (SELECT '<urn:tpch:nation/' || n_nationkey || '>' AS a, '<urn:x:' || n_name || '>' AS x, '<urn:tpch:region/' || n_regionkey || '>' AS r FROM nation))")
def sssom_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chaining and inversion together."""
    return infer(mapped(spark, sf_dir)).inferred.select("s", "p", "o")


@register("SELECT '<urn:tpch:nation/' || n_nationkey || '>' AS s, '<urn:tpch:region/' || n_regionkey || '>' AS o, 0.45 AS confidence FROM nation")
def sssom_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mapped(spark, sf_dir)
    left = m.where(F.col("p") == _EXACT).withColumn("confidence", F.lit(0.9))
    right = m.where(F.col("p") == _BROAD).withColumn("confidence", F.lit(0.5))
    return chained_confidence(left, right).select("s", "o", F.round("confidence", 6).alias("confidence"))


# incremental maintenance


def _tests(spark: SparkSession) -> list:
    return parse_rules("within: ?x <urn:x:in> ?y . ?y <urn:x:in> ?z => ?x <urn:x:in> ?z")


def located(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return triples(c, iri("customer", "c_custkey"), "<urn:x:in>", iri("nation", "c_nationkey")), triples(n, iri("nation", "n_nationkey"), "<urn:x:in>", iri("region", "n_regionkey"))


@register("SELECT o_custkey AS k, count(*) - count(*) FILTER (o_orderstatus = 'F') AS mult FROM orders GROUP BY o_custkey HAVING count(*) <> count(*) FILTER (o_orderstatus = 'F')")
def zset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_custkey").alias("k")
    return incremental.minus(incremental.zset(o.select(key)), incremental.zset(o.where("o_orderstatus = 'F'").select(key)))


@register("SELECT c_nationkey::BIGINT AS n, count(*) AS mult FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 10 = 0 OR c_custkey % 10 = 0 GROUP BY c_nationkey")
def zset_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change of customers joined with orders when a tenth of either arrives."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("n"))
    o = table(spark, sf_dir, "orders")
    new_c, new_o = F.col("k") % 10 == 0, F.col("o_orderkey") % 10 == 0
    z = incremental.zset
    side = lambda w: z(o.where(w).select(F.col("o_custkey").alias("k")))
    out = incremental.bilinear(z(c.where(~new_c)), z(c.where(new_c)), side(~new_o), side(new_o), ["k"])
    return out.groupBy("n").agg(F.sum("mult").alias("mult"))


_CIN = "SELECT '<urn:tpch:customer/' || c_custkey || '>' AS s, '<urn:tpch:nation/' || c_nationkey || '>' AS o, 'asserted' AS kind FROM customer WHERE {c}"
_NIN = "SELECT '<urn:tpch:nation/' || n_nationkey || '>' AS s, '<urn:tpch:region/' || n_regionkey || '>' AS o, 'asserted' AS kind FROM nation WHERE {n}"
_CRIN = "SELECT '<urn:tpch:customer/' || c_custkey || '>' AS s, '<urn:tpch:region/' || n_regionkey || '>' AS o, 'inferred' AS kind FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE {n}"


def _placed(c: str = "true", n: str = "true") -> str:
    return f"({_CIN.format(c=c)} UNION ALL {_NIN.format(n=n)} UNION ALL {_CRIN.format(n=n)})"


def _early() -> Column:
    return F.regexp_extract("s", "nation/([0-9]+)", 1).try_cast("int") < 5


@register(f"SELECT s, o, kind, 1::BIGINT AS mult FROM {_placed()}")
def tick_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    circuit = incremental.Circuit(spark, _tests(spark))
    for part in located(spark, sf_dir):
        circuit.assert_(part)
    return circuit.tick().select("s", "o", "kind", "mult")


@register(f"SELECT s, o, kind, -1::BIGINT AS mult FROM {_placed('false', 'n_nationkey < 5')}")
def tick_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    circuit = incremental.Circuit(spark, _tests(spark))
    parts = located(spark, sf_dir)
    for part in parts:
        circuit.assert_(part)
    circuit.tick()
    circuit.retract(parts[1].where(_early()))
    return circuit.tick().select("s", "o", "kind", "mult")


@register(f"SELECT 1 AS version, s, o FROM {_placed()} UNION ALL SELECT 2, s, o FROM {_placed(n='n_nationkey >= 5')}")
def snapshot_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    circuit = incremental.Circuit(spark, _tests(spark))
    parts = located(spark, sf_dir)
    for part in parts:
        circuit.assert_(part)
    circuit.tick()
    circuit.retract(parts[1].where(_early()))
    circuit.tick()
    found = [circuit.snapshot(v).select(F.lit(v).alias("version"), "s", "o") for v in (1, 2)]
    return found[0].unionByName(found[1])


@register("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling(table(spark, sf_dir, "events"), "1 hour").withColumn("total", F.round("total", 4))


from . import queries_files, queries_upkeep  # noqa: E402, F401  they register what builds on the above


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: partial(_sparql, name) for name in SPARQL}
    out |= {f"rule_{name.replace('-', '_')}": partial(_rule_query, name) for name in RULES}
    return out | rulebook.queries() | {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: sql for name, (_, sql) in SPARQL.items() if sql}
    out |= {f"rule_{name.replace('-', '_')}": sql for name, (_, sql) in RULES.items()}
    return out | rulebook.oracle_sql() | {name: sql for name, (_, sql) in FOUND.items() if sql}
