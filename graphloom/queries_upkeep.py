"""Registered queries of kept closures, ticks, proofs, datatypes, mappings and plans over ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import incremental
from .engine import Engine
from .ids import IdGraph
from .operators import closure
from .operators.joins import lookup_join
from .queries import _CIN, _CRIN, _EXACT, IN, OF, _early, _placed, _tests, located, mapped, order_quads, turns
from .reason import datatypes
from .reason.engine import extents, fixpoint, folded, materialise, rematerialised
from .reason.mappings import infer, justification, nodes
from .reason.rules import parse_rules
from .registry import INTEGER, iri, register, rows, table, triples
from .store import characteristic_sets, scan
from .streaming.ticks import ticking
from .terms import OWL, RDF_TYPE, RDFS, XSD
from .workload import BASE

SAME, NOTHING, THING = f"<{OWL}sameAs>", f"<{OWL}Nothing>", f"<{OWL}Thing>"
_TURN = "WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn FROM conversations), e AS (SELECT a.conv_id, a.turn AS x FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1{w}), r AS (SELECT conv_id, x, x + 1 AS y, 1 AS hops FROM e UNION ALL SELECT r.conv_id, r.x, e.x + 1, r.hops + 1 FROM r JOIN e ON r.conv_id = e.conv_id AND e.x = r.y)"


# kept closures


@register(f"{_TURN.format(w='')} SELECT conv_id || '-' || x AS src, conv_id || '-' || y AS dst, min(hops)::BIGINT AS hops FROM r GROUP BY conv_id, x, y")
def closure_semiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A semiring of the caller's: hops add along a path and the least counts."""
    edges = turns(spark, sf_dir).select("src", "dst", F.lit(1).cast("long").alias("value"))
    return closure.valued(edges, lambda a, b: a + b, F.min, lambda a, b: a < b).withColumnRenamed("value", "hops")


@register(f"{_TURN.format(w='')} SELECT conv_id || '-' || x AS src, conv_id || '-' || y AS dst, (0.5 ** hops)::DOUBLE AS confidence FROM r WHERE x = 0")
def closure_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best confidences from the first turns: only what they reach is computed."""
    edges = turns(spark, sf_dir).select("src", "dst", F.lit(0.5).alias("confidence"))
    starts = edges.where(F.substring_index("src", "-", -1) == "0").select("src").distinct()
    return closure.best_confidence(edges, sources=starts)


@register("WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations), e AS (SELECT a.conv_id, a.turn FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), c AS (SELECT conv_id, count(*) AS n FROM e GROUP BY conv_id) SELECT sum(n * (n + 1) // 2)::BIGINT AS pairs, sum(n + 1)::BIGINT AS nodes FROM c")
def closure_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs after the last round and nodes, as the closure's own counters have them; conversations are chains."""
    m = closure.Metrics()
    closure.transitive(turns(spark, sf_dir), metrics=m)
    good = m.sizes == sorted(m.sizes) and m.seconds > 0 and 0 < m.density < 1
    return spark.createDataFrame([(m.sizes[-1] if good else -1, m.nodes)], "pairs long, nodes long")


def _kept(how: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = closure.Kept.of_base(turns(spark, sf_dir))
    withdrawn, survived = kept.delete(turns(spark, sf_dir).where(F.substring_index("src", "-", -1) == "1"), how)
    return withdrawn.select("src", "dst", F.lit("withdrawn").alias("what")).unionByName(kept.closed.select("src", "dst", F.lit("left").alias("what"))).unionByName(survived.select("src", "dst", F.lit("survived").alias("what")))


_WITHDRAWN = f"{_TURN.format(w='')} SELECT conv_id || '-' || x AS src, conv_id || '-' || y AS dst, CASE WHEN x <= 1 AND y >= 2 THEN 'withdrawn' ELSE 'left' END AS what FROM r"


@register(_WITHDRAWN)
def closure_delete_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is withdrawn with the second steps of all conversations, by looking for other support."""
    return _kept("support", spark, sf_dir)


@register(_WITHDRAWN)
def closure_delete_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by closing what is left again, from the sources concerned."""
    return _kept("recompute", spark, sf_dir)


@register(f"{_TURN.format(w='')} SELECT conv_id || '-' || x AS src, conv_id || '-' || y AS dst FROM r WHERE NOT (x = 1 AND y = 2)")
def closure_seed_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded with closed pairs, each counts as an edge: only the pair itself goes with a step."""
    kept = closure.Kept.of_closed(closure.transitive(turns(spark, sf_dir)))
    kept.delete(turns(spark, sf_dir).where(F.substring_index("src", "-", -1) == "1"))
    return kept.closed.select("src", "dst")


@register(f"{_TURN.format(w='')} SELECT conv_id || '-' || x AS src, conv_id || '-' || y AS dst FROM r")
def closure_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change whose sink fails leaves the closure as it was."""
    kept = closure.Kept.of_base(turns(spark, sf_dir))

    def refuse(df: DataFrame) -> None:
        raise OSError("the sink is full")

    for change in (lambda: kept.delete(kept.base, sink=refuse), lambda: kept.insert(kept.base.select(F.col("dst").alias("src"), F.col("src").alias("dst")), sink=refuse)):
        try:
            change()
        except OSError:
            continue
        return kept.closed.limit(0)
    return kept.closed.select("src", "dst")


# ticks


def _linear(facts: DataFrame) -> DataFrame:
    return facts.where("p = '<urn:x:in>'").select("o", F.lit("<urn:x:holds>").alias("p"), "s", "mult").toDF("s", "p", "o", "mult")


@register("SELECT '<urn:tpch:nation/' || c_nationkey || '>' AS s, '<urn:x:holds>' AS p, '<urn:tpch:customer/' || c_custkey || '>' AS o, 1::BIGINT AS mult FROM customer")
def zset_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule of one pattern over a change: what went in twice and out once counts once."""
    part = located(spark, sf_dir)[0]
    one = incremental.zset(part)
    change = incremental.minus(incremental.plus(one, one), one)
    return incremental.linear(change, _linear)


@register("SELECT '<urn:tpch:customer/' || c_custkey || '>' AS s, '<urn:tpch:region/' || n_regionkey || '>' AS o, -1::BIGINT AS mult FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 5")
def zset_nary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change of a rule's head when nations leave: old facts before the place of the change and new ones behind it."""
    people, nations = located(spark, sf_dir)
    gone = incremental.zset(nations.where(_early())).withColumn("mult", -F.col("mult"))
    return incremental.rule_delta(_tests(spark)[0], incremental.zset(people.unionByName(nations)), gone).select("s", "o", "mult")


@register("SELECT '<urn:tpch:nation/' || n_nationkey || '>' AS s, '<urn:tpch:region/' || n_regionkey || '>' AS o FROM nation WHERE n_nationkey >= 5")
def zset_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact that was taken away more often than put in is absent, and comes back only when it is made up for."""
    nations = located(spark, sf_dir)[1]
    circuit = incremental.Circuit(spark, [])
    circuit.retract(nations.where(_early()))
    circuit.tick()
    circuit.assert_(nations)
    circuit.tick()
    return circuit.facts.select("s", "o")


@register(f"SELECT s, o, CASE kind WHEN 'inferred' THEN 1 ELSE 0 END::BIGINT AS weight FROM {_placed()} WHERE kind = 'inferred'")
def tick_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the rule gives each inferred fact; the circuit has checked itself against recomputation before."""
    circuit = incremental.Circuit(spark, _tests(spark))
    for part in located(spark, sf_dir):
        circuit.assert_(part)
        circuit.tick()
    circuit.validate()
    return circuit.weights().select("s", "o", "weight")


@register(f"SELECT s, o, kind FROM {_placed(n='n_nationkey >= 5')}")
def tick_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A driver restarts between batches, and the last one is delivered again: nothing is lost or counted twice."""
    from .registry import workplace

    people, nations = located(spark, sf_dir)
    signed = lambda df, op: df.select(F.lit(op).alias("op"), "s", "p", "o")
    batches = [signed(people, 1), signed(nations, 1), signed(nations.where(_early()), -1)]
    journal = incremental.Journal(spark, workplace(spark), every=2)
    run = ticking(incremental.Circuit(spark, _tests(spark)), None, journal)
    for number in (0, 1):
        run(batches[number], number)
    journal.append(2, batches[2].select("s", "p", "o", F.col("op").cast("long").alias("mult")))  # written, and then the driver is lost
    circuit, last = journal.resume(_tests(spark))
    run = ticking(circuit, None, journal, last)
    run(batches[2], 2)
    return circuit.facts.select("s", "o", F.when(F.col("rule").isNull(), "asserted").otherwise("inferred").alias("kind"))


@register(f"SELECT 'withdrawn' AS what, s, o FROM {_placed('false', 'n_nationkey < 5')} UNION ALL SELECT 'promoted', '<urn:tpch:customer/' || c_custkey || '>', '<urn:tpch:region/' || n_regionkey || '>' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey >= 5")
def tick_closure_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retraction from a closed predicate. Customers' regions were asserted too: those that nations still give are promoted."""
    people, nations = located(spark, sf_dir)
    direct = people.join(nations.select(F.col("s").alias("o"), F.col("o").alias("far")), "o").select("s", "p", F.col("far").alias("o"))
    plan = incremental.ClosurePlan.over(people.unionByName(nations).unionByName(direct), "<urn:x:in>")
    withdrawn, promoted = plan.retract(direct.unionByName(nations.where(_early())))
    return withdrawn.select(F.lit("withdrawn").alias("what"), "s", "o").unionByName(promoted.select(F.lit("promoted").alias("what"), "s", "o"))


# reasoning


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples(table(spark, sf_dir, "customer"), iri("customer", "c_custkey"), IN, iri("nation", "c_nationkey"))


_C, _N = "'<urn:tpch:customer/' || c_custkey || '>'", "'<urn:tpch:nation/' || c_nationkey || '>'"


@register(f"SELECT {_C} AS s, '{SAME}' AS p, {_C} AS o FROM customer UNION ALL SELECT '<urn:x:c' || c_custkey || '>', '{SAME}', '<urn:x:c' || c_custkey || '>' FROM customer UNION ALL SELECT '<urn:x:c' || c_custkey || '>', '{SAME}', {_C} FROM customer")
def owl_same_reflexive_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``eq-ref`` and ``eq-sym``: of a customer and its alias, each is the same as itself, and the alias as the customer."""
    c = table(spark, sf_dir, "customer")
    alias = F.concat(F.lit("<urn:x:c"), F.col("c_custkey").cast("string"), F.lit(">"))
    return fixpoint(triples(c, iri("customer", "c_custkey"), SAME, alias), []).inferred.select("s", "p", "o")


@register(f"SELECT {_C} AS s, '<urn:x:p>' AS p, {_N} AS o FROM customer" + f" UNION ALL SELECT {_C}, '<urn:x:q>', {_N} FROM customer")
def owl_predicate_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``eq-rep-p`` by classes of predicates: one union of extents for a class of three."""
    same = rows(spark, (IN, SAME, "<urn:x:p>"), ("<urn:x:p>", SAME, "<urn:x:q>"))
    return extents(_facts(spark, sf_dir).unionByName(same)).where(F.col("p") != SAME)


@register("SELECT DISTINCT '<urn:x:r' || n_regionkey || '>' AS s, '<urn:tpch:nation/' || n_nationkey || '>' AS o FROM nation UNION SELECT '<urn:tpch:region/' || n_regionkey || '>', '<urn:tpch:nation/' || n_nationkey || '>' FROM nation")
def owl_functional_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prp-fp`` with classes: regions and their aliases become one, and what they hold is expanded on demand."""
    n = table(spark, sf_dir, "nation")
    alias = F.concat(F.lit("<urn:x:r"), F.col("n_regionkey").cast("string"), F.lit(">"))
    facts = triples(n, iri("nation", "n_nationkey"), OF, iri("region", "n_regionkey")).unionByName(triples(n, iri("nation", "n_nationkey"), OF, alias))
    holds = triples(n, alias, "<urn:x:holds>", iri("nation", "n_nationkey"))
    out = folded(facts.unionByName(holds).unionByName(rows(spark, (OF, RDF_TYPE, f"<{OWL}FunctionalProperty>"))))
    return out.expanded().where("p = '<urn:x:holds>'").select("s", "o")


@register(f"SELECT {_C} AS s FROM customer")
def owl_named_individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named individual is a thing."""
    facts = triples(table(spark, sf_dir, "customer"), iri("customer", "c_custkey"), RDF_TYPE, F.lit(f"<{OWL}NamedIndividual>"))
    return materialise(facts, [], lists=False, literals=False).triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == THING)).select("s")


def _sized(spark: SparkSession, sf_dir: str, kind: str, lexical: str) -> DataFrame:
    literal = F.concat(F.lit('"'), F.expr(lexical).cast("string"), F.lit(f'"^^<{XSD}{kind}>'))
    return triples(table(spark, sf_dir, "part"), iri("part", "p_partkey"), "<urn:x:size>", literal)


@register("SELECT unnest(['integer', 'nonPositiveInteger', 'negativeInteger', 'long', 'int', 'short', 'byte', 'nonNegativeInteger', 'unsignedLong', 'unsignedInt', 'unsignedShort', 'unsignedByte', 'positiveInteger', 'decimal', 'string', 'boolean', 'dateTime']) AS kind")
def owl_datatype_axioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dt-type1``: the datatypes are declared."""
    found = datatypes.axioms(spark).where((F.col("p") == RDF_TYPE) & F.col("s").startswith(f"<{XSD}"))
    return found.select(F.regexp_extract("s", "#([A-Za-z]+)>", 1).alias("kind"))


_LEX = "CASE WHEN p_partkey % 2 = 0 THEN '0' || p_size ELSE p_size::VARCHAR END"


@register(f"WITH l AS (SELECT DISTINCT '\"' || {_LEX} || '\"^^<{INTEGER}>' AS t, p_size AS v FROM part), m AS (SELECT t, min(t) OVER (PARTITION BY v) AS m FROM l) SELECT m AS s, t AS o FROM m WHERE t <> m")
def owl_literal_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dt-eq``: literals of one value hang on the least."""
    facts = _sized(spark, sf_dir, "integer", "case when p_partkey % 2 = 0 then concat('0', p_size) else cast(p_size as string) end")
    return datatypes.literal_facts(facts)[0].select("s", "o")


@register(f"WITH l AS (SELECT '<urn:x:all>' AS x, '\"' || p_size || '\"^^<{INTEGER}>' AS t FROM part) SELECT DISTINCT (SELECT min(t) FROM l) AS s, t AS o FROM l WHERE t <> (SELECT min(t) FROM l)")
def owl_literal_different(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dt-diff``: different values that a functional property would make the same."""
    facts = _sized(spark, sf_dir, "integer", "p_size").withColumn("s", F.lit("<urn:x:all>"))
    found = datatypes.literal_differences(facts.unionByName(rows(spark, ("<urn:x:size>", RDF_TYPE, f"<{OWL}FunctionalProperty>"))))
    return found.where("rule = 'dt-diff'").select("s", "o")


@register(f"SELECT DISTINCT '\"' || (p_size * 20) || '\"^^<{XSD}unsignedByte>' AS s FROM part WHERE p_size * 20 > 255")
def owl_literal_ill_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dt-not-type``: literals that their datatype can't hold."""
    return datatypes.literal_facts(_sized(spark, sf_dir, "unsignedByte", "p_size * 20"))[1].select("s")


@register(f"SELECT DISTINCT '\"' || p_size || '\"^^<{INTEGER}>' AS s FROM part WHERE p_size > 25")
def owl_range_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dt-type2`` through ranges: values that a range puts into a datatype that can't hold them."""
    facts = _sized(spark, sf_dir, "integer", "p_size").where(F.regexp_extract("o", '"([0-9]+)"', 1).cast("int") > 25).withColumn("p", F.lit("<urn:x:neg>"))
    return datatypes.membership_faults(facts.unionByName(rows(spark, ("<urn:x:neg>", f"<{RDFS}range>", f"<{XSD}negativeInteger>")))).select("s")


@register("SELECT unnest(['integer', 'short', 'int', 'long']) AS kind")
def owl_range_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges ``byte`` and ``nonNegativeInteger`` together imply all signed types that hold 0 to 127, and the unsigned ones below."""
    found = datatypes.narrowed_ranges({"<urn:x:p>": ["byte", "nonNegativeInteger"]})
    signed = [o for _, o in found if "unsigned" not in o]
    return spark.createDataFrame([(o.rsplit("#", 1)[1][:-1],) for o in signed], "kind string")


@register(f"SELECT {_C} AS s, true AS entailed, false AS absent FROM customer WHERE c_custkey = 1")
def owl_entailment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether conclusions follow: all of their triples are there, with a blank node for anything."""
    out = _within(spark, sf_dir)
    good = out.entails([(f"<{BASE}customer/1>", "<urn:x:within>", "_:any"), ("_:b", "<urn:x:within>", f"<{BASE}nation/3>")])
    bad = out.entails([(f"<{BASE}customer/1>", "<urn:x:within>", "<urn:x:nowhere>")])
    return spark.createDataFrame([(f"<{BASE}customer/1>", good, bad)], "s string, entailed boolean, absent boolean")


def _within(spark: SparkSession, sf_dir: str) -> object:
    up = triples(table(spark, sf_dir, "nation"), iri("nation", "n_nationkey"), OF, iri("region", "n_regionkey"))
    rules = parse_rules(f"up: ?x {IN} ?y => ?x <urn:x:within> ?y\nfar: ?x <urn:x:within> ?y . ?y {OF} ?z => ?x <urn:x:within> ?z")
    return fixpoint(_facts(spark, sf_dir).unionByName(up), rules)


@register("SELECT depth, rule, s, o FROM (SELECT 0 AS depth, 'far' AS rule, '<urn:tpch:customer/1>' AS s, '<urn:tpch:region/' || n_regionkey || '>' AS o FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1 UNION ALL SELECT 1, 'up', '<urn:tpch:customer/1>', '<urn:tpch:nation/' || c_nationkey || '>' FROM customer WHERE c_custkey = 1 UNION ALL SELECT 1, 'asserted', '<urn:tpch:nation/' || n_nationkey || '>', '<urn:tpch:region/' || n_regionkey || '>' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1 UNION ALL SELECT 2, 'asserted', '<urn:tpch:customer/1>', '<urn:tpch:nation/' || c_nationkey || '>' FROM customer WHERE c_custkey = 1)")
def owl_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of one derivation, by depth."""
    out = _within(spark, sf_dir)
    region = out.triples.where((F.col("s") == f"<{BASE}customer/1>") & (F.col("p") == "<urn:x:within>") & F.col("o").contains("region")).first()
    found: list[tuple] = []

    def walk(node: dict, depth: int) -> None:
        found.append((depth, node.get("rule", "asserted"), node["fact"][0], node["fact"][2]))
        for below in node.get("premises", []):
            walk(below, depth + 1)

    walk(out.proof(tuple(region)), 0)
    return spark.createDataFrame(found, "depth int, rule string, s string, o string")


@register(f"{_CIN.format(c='true').replace(', ' + chr(39) + 'asserted' + chr(39) + ' AS kind', '')} UNION ALL {_CRIN.format(n='true').replace(', ' + chr(39) + 'inferred' + chr(39) + ' AS kind', '')}")
def owl_rematerialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that was inferred is dropped and inferred again; a fact that was put among the inferred ones by hand goes."""
    out = _within(spark, sf_dir)
    rules = parse_rules(f"up: ?x {IN} ?y => ?x <urn:x:within> ?y\nfar: ?x <urn:x:within> ?y . ?y {OF} ?z => ?x <urn:x:within> ?z")
    wrong = out.facts.where("rule is not null").limit(1).withColumn("o", F.lit("<urn:x:wrong>"))
    out.facts = out.facts.unionByName(wrong)
    return rematerialised(out, rules).triples.where("p = '<urn:x:within>'").select("s", "o")


# mappings


@register("SELECT s, o, why FROM (SELECT unnest([{'s': '<urn:tpch:nation/' || n_nationkey || '>', 'o': '<urn:tpch:region/' || n_regionkey || '>', 'why': 'MappingChaining'}, {'s': '<urn:tpch:region/' || n_regionkey || '>', 'o': '<urn:tpch:nation/' || n_nationkey || '>', 'why': 'MappingInversion'}, {'s': '<urn:tpch:region/' || n_regionkey || '>', 'o': '<urn:x:' || n_name || '>', 'why': 'MappingInversion'}], recursive := true) FROM nation)")
def sssom_justification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each inferred mapping came about."""
    out = infer(mapped(spark, sf_dir)).inferred
    return out.select("s", "o", F.regexp_extract(justification(F.col("rule")), "([A-Za-z]+)>$", 1).alias("why"))


@register("SELECT '<urn:tpch:nation/' || n_nationkey || '>' AS source, '<urn:tpch:region/' || n_regionkey || '>' AS target FROM nation UNION ALL SELECT '<urn:tpch:region/' || n_regionkey || '>', '<urn:tpch:nation/' || n_nationkey || '>' FROM nation UNION ALL SELECT '<urn:tpch:region/' || n_regionkey || '>', '<urn:x:' || n_name || '>' FROM nation")
def sssom_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and target of the node of each inferred mapping."""
    cells = nodes(infer(mapped(spark, sf_dir)).facts)
    part = lambda name: cells.where(F.col("p") == f"<{OWL}{name}>").select("s", F.col("o").alias(name))
    both = part("annotatedSource").join(part("annotatedTarget"), "s")
    return both.select(F.col("annotatedSource").alias("source"), F.col("annotatedTarget").alias("target"))


@register("SELECT '<urn:x:a>' AS s, '<urn:x:b>' AS o WHERE false")
def sssom_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches never become ``owl:sameAs``, nor do rules of identity run over mappings."""
    out = infer(mapped(spark, sf_dir).unionByName(rows(spark, ("<urn:x:a>", SAME, "<urn:x:b>"), ("<urn:x:a>", _EXACT, "<urn:x:c>"))))
    return out.inferred.where((F.col("p") == SAME) | (F.col("s") == "<urn:x:b>") | (F.col("o") == "<urn:x:b>")).select("s", "o")


# plans over ids, scans and statistics


@register("SELECT '<urn:tpch:orders/' || o_orderkey || '>' AS s, '<urn:tpch:customer/' || o_custkey || '>' AS c, '\"' || o_orderpriority || '\"' AS r FROM orders WHERE o_orderstatus = 'F'")
def bgp_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns joined on dictionary ids, terms decoded at the end."""
    quads = order_quads(spark, sf_dir).where(F.col("g").isNull() | (F.col("g") == f"<{BASE}status/F>"))
    return Engine(spark, IdGraph(quads), prefixes={"": BASE}).select("SELECT ?s ?c ?r WHERE { ?s :o_custkey ?c ; :o_orderpriority ?r }")


@register("SELECT '<urn:tpch:orders/' || o_orderkey || '>' AS s, '<urn:tpch:status/' || o_orderstatus || '>' AS g FROM orders WHERE o_orderpriority = '1-URGENT'")
def bgp_ids_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a constant and a graph variable."""
    return Engine(spark, IdGraph(order_quads(spark, sf_dir)), prefixes={"": BASE}).select("SELECT ?s ?g WHERE { GRAPH ?g { ?s :o_orderpriority '1-URGENT' } }")


@register("SELECT c_name AS name, o_orderkey AS k FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal = (SELECT max(c_acctbal) FROM customer)")
def join_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few rows on the left: their keys are looked up in the right's scan."""
    c = table(spark, sf_dir, "customer")
    top = c.join(c.agg(F.max("c_acctbal").alias("c_acctbal")), "c_acctbal").select("c_name", F.col("c_custkey").alias("o_custkey"))
    return lookup_join(top, table(spark, sf_dir, "orders"), "o_custkey").select(F.col("c_name").alias("name"), F.col("o_orderkey").alias("k"))


@register("SELECT '<urn:tpch:' || p || '>' AS p, n FROM (SELECT 'o_custkey' AS p, count(*) AS n FROM orders UNION ALL SELECT 'o_orderpriority', count(*) FROM orders)")
def grouped_count_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples by predicate, from the source's own counts."""
    return Engine(spark, order_quads(spark, sf_dir), prefixes={"": BASE}).select("SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?p")


@register("SELECT row_number() OVER (ORDER BY '\"' || o_orderpriority || '\"', '<urn:tpch:orders/' || o_orderkey || '>') - 1 AS place, '<urn:tpch:orders/' || o_orderkey || '>' AS s FROM orders WHERE o_orderstatus = 'P'")
def ordered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph's quads by object, then subject, then predicate."""
    return scan(order_quads(spark, sf_dir), g=f"<{BASE}status/P>", order="osp", places=True).select("place", "s")


@register("SELECT '<urn:tpch:orders/' || o_orderkey || '>' AS s FROM orders WHERE o_orderpriority = '2-HIGH'")
def object_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads by their object."""
    return scan(order_quads(spark, sf_dir), o='"2-HIGH"').select("s")


@register("SELECT CASE WHEN n = 1 THEN ['<urn:tpch:c_name>', '<urn:tpch:c_nationkey>'] END AS predicates, subjects::BIGINT AS subjects, triples::BIGINT AS triples FROM (SELECT 1 AS n, count(*) AS subjects, 2 * count(*) AS triples FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 2, count(*), count(*) FROM customer WHERE c_mktsegment = 'BUILDING')")
def store_characteristic_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent set, and one row for all others."""
    c = table(spark, sf_dir, "customer")
    named = triples(c.where("c_mktsegment <> 'BUILDING'"), iri("customer", "c_custkey"), f"<{BASE}c_name>", F.concat(F.lit('"'), "c_name", F.lit('"')))
    return characteristic_sets(_facts(spark, sf_dir).unionByName(named), 1)


@register("SELECT '<urn:tpch:status/F>' AS g, count(*) > 0 AS found FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT '<urn:x:none>', false")
def graph_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``GRAPH <g> {}`` is one row if the graph has a quad."""
    ask = Engine(spark, order_quads(spark, sf_dir), prefixes={"": BASE})
    names = ["<urn:tpch:status/F>", "<urn:x:none>"]
    return reduce(DataFrame.unionByName, [ask.ask_row(f"ASK {{ GRAPH {g} {{}} }}").select(F.lit(g).alias("g"), F.col("answer").alias("found")) for g in names])


_REFUSED = (
    "SELECT ?g WHERE { GRAPH ?g { SELECT ?s WHERE { ?s ?p ?o } } }", "SELECT ?g WHERE { GRAPH ?g { ?s <urn:p>+ ?o } }", "SELECT ?g WHERE { GRAPH ?g { ?s ?p ?o FILTER(?g = ?s) } }",
    "SELECT ?g WHERE { GRAPH ?g { ?s ?p ?o BIND(?g AS ?h) } }", "SELECT ?g WHERE { GRAPH ?g { VALUES ?x { 1 } } }", "SELECT ?g WHERE { GRAPH ?g { GRAPH <urn:g> { ?s ?p ?o } } }",
)


@register(f"SELECT unnest(range({len(_REFUSED) + 1})) AS n, true AS refused")
def refused_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms inside GRAPH with a variable, and writes to reserved graphs, are refused before anything runs."""
    from .algebra import Refused
    from .store import Store
    from .update import Updater

    quads = order_quads(spark, sf_dir)
    found = []
    for n, text in enumerate(_REFUSED):
        try:
            Engine(spark, quads).query(text)
            found.append((n, False))
        except Refused:
            found.append((n, True))
    try:
        Updater(spark, Store.of(quads)).run("INSERT DATA { GRAPH <urn:graphloom:x> { <urn:a> <urn:b> 1 } }")
        found.append((len(_REFUSED), False))
    except Refused:
        found.append((len(_REFUSED), True))
    return spark.createDataFrame(found, "n long, refused boolean")


