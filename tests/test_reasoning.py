"""Rules, lists, datatypes, closures and incremental upkeep."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom import incremental as I
from graphloom.operators import closure
from graphloom.parser.rdf import parse
from graphloom.reason import datatypes
from graphloom.reason.engine import SAME, fixpoint, folded, materialise
from graphloom.reason.mappings import infer, nodes
from graphloom.reason.rules import COMPILED, mapping_rules, owl_rules, parse_rules
from graphloom.terms import OWL, RDF_TYPE

PREFIX = "@prefix : <u:> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . "


def closed(spark, text):
    rows = [(s, p, o) for _, s, p, o in parse(PREFIX + text)]
    return materialise(spark.createDataFrame(rows, "s string, p string, o string"))


def goal(text):
    return [(s, p, o) for _, s, p, o in parse(PREFIX + text)]


def test_rule_table():
    assert len(owl_rules()) == 43 and len(mapping_rules()) == 13
    assert len({r.name for r in parse_rules(COMPILED)}) == 56


def test_lists_restrictions_and_proofs(spark):
    m = closed(
        spark,
        """:A rdfs:subClassOf :B . :x a :A . :y a :B , :C . :D owl:unionOf ( :A :C ) . :E owl:intersectionOf ( :B :C ) .
        :g owl:propertyChainAxiom ( :p :q ) . :x :p :y . :y :q :z . :K owl:hasKey ( :k ) . :m a :K ; :k 1 . :n a :K ; :k 1 .
        :R owl:maxCardinality 1 ; owl:onProperty :one . :r a :R ; :one :s , :t . [] a owl:AllDifferent ; owl:members ( :u :v :w ) .""",
    )
    assert m.entails(goal(":x a :B , :D . :y a :D , :E . :x :g :z . :m owl:sameAs :n . :n owl:sameAs :m . :s owl:sameAs :t . :u owl:differentFrom :w . :x :p _:any ."))
    assert not m.entails(goal(":x a :C ."))
    assert m.consistent()
    tree = m.proof(("<u:x>", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", "<u:B>"))
    assert tree["rule"] == "cax-sco" and [p.get("asserted") for p in tree["premises"]] == [True, True]


def test_inconsistencies(spark):
    m = closed(
        spark,
        """[] a owl:AllDisjointClasses ; owl:members ( :A :B ) . :x a :A , :B . [] a owl:AllDisjointProperties ; owl:members ( :p :q ) . :y :p :z ; :q :z .
        :R owl:maxQualifiedCardinality 0 ; owl:onProperty :o ; owl:onClass :A . :v a :R ; :o :x . :w :age "abc"^^xsd:integer . :n rdfs:range xsd:byte . :t :n "300"^^xsd:integer .""",
    )
    assert {r[0] for r in m.faults().collect()} == {"<u:x>", "<u:y>", "<u:v>", '"abc"^^<http://www.w3.org/2001/XMLSchema#integer>', '"300"^^<http://www.w3.org/2001/XMLSchema#integer>'}


def test_datatypes(spark):
    assert datatypes.narrowed_ranges({"<u:p>": ["nonNegativeInteger", "nonPositiveInteger"]})
    found = {o for _, o in datatypes.narrowed_ranges({"<u:p>": ["unsignedByte", "byte"]})}
    assert "<http://www.w3.org/2001/XMLSchema#unsignedInt>" in found and "<http://www.w3.org/2001/XMLSchema#positiveInteger>" not in found


def test_mappings_and_nodes(spark):
    skos = "@prefix skos: <http://www.w3.org/2004/02/skos/core#> . @prefix : <u:> . "
    rows = [(s, p, o) for _, s, p, o in parse(skos + ":a skos:exactMatch :b . :b skos:broadMatch :c . :c skos:broadMatch :d .")]
    m = infer(spark.createDataFrame(rows, "s string, p string, o string"))
    assert m.entails([(s, p, o) for _, s, p, o in parse(skos + ":a skos:broadMatch :c , :d . :d skos:narrowMatch :a .")])
    assert nodes(m.facts).where("p like '%derived_from>'").count() > 0


def reach(edges):
    out = set(edges)
    while True:
        more = {(a, d) for a, b in out for c, d in edges if b == c} - out
        if not more:
            return out
        out |= more


def test_closures_against_brute_force(spark):
    r = random.Random(4)
    for n in (6, 12):
        edges = {(r.randrange(n), r.randrange(n)) for _ in range(n)}
        df = spark.createDataFrame(sorted(edges), "src long, dst long")
        truth = reach(edges)
        whole = closure.checkpointed(closure.transitive(df))
        assert {tuple(x) for x in whole.collect()} == truth
        gone = set(r.sample(sorted(edges), 2))
        left, withdrawn = closure.delete_edges(df, whole, spark.createDataFrame(sorted(gone), "src long, dst long"))
        assert {tuple(x) for x in left.collect()} == reach(edges - gone)
        assert {tuple(x) for x in withdrawn.collect()} == truth - reach(edges - gone)
        added = {(r.randrange(n), r.randrange(n)) for _ in range(3)}
        more, new = closure.insert_edges(df, whole, spark.createDataFrame(sorted(added), "src long, dst long"))
        assert {tuple(x) for x in more.collect()} == reach(edges | added)
        parts = {x["node"]: x["canon"] for x in closure.components(df).collect()}
        both = reach(edges | {(b, a) for a, b in edges})
        assert parts == {a: min([a, *(b for x, b in both if x == a)]) for e in edges for a in e}


def test_best_confidence(spark):
    df = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9), ("a", "c", 0.5), ("c", "a", 0.5), ("a", "b", 0.2)], "src string, dst string, confidence double")
    best = {(x[0], x[1]): round(x[2], 6) for x in closure.best_confidence(df).collect()}
    assert best[("a", "c")] == 0.81 and best[("a", "a")] == 0.405 and best[("a", "b")] == 0.9
    assert closure.crosswalk(df, "b", "a") == 0.45 and closure.crosswalk(df, "b", "x") is None


def test_circuit_equals_recomputation(spark):
    rules = parse_rules("t: ?x <u:p> ?y . ?y <u:p> ?z => ?x <u:p> ?z\ns: ?x <u:p> ?y => ?x <u:q> ?y")
    r = random.Random(2)
    circuit, there = I.Circuit(spark, rules), []
    for _ in range(3):
        new = [(f"<n{r.randrange(4)}>", "<u:p>", f"<n{r.randrange(4)}>") for _ in range(3)]
        gone = r.sample(there, min(2, len(there)))
        there += new
        circuit.assert_(spark.createDataFrame(new, "s string, p string, o string"))
        if gone:
            circuit.retract(spark.createDataFrame(gone, "s string, p string, o string"))
        circuit.tick()
        circuit.validate()
    assert circuit.weights().count() > 0


def test_rule_deltas(spark):
    rule = parse_rules("t: ?x <u:p> ?y . ?y <u:p> ?z => ?x <u:r> ?z")[0]
    z = lambda *e: spark.createDataFrame([(f"<{a}>", "<u:p>", f"<{b}>", n) for a, b, n in e], "s string, p string, o string, mult long")
    old, change = z(("a", "b", 1), ("b", "c", 2)), z(("b", "c", -1), ("c", "d", 1))
    whole = I.minus(I.rule_full(rule, I.plus(old, change)), I.rule_full(rule, old))
    assert sorted(map(tuple, I.rule_delta(rule, old, change).collect())) == sorted(map(tuple, whole.collect())) != []


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-2, 2)), min_size=1), st.lists(st.tuples(st.integers(0, 3), st.integers(-2, 2)), min_size=1))
def test_zset_laws(spark, a, b):
    x, y = (spark.createDataFrame(v, "k long, mult long") for v in (a, b))
    total = lambda v: {k: n for k in {k for k, _ in v} if (n := sum(m for j, m in v if j == k))}
    assert dict(map(tuple, I.plus(x, y).collect())) == total(a + b)
    assert dict(map(tuple, I.minus(x, y).collect())) == total(a + [(k, -m) for k, m in b])


def test_streamed_ticks(spark, tmp_path):
    from graphloom.streaming.ticks import start, ticking

    rows = [(1, "<a>", "<u:p>", "<b>"), (1, "<b>", "<u:p>", "<c>")]
    spark.createDataFrame(rows, "op long, s string, p string, o string").write.json(f"{tmp_path}/in")
    circuit = I.Circuit(spark, parse_rules("t: ?x <u:p> ?y . ?y <u:p> ?z => ?x <u:p> ?z"))
    stream = spark.readStream.schema("op long, s string, p string, o string").json(f"{tmp_path}/in")
    start(stream, ticking(circuit), f"{tmp_path}/ck").awaitTermination()
    assert circuit.facts.count() == 3


def test_closure_strategies_agree(spark):
    """Support counting and recomputation, seeds and failing sinks, over random cyclic graphs."""
    r = random.Random(9)
    frame = lambda e: spark.createDataFrame(sorted(e), "src long, dst long")
    read = lambda df: {tuple(x) for x in df.select("src", "dst").collect()}
    for _ in range(2):
        edges = {(r.randrange(7), r.randrange(7)) for _ in range(12)}
        gone = set(r.sample(sorted(edges), 3))
        truth, left = reach(edges), reach(edges - gone)
        for how in ("support", "recompute"):
            kept = closure.Kept.of_base(frame(edges))
            withdrawn, survived = kept.delete(frame(gone), how)
            assert read(withdrawn) == truth - left and read(kept.closed) == left and read(survived) <= left
            new = kept.insert(frame(gone))
            assert read(new) == truth - left and read(kept.closed) == truth

    def fails(df):
        raise OSError

    with pytest.raises(OSError):
        kept.delete(frame(gone), sink=fails)
    assert read(kept.closed) == truth and read(kept.base) == edges


def test_closure_to_a_target_stops(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "src long")
    m = closure.Metrics()
    assert closure.transitive(chain, start, metrics=m, target=F.lit(3).cast("long")).where("dst = 3").count() == 1
    assert m.rounds == 3
    m = closure.Metrics()
    assert closure.transitive(chain, start, metrics=m).count() == 40 and m.nodes == 41
    m = closure.Metrics()
    assert closure.transitive(chain, metrics=m).count() == 820 and m.rounds <= 8


def test_lists_by_doubling(spark):
    from graphloom.reason.lists import FIRST, NIL, REST, collections

    cells, heads = [], []
    for name, n in (("a", 1), ("b", 7), ("c", 100), ("d", 0)):
        heads.append((f"<ax{name}>", "<http://www.w3.org/2002/07/owl#unionOf>", f"_:{name}0" if n else NIL))
        for i in range(n):
            cells += [(f"_:{name}{i}", FIRST, f"<i{i}>"), (f"_:{name}{i}", REST, f"_:{name}{i + 1}" if i + 1 < n else NIL)]
    heads += [("<axl>", "<http://www.w3.org/2002/07/owl#hasKey>", "_:l0"), ("<axg>", "<http://www.w3.org/2002/07/owl#hasKey>", "_:g0"), ("<axs>", "<http://www.w3.org/2002/07/owl#hasKey>", "_:b3")]
    cells += [("_:l0", FIRST, "<x>"), ("_:l0", REST, "_:l1"), ("_:l1", FIRST, "<x>"), ("_:l1", REST, "_:l0")]  # a cycle
    cells += [("_:g0", FIRST, "<x>"), ("_:g0", REST, "_:g1"), ("_:g1", REST, NIL)]  # a gap
    found = {}
    for row in collections(spark.createDataFrame(heads + cells, "s string, p string, o string")).collect():
        found.setdefault((row.axiom, row.n), []).append((row.position, row["item"]))
    want = {("<axa>", 1): 1, ("<axb>", 7): 7, ("<axc>", 100): 100}
    assert {k: sorted(v) for k, v in found.items()} == {k: [(i, f"<i{i}>") for i in range(n)] for k, n in want.items()} | {("<axs>", 4): [(i, f"<i{i + 3}>") for i in range(4)]}


def test_hot_functional_values_make_a_star(spark):
    """One value shared by many subjects: rows in proportion to them, and one class."""
    from graphloom.reason.engine import folded
    from graphloom.reason.evaluate import star_step

    ifp = ("<u:p>", RDF_TYPE, f"<{OWL}InverseFunctionalProperty>")
    facts = spark.createDataFrame([(f"<s{i:03}>", "<u:p>", "<hot>") for i in range(200)] + [("<t>", "<u:p>", "<cold>"), ("<s007>", "<u:q>", "<v>"), ifp], "s string, p string, o string")
    made = star_step("prp-ifp", facts, facts, RDF_TYPE, ifp[2])
    assert made.count() == 201
    out = folded(facts, [r for r in owl_rules() if r.name == "prp-ifp"])
    assert out.classes.count() == 200 and out.classes.select("canon").distinct().count() == 1
    assert out.facts.where("p = '<u:p>'").count() == 2
    assert out.expanded(s="<s150>", p="<u:q>").collect() == [("<s150>", "<u:q>", "<v>")]
    assert out.expanded(p="<u:p>").count() == 201


def test_folding_agrees_with_pairs(spark):
    """Facts over classes, expanded, are those of the fixpoint that lists all pairs."""
    r = random.Random(1)
    node = lambda: f"<n{r.randrange(6)}>"
    facts = {(node(), "<u:f>", node()) for _ in range(6)} | {(node(), "<u:q>", node()) for _ in range(4)} | {("<n0>", SAME, "<n5>")}
    rows = sorted(facts) + [("<u:f>", RDF_TYPE, f"<{OWL}FunctionalProperty>")]
    df = spark.createDataFrame(rows, "s string, p string, o string")
    rules = [x for x in owl_rules() if x.name in ("prp-fp", "eq-rep-s", "eq-rep-o")]
    read = lambda x: {tuple(t) for t in x.where(F.col("p").isin("<u:f>", "<u:q>")).select("s", "p", "o").collect()}
    assert read(folded(df, rules).expanded()) == read(fixpoint(df, rules).triples)


def test_literals_that_must_be_equal_and_are_not(spark):
    num = lambda n: f'"{n}"^^<http://www.w3.org/2001/XMLSchema#integer>'
    rows = [("<u:p>", RDF_TYPE, f"<{OWL}FunctionalProperty>"), ("<a>", "<u:p>", num(1)), ("<a>", "<u:p>", num("01"))]
    frame = lambda x: spark.createDataFrame(x, "s string, p string, o string")
    assert materialise(frame(rows), [], lists=False).consistent()
    assert not materialise(frame([*rows, ("<a>", "<u:p>", num(2))]), [], lists=False).consistent()


def test_restart_in_the_middle_of_a_stream(spark, tmp_path):
    """A circuit resumed from its journal is that of one that never stopped, and costs what changes."""
    from graphloom.streaming.ticks import ticking

    rules = parse_rules("t: ?x <u:p> ?y . ?y <u:p> ?z => ?x <u:p> ?z")
    r = random.Random(5)
    batches, there = [], []
    for _ in range(5):
        new = [(1, f"<n{r.randrange(6)}>", "<u:p>", f"<n{r.randrange(6)}>") for _ in range(3)]
        gone = [(-1, *t) for t in r.sample(there, min(2, len(there)))]
        there += [t[1:] for t in new]
        batches.append(spark.createDataFrame(new + gone, "op long, s string, p string, o string"))
    whole = I.Circuit(spark, rules)
    run = ticking(whole)
    for i, b in enumerate(batches):
        run(b, i)
    journal, told = I.Journal(spark, f"{tmp_path}/j", every=2), []
    run = ticking(I.Circuit(spark, rules), lambda df, n: told.append((n, df.count())), journal)
    for i in (0, 1, 2):
        run(batches[i], i)
    circuit, last = journal.resume(rules)
    assert last == 2 and circuit.time == 3
    run = ticking(circuit, lambda df, n: told.append((n, df.count())), journal, last)
    for i in (2, 3, 3, 4):  # the last batch before the restart comes again, and one more twice
        run(batches[i], i)
    assert [n for n, _ in told] == [0, 1, 2, 2, 3, 4] and told[2] == told[3]
    assert sorted(map(tuple, circuit.facts.collect()), key=str) == sorted(map(tuple, whole.facts.collect()), key=str)
    circuit.validate()


def test_a_resumed_circuit_outlives_the_state_it_came_from(spark, tmp_path):
    rules = parse_rules("s: ?x <u:p> ?y => ?x <u:q> ?y")
    journal, first = I.Journal(spark, f"{tmp_path}/j", every=1), I.Circuit(spark, rules)
    first.assert_(spark.createDataFrame([("<a>", "<u:p>", "<b>")], "s string, p string, o string"))
    first.tick()
    journal.checkpoint(first, 0)
    circuit, _ = journal.resume(rules)
    journal.checkpoint(circuit, 1)
    journal.tidy()
    assert sorted(p.name for p in (tmp_path / "j/state").iterdir()) == [f"{1:012d}"]
    circuit.retract(spark.createDataFrame([("<a>", "<u:p>", "<b>")], "s string, p string, o string"))
    assert circuit.tick().count() == 2 and circuit.facts.count() == 0 and circuit.snapshot(1).count() == 2
    circuit.validate()


def test_a_tick_writes_what_it_touches(spark):
    rules = parse_rules("s: ?x <u:p> ?y => ?x <u:q> ?y")
    rows = lambda lo, hi: spark.createDataFrame([(f"<s{i}>", "<u:p>", f"<o{i}>") for i in range(lo, hi)], "s string, p string, o string")
    circuit = I.Circuit(spark, rules)
    circuit.assert_(rows(0, 3000))
    circuit.tick()
    circuit.assert_(rows(3000, 3002))
    circuit.retract(rows(0, 1))
    out = circuit.tick()
    assert out.count() == 6 and circuit.written <= 12
    circuit.validate()
