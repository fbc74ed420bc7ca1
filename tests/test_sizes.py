"""What grows with the input is dealt out over tasks and never held by one task or by the driver."""

from pyspark.sql import functions as F

from graphloom.parser.rdf import parse
from graphloom.registry import one_file
from graphloom.sources import documents, files

LONG = """@prefix a: <urn:a:> .
a:s a:p \"\"\"two
 . \n a:q "q" .
end\"\"\" ; a:q '''it
is \"\"\" . ''' .
a:t a:p [ a:q 1.5 ;
 a:r (1 2
 3) ] .  # a note .
@prefix a: <urn:b:> .
_:x a:p "x"@base , _:x .
@base <http://h/> .
<y> a:p <z> .
"""


def _plain(quads):
    return sorted(str(["_:" if t and t.startswith("_:") else t for t in q]) for q in quads)


def test_a_turtle_file_is_cut_where_statements_end(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "long.ttl")
    text = LONG * 3
    (tmp_path / "long.ttl").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for piece in (1, 100):
            monkeypatch.setattr(documents, "PIECE", piece)
            found = files.read(spark, path).select("*", F.spark_partition_id().alias("part")).collect()
            assert _plain(r[:4] for r in found) == _plain(parse(text, base="file:" + path))
            assert len({r["part"] for r in found}) > 1
            assert len({t for r in found for t in r[:4] if t and t.startswith("_:")}) == 13
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_file_is_written_by_all_tasks(spark, tmp_path):
    lines = spark.range(0, 100, 1, 4).select(F.col("id").cast("string").alias("value"))
    path = one_file(lines, str(tmp_path / "all.txt"), "head\n")
    assert open(path).read().splitlines() == ["head", *map(str, range(100))]


def test_an_ordered_scan_numbers_rows_without_the_driver(spark):
    from graphloom.store import SCHEMA, scan

    quads = spark.createDataFrame([(None, f"s{i:03}", "p", f"o{i % 7}") for i in range(200)], SCHEMA)
    found = scan(quads, order="osp", places=True)
    assert [r["s"] for r in sorted(found.collect(), key=lambda r: r["place"])] == [r["s"] for r in scan(quads, order="osp").collect()]
    assert sorted(r["place"] for r in found.collect()) == list(range(200))


def test_a_hot_term_is_no_key_of_a_shuffle(spark, monkeypatch):
    from graphloom import store
    from graphloom.ids import IdGraph

    monkeypatch.setattr(store, "HOT", 20)
    quads = spark.createDataFrame([(None if i % 3 else "<g>", f"<s{i}>", "<p>", '"o"') for i in range(400)], store.SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    source = IdGraph(quads)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in source.encoded.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 200  # one predicate, several tasks
    encoded = store.encode_ids(quads, source.terms)
    back = store.decode_ids(encoded, source.terms)
    assert sorted(map(str, back.collect())) == sorted(map(str, quads.collect()))
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 4


def test_few_schema_triples_are_broadcast_to_a_rule(spark):
    """A join on the predicate would give one task all triples of it."""
    from graphloom.reason.evaluate import Sizes, delta_steps
    from graphloom.reason.rules import owl_rules
    from graphloom.registry import TRIPLE
    from graphloom.terms import OWL, RDF_TYPE

    kind = f"<{OWL}SymmetricProperty>"
    rule = next(r for r in owl_rules() if r.name == "prp-symp")
    facts = spark.createDataFrame([("<p>", RDF_TYPE, kind), ("<x>", RDF_TYPE, "<C>"), *[(f"<{i}>", "<p>", "<y>") for i in range(9)]], TRIPLE)
    sizes = Sizes.counted(facts, [kind])
    assert sizes == {(RDF_TYPE, kind): 1, (RDF_TYPE, None): 1, ("<p>", None): 9}
    assert [sizes.of(p, frozenset([kind])) for p in rule.body] == [1, 11]
    first, second = delta_steps(rule, facts, facts, None, [1, 10**9], [1, 10**9])
    for df in (first, second):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in plan and df.count() == 9
    assert delta_steps(rule, facts, facts, None, [0, 10**9], [0, 10**9]) == []


def test_a_large_change_is_dealt_over_more_tasks_than_a_small_one(spark, monkeypatch):
    from graphloom import store
    from graphloom.update import Updater

    monkeypatch.setattr(store, "SMALL", 1000)
    monkeypatch.setattr(store, "SHARE", 500, raising=False)
    quads = spark.createDataFrame([("<a>" if i % 2 else "<b>", f"<s{i // 2}>", "<p>", f'"{i // 4}"') for i in range(400)], store.SCHEMA)
    state = store.Store.of(quads)
    prepared = []
    monkeypatch.setattr(Updater, "exists", lambda self, graph: prepared.append(self.store._prepared) or True)
    assert Updater(spark, state).run("COPY <a> TO <b>") == [(0, 0)]
    assert prepared == [True]  # what made the base is not run again for each pattern
    assert Updater(spark, state).run("INSERT { GRAPH <a> { ?s <q> ?o } } WHERE { GRAPH ?g { ?s <p> ?o } }; MOVE <a> TO <c>") == [(0, 200), (400, 400)]
    for df in (state.segments[0].events[0][1], state.quads):
        assert len({r[0] for r in df.select(F.spark_partition_id()).collect()}) > 4
    found = {tuple(r) for r in state.quads.collect()}
    assert found == {(g, f"<s{i}>", p, f'"{i // 2}"') for i in range(200) for g, p in (("<b>", "<p>"), ("<c>", "<p>"), ("<c>", "<q>"))}
    assert {tuple(r) for r in state.at(0).collect()} == {tuple(r) for r in quads.collect()}


def test_a_first_tick_is_neither_sorted_nor_copied(spark):
    from graphloom import incremental
    from graphloom.reason.rules import parse_rules
    from graphloom.registry import TRIPLE

    rules = parse_rules("b: ?x <p> ?y . ?y <p> ?z => ?x <p> ?z") + parse_rules("a: ?x <p> ?y . ?y <q> ?z => ?x <p> ?z")
    circuit = incremental.Circuit(spark, rules)
    facts = spark.createDataFrame([("<1>", "<p>", "<2>"), ("<2>", "<p>", "<3>"), ("<2>", "<q>", "<3>")], TRIPLE)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan(circuit._once(facts, facts))
    assert circuit._once(facts, facts).collect() == [("<1>", "<p>", "<3>", "a")]  # the first rule by name
    circuit.assert_(facts)
    circuit.tick()
    assert "Aggregate" not in plan(circuit.known.overlay())
    circuit.retract(facts.where("p = '<q>'"))
    circuit.assert_(facts.where("o = '<2>'"))
    circuit.tick()
    assert [tuple(r) for r in circuit.feed[-1].select("s", "p", "o", "mult").collect()] == [("<2>", "<q>", "<3>", -1)]
    assert circuit.facts.where("o = '<3>' and s = '<1>'").collect() == [("<1>", "<p>", "<3>", "b")]
    circuit.validate()
