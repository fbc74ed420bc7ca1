"""One query for each reasoning rule: facts made of the tables, that rule alone, and the SQL of what follows.

Customers point to nations and nations to regions. A rule that chains two
patterns gets one of these relations for each, under the predicates it names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .reason.engine import fixpoint
from .reason.rules import CLOSED, SEMAPV, mapping_rules, owl_rules
from .terms import OWL, RDF, RDF_TYPE, RDFS, SKOS, XSD

Triple = tuple[str, str, str]


def owl(name: str) -> str:
    return f"<{OWL}{name}>"


def rdfs(name: str) -> str:
    return f"<{RDFS}{name}>"


def skos(name: str) -> str:
    return f"<{SKOS}{name}>"


def semapv(name: str) -> str:
    return f"<{SEMAPV}crossSpecies{name}Match>"


SUB, SUBP, EQC, EQP, DOM, RNG, SAME = rdfs("subClassOf"), rdfs("subPropertyOf"), owl("equivalentClass"), owl("equivalentProperty"), rdfs("domain"), rdfs("range"), owl("sameAs")
EXACT, BROAD, NARROW, NOT_EXACT = skos("exactMatch"), skos("broadMatch"), skos("narrowMatch"), "<urn:graphloom:not/exactMatch>"
NOTHING, CLASS, IN, OF = owl("Nothing"), owl("Class"), "<urn:tpch:c_nationkey>", "<urn:tpch:n_regionkey>"

#: Terms in SQL that both engines run.
C, N, R = "concat('<urn:tpch:customer/', c_custkey, '>')", "concat('<urn:tpch:nation/', {}, '>')", "concat('<urn:tpch:region/', n_regionkey, '>')"
CN, NN = N.format("c_nationkey"), N.format("n_nationkey")
JOINED = "customer JOIN nation ON c_nationkey = n_nationkey"


@dataclass
class Case:
    """Facts as ``(table, filter, s, p, o)`` with terms in SQL, axioms, and the SQL of what follows."""

    facts: list[tuple[str, str, str, str, str]]
    sql: str
    axioms: list[Triple] = field(default_factory=list)
    keep: str | None = None
    lists: bool = False


def quoted(term: str) -> str:
    return "'" + term + "'"


def up(p: str, where: str = "true") -> tuple[str, str, str, str, str]:
    return ("customer", where, C, quoted(p), CN)


def over(p: str) -> tuple[str, str, str, str, str]:
    return ("nation", "true", NN, quoted(p), R)


def back(fact: tuple[str, str, str, str, str]) -> tuple[str, str, str, str, str]:
    table, where, s, p, o = fact
    return table, where, o, p, s


def found(s: str, p: str, o: str, table: str = "customer", where: str = "true") -> str:
    return f"SELECT DISTINCT {s} AS s, '{p}' AS p, {o} AS o FROM {table} WHERE {where}"


def listed(head: str, items: list[str]) -> list[Triple]:
    """The cells of a list that starts at a blank node."""
    cells = [f"_:{head}{i}" for i in range(len(items))] + [f"<{RDF}nil>"]
    return [t for i, x in enumerate(items) for t in ((cells[i], f"<{RDF}first>", x), (cells[i], f"<{RDF}rest>", cells[i + 1]))]


def in_class(where: str, name: str) -> tuple[str, str, str, str, str]:
    return ("customer", where, C, quoted(RDF_TYPE), f"'<urn:x:{name}>'")


def number(n: int) -> str:
    return f'"{n}"^^<{XSD}nonNegativeInteger>'


CASES: dict[str, Case] = {}

for _name, _first, _second, _head in (
    ("cax-sco", RDF_TYPE, SUB, RDF_TYPE), ("cax-eqc1", RDF_TYPE, EQC, RDF_TYPE),
    ("scm-dom1", DOM, SUB, DOM), ("scm-rng1", RNG, SUB, RNG), ("scm-dom2", SUBP, DOM, DOM), ("scm-rng2", SUBP, RNG, RNG),
    ("sssom-rce1-broad", EXACT, BROAD, BROAD), ("sssom-rce1-narrow", EXACT, NARROW, NARROW), ("sssom-rce1-exact", EXACT, EXACT, EXACT),
    ("sssom-rce2-broad", BROAD, EXACT, BROAD), ("sssom-rce2-narrow", NARROW, EXACT, NARROW), ("sssom-neg-exact", EXACT, NOT_EXACT, NOT_EXACT),
    ("scm-sco", SUB, SUB, SUB), ("scm-spo", SUBP, SUBP, SUBP), ("sssom-t1-exact", EXACT, EXACT, EXACT), ("sssom-t1-broad", BROAD, BROAD, BROAD), ("sssom-t1-narrow", NARROW, NARROW, NARROW),
):
    CASES[_name] = Case([up(_first), over(_second)], found(C, _head, R, JOINED))
CASES["cax-eqc2"] = Case([up(RDF_TYPE), back(over(EQC))], found(C, RDF_TYPE, R, JOINED))
CASES["prp-trp"] = Case([up(IN), over(IN)], found(C, IN, R, JOINED), [(IN, RDF_TYPE, owl("TransitiveProperty"))])

for _name, _body, _head, _turned in (
    ("scm-eqc1", EQC, SUB, False), ("scm-eqc2", EQC, SUB, True), ("scm-eqp1", EQP, SUBP, False), ("scm-eqp2", EQP, SUBP, True),
    ("sssom-rg1", EQC, EXACT, False), ("sssom-rg2", SUB, BROAD, False), ("sssom-ri1", NARROW, BROAD, True), ("sssom-ri2", BROAD, NARROW, True),
    ("sssom-ri3", semapv("Exact"), semapv("Exact"), True), ("sssom-ri4", semapv("Narrow"), semapv("Broad"), True), ("sssom-ri5", semapv("Broad"), semapv("Narrow"), True),
):
    CASES[_name] = Case([up(_body)], found(*((CN, _head, C) if _turned else (C, _head, CN))))

_CLASSES = [("customer", "true", C, quoted(RDF_TYPE), quoted(CLASS))]
CASES["scm-cls"] = Case(_CLASSES, found(C, SUB, C))
CASES["scm-cls-thing"] = Case(_CLASSES, found(C, SUB, quoted(owl("Thing"))))
CASES["scm-cls-nothing"] = Case(_CLASSES, found(quoted(NOTHING), SUB, C))
CASES["scm-op"] = Case([("customer", "true", C, quoted(RDF_TYPE), quoted(owl("ObjectProperty")))], found(C, SUBP, C))
for _name, _body, _head in (("scm-eqp-rev", SUBP, EQP), ("scm-eqc-rev", SUB, EQC)):
    CASES[_name] = Case([up(_body), back(up(_body))], f"{found(C, _head, CN)} UNION ALL {found(CN, _head, C)}")

_RICH, _NEAR, _BUILD = "c_acctbal > 9000", "c_nationkey < 12", "c_mktsegment = 'BUILDING'"
_BOTH = [in_class(_RICH, "Rich"), in_class(_NEAR, "Near")]
CASES["cax-dw"] = Case(_BOTH, found(C, RDF_TYPE, quoted(NOTHING), where=f"{_RICH} AND {_NEAR}"), [("<urn:x:Rich>", owl("disjointWith"), "<urn:x:Near>")])
CASES["cls-com"] = Case(_BOTH, CASES["cax-dw"].sql, [("<urn:x:Rich>", owl("complementOf"), "<urn:x:Near>")])
CASES["cls-avf"] = Case([up(IN), in_class(_RICH, "R")], found(CN, RDF_TYPE, "'<urn:x:N>'", where=_RICH), [("<urn:x:R>", owl("allValuesFrom"), "<urn:x:N>"), ("<urn:x:R>", owl("onProperty"), IN)])
CASES["cls-hv1"] = Case([in_class(_RICH, "R")], found(C, "<urn:x:home>", "'<urn:x:v>'", where=_RICH), [("<urn:x:R>", owl("hasValue"), "<urn:x:v>"), ("<urn:x:R>", owl("onProperty"), "<urn:x:home>")])
CASES["prp-rfp"] = Case([("customer", "true", C, quoted(RDF_TYPE), quoted(owl("Thing")))], found(C, "<urn:x:self>", C), [("<urn:x:self>", RDF_TYPE, owl("ReflexiveProperty"))])

_DENIAL = "concat('<urn:x:denial', c_custkey, '>')"
_DENIED = [("customer", "true", _DENIAL, quoted(owl("sourceIndividual")), C), ("customer", "true", _DENIAL, quoted(owl("assertionProperty")), quoted(IN))]
_GUESS = N.format("c_custkey % 25")
_SEGMENT = "concat('\"', c_mktsegment, '\"')"
CASES["prp-npa1"] = Case([up(IN), *_DENIED, ("customer", "true", _DENIAL, quoted(owl("targetIndividual")), _GUESS)], found(C, RDF_TYPE, quoted(NOTHING), where="c_custkey % 25 = c_nationkey"))
CASES["prp-npa2"] = Case([("customer", "true", C, quoted(IN), _SEGMENT), *_DENIED, ("customer", "true", _DENIAL, quoted(owl("targetValue")), "'\"BUILDING\"'")], found(C, RDF_TYPE, quoted(NOTHING), where=_BUILD))
CASES["eq-diff1"] = Case([over(SAME), ("nation", "n_regionkey = 2", NN, quoted(owl("differentFrom")), R)], found(NN, RDF_TYPE, quoted(NOTHING), "nation", "n_regionkey = 2"), keep=RDF_TYPE)
_TWINS = f"SELECT {N.format('a.n_nationkey')} AS s, '{SAME}' AS p, {N.format('b.n_nationkey')} AS o FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey"
CASES["prp-ifp"] = Case([over(OF)], _TWINS, [(OF, RDF_TYPE, owl("InverseFunctionalProperty"))])
CASES["eq-trans"] = Case(
    [over(SAME)],
    f"{_TWINS} UNION ALL {found(R, SAME, NN, 'nation')} UNION ALL {found(R, SAME, R, 'nation')}",
)

CASES["prp-spo2"] = Case([up(IN), over(OF)], found(C, "<urn:x:part>", R, JOINED), [("<urn:x:part>", owl("propertyChainAxiom"), "_:c0"), *listed("c", [IN, OF])], "<urn:x:part>", True)
CASES["cls-uni"] = Case(_BOTH, found(C, RDF_TYPE, "'<urn:x:K>'", where=f"{_RICH} OR {_NEAR}"), [("<urn:x:K>", owl("unionOf"), "_:u0"), *listed("u", ["<urn:x:Rich>", "<urn:x:Near>"])], RDF_TYPE, True)
CASES["scm-int"] = Case(_BOTH, f"SELECT '<urn:x:K>' AS s, '{SUB}' AS p, '<urn:x:Rich>' AS o UNION ALL SELECT '<urn:x:K>', '{SUB}', '<urn:x:Near>'", [("<urn:x:K>", owl("intersectionOf"), "_:i0"), *listed("i", ["<urn:x:Rich>", "<urn:x:Near>"])], SUB, True)
CASES["cax-adc"] = Case(
    [*_BOTH, in_class(_BUILD, "Build")],
    found(C, RDF_TYPE, quoted(NOTHING), where=f"({_RICH} AND {_NEAR}) OR ({_RICH} AND {_BUILD}) OR ({_NEAR} AND {_BUILD})"),
    [("<urn:x:D>", RDF_TYPE, owl("AllDisjointClasses")), ("<urn:x:D>", owl("members"), "_:d0"), *listed("d", ["<urn:x:Rich>", "<urn:x:Near>", "<urn:x:Build>"])], RDF_TYPE, True,
)
CASES["prp-adp"] = Case(
    [up(IN), ("customer", "true", C, "'<urn:x:guess>'", _GUESS)],
    found(C, RDF_TYPE, quoted(NOTHING), where="c_custkey % 25 = c_nationkey"),
    [("<urn:x:D>", RDF_TYPE, owl("AllDisjointProperties")), ("<urn:x:D>", owl("members"), "_:d0"), *listed("d", [IN, "<urn:x:guess>"])], RDF_TYPE, True,
)
for _name, _item in (("eq-diff2", "members"), ("eq-diff3", "distinctMembers")):
    CASES[_name] = Case(
        [over(SAME)], found(NN, owl("differentFrom"), N.format("b.k"), "nation, (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3) b", "n_nationkey < 3 AND n_nationkey <> b.k"),
        [("<urn:x:D>", RDF_TYPE, owl("AllDifferent")), ("<urn:x:D>", owl(_item), "_:m0"), *listed("m", [f"<urn:tpch:nation/{k}>" for k in range(3)])], owl("differentFrom"), True,
    )
_TWO = [up(IN), ("customer", "true", C, quoted(IN), "concat('<urn:x:n', c_nationkey, '>')"), in_class("true", "R")]
_ALIAS = "concat('<urn:x:n', c_nationkey, '>')"
_MERGED = " UNION ALL ".join(found(a, SAME, b) for a in (CN, _ALIAS) for b in (CN, _ALIAS))
_TYPED = [("customer", "true", CN, quoted(RDF_TYPE), "'<urn:x:Nation>'"), ("customer", "true", _ALIAS, quoted(RDF_TYPE), "'<urn:x:Nation>'")]


def _limit(kind: str, n: int, on: str | None = None) -> list[Triple]:
    return [("<urn:x:R>", owl(kind), number(n)), ("<urn:x:R>", owl("onProperty"), IN)] + ([("<urn:x:R>", owl("onClass"), on)] if on else [])


_FAULTY = found(C, RDF_TYPE, quoted(NOTHING))
CASES["cls-maxc1"] = Case(_TWO, _FAULTY, _limit("maxCardinality", 0), RDF_TYPE, True)
CASES["cls-maxc2"] = Case(_TWO, _MERGED, _limit("maxCardinality", 1), SAME, True)
CASES["cls-maxqc1"] = Case(_TWO + _TYPED, _FAULTY, _limit("maxQualifiedCardinality", 0, "<urn:x:Nation>"), RDF_TYPE, True)
CASES["cls-maxqc2"] = Case(_TWO, _FAULTY, _limit("maxQualifiedCardinality", 0, owl("Thing")), RDF_TYPE, True)
CASES["cls-maxqc3"] = Case(_TWO + _TYPED, _MERGED, _limit("maxQualifiedCardinality", 1, "<urn:x:Nation>"), SAME, True)
CASES["cls-maxqc4"] = Case(_TWO, _MERGED, _limit("maxQualifiedCardinality", 1, owl("Thing")), SAME, True)


def follow(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rule alone infers from its case."""
    case = CASES[name]
    parts = [spark.read.parquet(f"{sf_dir}/{t}.parquet").where(w).select(F.expr(s).alias("s"), F.expr(p).alias("p"), F.expr(o).alias("o")) for t, w, s, p, o in case.facts]
    if case.axioms:
        parts.append(spark.createDataFrame(case.axioms, "s string, p string, o string"))
    rules = [r for r in owl_rules() + mapping_rules() if r.name == name]
    closed = {name: CLOSED[name]} if name in CLOSED else None
    out = fixpoint(reduce(DataFrame.unionByName, parts), rules, closed, case.lists).inferred.select("s", "p", "o")
    return out.where(F.col("p") == case.keep) if case.keep else out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"rule_{n.replace('-', '_')}": partial(follow, n) for n in CASES}


def oracle_sql() -> dict[str, str]:
    return {f"rule_{n.replace('-', '_')}": case.sql for n, case in CASES.items()}
