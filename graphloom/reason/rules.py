"""Rules as data: OWL 2 RL and mapping rules, each a body of patterns and a head."""

from __future__ import annotations

from dataclasses import dataclass

from ..terms import OWL, RDF, RDFS, SKOS, Var

SEMAPV = "https://w3id.org/semapv/vocab/"
NOT = "urn:graphloom:not/"
SPACES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "skos": SKOS, "semapv": SEMAPV, "not": NOT}

#: The rules of the OWL 2 RL profile that are joins, in its names, and those for mappings.
COMPILED = """
cax-sco: ?c1 rdfs:subClassOf ?c2 . ?x rdf:type ?c1 => ?x rdf:type ?c2
cax-eqc1: ?c1 owl:equivalentClass ?c2 . ?x rdf:type ?c1 => ?x rdf:type ?c2
cax-eqc2: ?c1 owl:equivalentClass ?c2 . ?x rdf:type ?c2 => ?x rdf:type ?c1
prp-dom: ?p rdfs:domain ?c . ?x ?p ?y => ?x rdf:type ?c
prp-rng: ?p rdfs:range ?c . ?x ?p ?y => ?y rdf:type ?c
prp-symp: ?p rdf:type owl:SymmetricProperty . ?x ?p ?y => ?y ?p ?x
prp-spo1: ?p1 rdfs:subPropertyOf ?p2 . ?x ?p1 ?y => ?x ?p2 ?y
prp-eqp1: ?p1 owl:equivalentProperty ?p2 . ?x ?p1 ?y => ?x ?p2 ?y
prp-eqp2: ?p1 owl:equivalentProperty ?p2 . ?x ?p2 ?y => ?x ?p1 ?y
prp-inv1: ?p1 owl:inverseOf ?p2 . ?x ?p1 ?y => ?y ?p2 ?x
prp-inv2: ?p1 owl:inverseOf ?p2 . ?x ?p2 ?y => ?y ?p1 ?x
scm-cls: ?c rdf:type owl:Class => ?c rdfs:subClassOf ?c
scm-cls-thing: ?c rdf:type owl:Class => ?c rdfs:subClassOf owl:Thing
scm-cls-nothing: ?c rdf:type owl:Class => owl:Nothing rdfs:subClassOf ?c
scm-eqc1: ?c1 owl:equivalentClass ?c2 => ?c1 rdfs:subClassOf ?c2
scm-eqc2: ?c1 owl:equivalentClass ?c2 => ?c2 rdfs:subClassOf ?c1
scm-op: ?p rdf:type owl:ObjectProperty => ?p rdfs:subPropertyOf ?p
scm-eqp1: ?p1 owl:equivalentProperty ?p2 => ?p1 rdfs:subPropertyOf ?p2
scm-eqp2: ?p1 owl:equivalentProperty ?p2 => ?p2 rdfs:subPropertyOf ?p1
scm-eqp-rev: ?p1 rdfs:subPropertyOf ?p2 . ?p2 rdfs:subPropertyOf ?p1 => ?p1 owl:equivalentProperty ?p2
scm-eqc-rev: ?c1 rdfs:subClassOf ?c2 . ?c2 rdfs:subClassOf ?c1 => ?c1 owl:equivalentClass ?c2
scm-dom1: ?p rdfs:domain ?c1 . ?c1 rdfs:subClassOf ?c2 => ?p rdfs:domain ?c2
scm-rng1: ?p rdfs:range ?c1 . ?c1 rdfs:subClassOf ?c2 => ?p rdfs:range ?c2
scm-dom2: ?p2 rdfs:domain ?c . ?p1 rdfs:subPropertyOf ?p2 => ?p1 rdfs:domain ?c
scm-rng2: ?p2 rdfs:range ?c . ?p1 rdfs:subPropertyOf ?p2 => ?p1 rdfs:range ?c
cls-svf2: ?x owl:someValuesFrom owl:Thing . ?x owl:onProperty ?p . ?u ?p ?v => ?u rdf:type ?x
cls-avf: ?x owl:allValuesFrom ?y . ?x owl:onProperty ?p . ?u rdf:type ?x . ?u ?p ?v => ?v rdf:type ?y
cls-hv1: ?x owl:hasValue ?y . ?x owl:onProperty ?p . ?u rdf:type ?x => ?u ?p ?y
cls-hv2: ?x owl:hasValue ?y . ?x owl:onProperty ?p . ?u ?p ?y => ?u rdf:type ?x
cax-dw: ?c1 owl:disjointWith ?c2 . ?x rdf:type ?c1 . ?x rdf:type ?c2 => ?x rdf:type owl:Nothing
cls-com: ?c1 owl:complementOf ?c2 . ?x rdf:type ?c1 . ?x rdf:type ?c2 => ?x rdf:type owl:Nothing
prp-irp: ?p rdf:type owl:IrreflexiveProperty . ?x ?p ?x => ?x rdf:type owl:Nothing
prp-asyp: ?p rdf:type owl:AsymmetricProperty . ?x ?p ?y . ?y ?p ?x => ?x rdf:type owl:Nothing
prp-pdw: ?p1 owl:propertyDisjointWith ?p2 . ?x ?p1 ?y . ?x ?p2 ?y => ?x rdf:type owl:Nothing
prp-npa1: ?n owl:sourceIndividual ?i . ?n owl:assertionProperty ?p . ?n owl:targetIndividual ?j . ?i ?p ?j => ?i rdf:type owl:Nothing
prp-npa2: ?n owl:sourceIndividual ?i . ?n owl:assertionProperty ?p . ?n owl:targetValue ?j . ?i ?p ?j => ?i rdf:type owl:Nothing
eq-diff1: ?x owl:differentFrom ?y . ?x owl:sameAs ?y => ?x rdf:type owl:Nothing
prp-fp: ?p rdf:type owl:FunctionalProperty . ?x ?p ?y1 . ?x ?p ?y2 => ?y1 owl:sameAs ?y2
prp-ifp: ?p rdf:type owl:InverseFunctionalProperty . ?x1 ?p ?y . ?x2 ?p ?y => ?x1 owl:sameAs ?x2
prp-rfp: ?p rdf:type owl:ReflexiveProperty . ?x rdf:type owl:Thing => ?x ?p ?x
eq-rep-s: ?s owl:sameAs ?s2 . ?s ?p ?o => ?s2 ?p ?o
eq-rep-p: ?p owl:sameAs ?p2 . ?s ?p ?o => ?s ?p2 ?o
eq-rep-o: ?o owl:sameAs ?o2 . ?s ?p ?o => ?s ?p ?o2
sssom-rg1: ?a owl:equivalentClass ?b => ?a skos:exactMatch ?b
sssom-rg2: ?a rdfs:subClassOf ?b => ?a skos:broadMatch ?b
sssom-ri1: ?a skos:narrowMatch ?b => ?b skos:broadMatch ?a
sssom-ri2: ?a skos:broadMatch ?b => ?b skos:narrowMatch ?a
sssom-ri3: ?a semapv:crossSpeciesExactMatch ?b => ?b semapv:crossSpeciesExactMatch ?a
sssom-ri4: ?a semapv:crossSpeciesNarrowMatch ?b => ?b semapv:crossSpeciesBroadMatch ?a
sssom-ri5: ?a semapv:crossSpeciesBroadMatch ?b => ?b semapv:crossSpeciesNarrowMatch ?a
sssom-rce1-broad: ?a skos:exactMatch ?b . ?b skos:broadMatch ?c => ?a skos:broadMatch ?c
sssom-rce1-narrow: ?a skos:exactMatch ?b . ?b skos:narrowMatch ?c => ?a skos:narrowMatch ?c
sssom-rce1-exact: ?a skos:exactMatch ?b . ?b skos:exactMatch ?c => ?a skos:exactMatch ?c
sssom-rce2-broad: ?a skos:broadMatch ?b . ?b skos:exactMatch ?c => ?a skos:broadMatch ?c
sssom-rce2-narrow: ?a skos:narrowMatch ?b . ?b skos:exactMatch ?c => ?a skos:narrowMatch ?c
sssom-neg-exact: ?a skos:exactMatch ?b . ?b not:exactMatch ?c => ?a not:exactMatch ?c
"""

#: Predicates closed transitively by the fixpoint operator, and the rule each stands for.
CLOSED = {
    "scm-sco": RDFS + "subClassOf",
    "scm-spo": RDFS + "subPropertyOf",
    "sssom-t1-exact": SKOS + "exactMatch",
    "sssom-t1-broad": SKOS + "broadMatch",
    "sssom-t1-narrow": SKOS + "narrowMatch",
}

Slot = str | Var


@dataclass(frozen=True)
class Rule:
    """Body and head over variables and stored terms."""

    name: str
    body: tuple[tuple[Slot, Slot, Slot], ...]
    head: tuple[Slot, Slot, Slot]

    @property
    def predicates(self) -> list[str | None]:
        """The body's predicates; None for a variable."""
        return [p if isinstance(p, str) else None for _, p, _ in self.body]


def slot(text: str) -> Slot:
    if text.startswith("?"):
        return Var(text[1:])
    if text.startswith(("<", '"', "_:")):
        return text
    space, _, local = text.partition(":")
    return f"<{SPACES[space]}{local}>"


def parse_rules(text: str) -> list[Rule]:
    """Rules of lines ``name: pattern . pattern => pattern``."""
    out = []
    for line in filter(None, map(str.strip, text.splitlines())):
        name, _, rest = line.partition(": ")
        body, _, head = rest.partition(" => ")
        patterns = [tuple(map(slot, p.split())) for p in body.split(" . ")]
        out.append(Rule(name, tuple(patterns), tuple(map(slot, head.split()))))
    return out


def owl_rules() -> list[Rule]:
    return [r for r in parse_rules(COMPILED) if not r.name.startswith("sssom")]


def mapping_rules() -> list[Rule]:
    return [r for r in parse_rules(COMPILED) if r.name.startswith("sssom")]
