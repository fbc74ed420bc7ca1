"""Materialisation: rules, lists and closures to a fixpoint, semi-naive, with a derivation for each fact."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.closure import GUARD, checkpointed, components, together, transitive
from ..terms import OWL, RDF_TYPE, RDFS, XSD, is_literal
from . import datatypes
from .evaluate import PREMISE, STARS, Sizes, delta_steps, star_step
from .lists import LISTED, collections, list_rules
from .rules import CLOSED, Rule, owl_rules

SAME, TRANSITIVE, NOTHING = f"<{OWL}sameAs>", f"<{OWL}TransitiveProperty>", f"<{OWL}Nothing>"
FACT = f"s string, p string, o string, rule string, premises array<{PREMISE}>"


@dataclass
class Materialised:
    """Facts with the rule and premises of one derivation; asserted facts have none."""

    facts: DataFrame
    rounds: int
    added: list[int] = field(default_factory=list)

    @property
    def triples(self) -> DataFrame:
        return self.facts.select("s", "p", "o")

    @property
    def inferred(self) -> DataFrame:
        return self.facts.where(F.col("rule").isNotNull())

    def faults(self) -> DataFrame:
        """What is in ``owl:Nothing``."""
        return self.facts.where((F.col("p") == RDF_TYPE) & (F.col("o") == NOTHING)).select("s").distinct()

    def consistent(self) -> bool:
        return self.faults().isEmpty()

    def entails(self, conclusion: list[tuple[str, str, str]]) -> bool:
        """Whether every triple is there; a blank node matches anything, each triple by itself. One scan looks for all."""
        if not conclusion:
            return True
        tests = []
        for triple in conclusion:
            own = [F.col(c) == term for c, term in zip("spo", triple, strict=True) if not term.startswith("_:")]
            tests.append(F.coalesce(F.bool_or(reduce(lambda a, b: a & b, own, F.lit(True))), F.lit(False)))
        return all(self.triples.agg(*[t.alias(f"t{i}") for i, t in enumerate(tests)]).first())

    def proof(self, triple: tuple[str, str, str]) -> dict:
        """The tree of a fact's derivation: asserted facts are leaves, and a fact above itself is cut.

        The premises of a level are fetched together, so there are as many scans as the tree is deep.
        """
        known: dict[tuple, object] = {}
        wanted = {triple}
        while wanted:
            rows = self.facts.sparkSession.createDataFrame(sorted(wanted), "s string, p string, o string")
            found = {(r["s"], r["p"], r["o"]): r for r in self.facts.join(F.broadcast(rows), ["s", "p", "o"], "left_semi").collect()}
            known |= {t: found.get(t) for t in wanted}
            wanted = {tuple(x) for r in found.values() for x in r["premises"] or []} - set(known)

        def tree(fact: tuple, seen: frozenset) -> dict:
            row = known[fact]
            if fact in seen:
                return {"fact": fact, "cycle": True}
            if row is None:
                return {"fact": fact, "missing": True}
            if row["rule"] is None:
                return {"fact": fact, "asserted": True}
            return {"fact": fact, "rule": row["rule"], "premises": [tree(tuple(x), seen | {fact}) for x in row["premises"] or []]}

        return tree(triple, frozenset())


def _none(df: DataFrame) -> DataFrame:
    return df.select("s", "p", "o", "rule", F.lit(None).cast(f"array<{PREMISE}>").alias("premises"))


def _pairs(triples: DataFrame, p: str) -> DataFrame:
    return triples.where(F.col("p") == p).select(F.col("s").alias("src"), F.col("o").alias("dst"))


def _closures(known: DataFrame, dirty: set[str], closed: dict[str, str], pairs: bool = True, sizes: Sizes | None = None) -> list[DataFrame]:
    """Transitive predicates and, unless classes are kept apart, all pairs of ``owl:sameAs``, where they changed."""
    out = []

    def facts(pairs: DataFrame, p: str, rule: str) -> DataFrame:
        return pairs.select(F.col("src").alias("s"), F.lit(p).alias("p"), F.col("dst").alias("o"), F.lit(rule).alias("rule"))

    for rule, name in closed.items():
        p = f"<{name}>"
        if p in dirty:
            out.append(facts(transitive(_pairs(known, p)), p, rule))
    if SAME in dirty and pairs:
        classes = components(_pairs(known, SAME))
        both = classes.select(F.col("node").alias("src"), "canon").join(classes.select(F.col("node").alias("dst"), "canon"), "canon")
        out.append(facts(both.select("src", "dst"), SAME, "eq-trans"))
    if sizes is not None and not sizes.get((RDF_TYPE, TRANSITIVE)):
        return out
    declared = [r["s"] for r in known.where((F.col("p") == RDF_TYPE) & (F.col("o") == TRANSITIVE)).select("s").distinct().collect()]
    for p in declared:
        if p in dirty or RDF_TYPE in dirty:
            out.append(facts(transitive(_pairs(known, p)), p, "prp-trp"))
    return out


def fixpoint(asserted: DataFrame, rules: list[Rule], closed: dict[str, str] | None = None, lists: bool = False, pairs: bool = True) -> Materialised:
    """All that follows. Each round joins what is new with all that is known, for the rules whose predicates changed.

    What was inferred is written beside the asserted facts, and put together with them only when it has
    as many rows, so all facts are rewritten a logarithmic number of times and a plan reads two
    parts. The set of predicates is carried along, so no round reads all facts for it.
    """
    closed = closed or {}
    base = asserted.select("s", "p", "o").distinct().select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast(f"array<{PREMISE}>").alias("premises"))
    new = checkpointed(base)
    parts, rounds, added = [new], 0, []
    rows, more = new.count(), 0
    present: set[str] = set()
    kinds = {name: f"<{OWL}{kind}>" for name, (_, _, kind) in STARS.items()}
    classes = frozenset({p[2] for r in rules for p in r.body if isinstance(p[2], str) and p[1] == RDF_TYPE} | set(kinds.values()) | {TRANSITIVE})
    known_sizes = Sizes()
    cells = collections(new) if lists else None
    while rounds < GUARD:
        new_sizes = Sizes.counted(new, sorted(classes))
        known_sizes = known_sizes.more(new_sizes)
        dirty = {p for p, _ in new_sizes}
        present |= dirty
        facts = together(parts)
        if not dirty:
            return Materialised(facts, rounds, added)
        triples, delta = facts.select("s", "p", "o"), new.select("s", "p", "o")
        made = []
        for rule in rules:
            if rule.name in STARS:
                size = known_sizes.get((RDF_TYPE, kinds[rule.name]), 0)
                if size:
                    made.append(star_step(rule.name, triples, delta, RDF_TYPE, kinds[rule.name], size))
            elif all(p is None or p in present for p in rule.predicates):
                made += delta_steps(rule, triples, delta, dirty, *[[sizes.of(p, classes) for p in rule.body] for sizes in (known_sizes, new_sizes)])
        made += [_none(f) for f in _closures(triples, dirty, closed, pairs, known_sizes)]
        if cells is not None:
            if dirty & set(LISTED) and rounds:
                cells = collections(facts)
            made += [_none(f) for f in list_rules(triples, checkpointed(cells) if not rounds else cells)]
        if not made:
            return Materialised(facts, rounds, added)
        found = reduce(DataFrame.unionByName, made).groupBy("s", "p", "o").agg(F.min(F.struct("rule", "premises")).alias("by"))
        fresh = found.join(triples, ["s", "p", "o"], "left_anti").select("s", "p", "o", "by.rule", "by.premises")
        new = checkpointed(fresh)
        added.append(new.count())
        rounds += 1
        if not added[-1]:
            return Materialised(facts, rounds, added)
        more += added[-1]
        if more > rows:
            parts, rows, more = [checkpointed(together([*parts, new]))], rows + more, 0
        else:
            parts = [parts[0], checkpointed(together([*parts[1:], new])) if len(parts) > 1 else new]
    raise RuntimeError("the rules did not settle")


def rematerialised(done: Materialised, rules: list[Rule], closed: dict[str, str] | None = None, lists: bool = False) -> Materialised:
    """Drop all that was inferred and infer again, from the asserted facts alone."""
    return fixpoint(done.facts.where(F.col("rule").isNull()), rules, closed, lists)


@dataclass
class Folded:
    """Facts over one term for each ``owl:sameAs`` class, and the classes as ``node, canon``."""

    facts: DataFrame
    classes: DataFrame
    folds: int

    def expanded(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """``s, p, o`` with each term replaced by each member of its class, of the facts that a pattern asks for."""
        out = self.facts.select("s", "p", "o")
        for c, wanted in (("s", s), ("p", p), ("o", o)):
            own = self.classes.select(F.col("canon").alias(c), F.col("node").alias(f"~{c}"))
            if wanted is not None:
                out = out.join(own.where(F.col(f"~{c}") == wanted).select(c).unionByName(out.where(F.col(c) == wanted).select(c)).distinct(), c, "left_semi").withColumn(c, F.lit(wanted))
            else:
                out = out.join(own, c, "left").withColumn(c, F.coalesce(f"~{c}", c)).drop(f"~{c}")
        return out.select("s", "p", "o").distinct()


def folded(triples: DataFrame, rules: list[Rule] | None = None, closed: dict[str, str] | None = None, lists: bool = False) -> Folded:
    """Materialisation that keeps ``owl:sameAs`` as classes.

    Terms are replaced by the least of their class before the rules run, so neither the pairs of a
    class nor the copies of its facts are ever listed, and the rules of replacement have nothing to do; what the rules find to be
    the same is folded in turn, until nothing is.
    """
    rules = [r for r in (owl_rules() if rules is None else rules) if not r.name.startswith("eq-rep")]
    links = checkpointed(_pairs(triples, SAME).where("src <> dst").distinct())
    for folds in range(1, GUARD):
        classes = checkpointed(components(links))
        out = fixpoint(_replaced(triples.where(F.col("p") != SAME), classes), rules, closed, lists, pairs=False)
        found = checkpointed(_pairs(out.triples, SAME).where("src <> dst").distinct())
        if found.isEmpty():
            return Folded(out.facts.where(F.col("p") != SAME), classes, folds)
        links = checkpointed(links.unionByName(found).distinct())
    raise RuntimeError("the classes did not settle")


def extents(triples: DataFrame) -> DataFrame:
    """``eq-rep-p`` by classes of predicates: every member of a class has the union of their extents."""
    classes = components(_pairs(triples, SAME))
    members = classes.select(F.col("node").alias("p"), "canon")
    union_ = triples.join(members, "p").select("canon", "s", "o").distinct()
    return union_.join(classes.select("canon", F.col("node").alias("p")), "canon").select("s", "p", "o").join(triples, ["s", "p", "o"], "left_anti")


def materialise(triples: DataFrame, rules: list[Rule] | None = None, lists: bool = True, literals: bool = True) -> Materialised:
    """OWL 2 RL over the triples of a graph.

    Literals of one value are the same and ill-typed ones are in ``owl:Nothing``;
    after the fixpoint, ranges that follow from several ranges are added and
    derived memberships of literals checked, and the rules run again if either
    gave something.
    """
    spark = triples.sparkSession
    rules = owl_rules() if rules is None else rules
    start = triples.select("s", "p", "o").where(~F.col("s").startswith('"'))
    individuals = start.where((F.col("p") == RDF_TYPE) & (F.col("o") == f"<{OWL}NamedIndividual>")).select("s", "p", F.lit(f"<{OWL}Thing>").alias("o"))
    start = start.unionByName(individuals)
    if literals:
        start = start.unionByName(datatypes.axioms(spark))
        same, bad = datatypes.literal_facts(start)
        start = start.unionByName(same).unionByName(bad)
    closed = {k: v for k, v in CLOSED.items() if not k.startswith("sssom") or any(r.name.startswith("sssom") for r in rules)}
    out = fixpoint(start, rules, closed, lists)
    for _ in range(len(datatypes.INTEGERS)):
        if not literals:
            break
        ranges: dict[str, list[str]] = {}
        known = out.triples.where((F.col("p") == f"<{RDFS}range>") & F.col("o").startswith(f"<{XSD}"))
        for r in known.distinct().collect():
            ranges.setdefault(r["s"], []).append(r["o"][len(XSD) + 1 : -1])
        extra = [(p, f"<{RDFS}range>", o) for p, o in datatypes.narrowed_ranges(ranges)]
        found = datatypes.membership_faults(out.triples).unionByName(datatypes.literal_differences(out.triples).select("s", "p", "o"))
        faults = found.distinct().join(out.triples, ["s", "p", "o"], "left_anti")
        if extra:
            faults = faults.unionByName(spark.createDataFrame(extra, "s string, p string, o string"))
        faults = checkpointed(faults)
        if faults.isEmpty():
            break
        out = fixpoint(start.unionByName(faults), rules, closed, lists)
        start = start.unionByName(faults)
    return out


def canonical(triples: DataFrame) -> DataFrame:
    """Triples with each term replaced by the least of its ``owl:sameAs`` class, which are far fewer than the substituted ones."""
    return _replaced(triples.where(F.col("p") != SAME), components(_pairs(triples, SAME)))


def _replaced(triples: DataFrame, classes: DataFrame) -> DataFrame:
    out = triples
    for c in "spo":
        known = classes.select(F.col("node").alias(c), F.col("canon").alias(f"~{c}"))
        out = out.join(known, c, "left").withColumn(c, F.coalesce(f"~{c}", c)).drop(f"~{c}")
    return out.select("s", "p", "o").distinct()


__all__ = ["Folded", "Materialised", "canonical", "extents", "fixpoint", "folded", "is_literal", "materialise", "rematerialised"]
