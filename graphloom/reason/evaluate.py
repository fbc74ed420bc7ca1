"""Rules as joins: one step of a rule over triples, with what changed in one place of its body."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.closure import FEW, light
from ..terms import RDF_TYPE, Var
from .rules import Rule

PREMISE = "struct<s: string, p: string, o: string>"


def pattern(triples: DataFrame, slots: tuple, number: int) -> tuple[DataFrame, dict[str, str]]:
    """The triples that match a body pattern: columns for its variables, and the triple itself as premise ``number``."""
    df, names, conditions = triples, {}, []
    cols: list[Column] = []
    for c, s in zip("spo", slots, strict=True):
        if not isinstance(s, Var):
            conditions.append(F.col(c) == s)
        elif s.name in names:
            conditions.append(F.col(c) == F.col(names[s.name]))
        else:
            names[s.name] = c
            cols.append(F.col(c).alias(f"{number}~{s.name}"))
    if conditions:
        df = df.where(reduce(lambda a, b: a & b, conditions))
    return df.select(*cols, F.struct("s", "p", "o").alias(f"~{number}")), {n: f"{number}~{n}" for n in names}


class Sizes(dict):
    """Triples by predicate and, for ``rdf:type`` with a class that the rules name, by class; other classes are under None."""

    @staticmethod
    def counted(triples: DataFrame, classes: list[str]) -> Sizes:
        kind = F.when((F.col("p") == RDF_TYPE) & F.col("o").isin(classes), F.col("o"))
        return Sizes({(r["p"], r["kind"]): r["n"] for r in triples.groupBy("p", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()})

    def more(self, other: Sizes) -> Sizes:
        return Sizes({k: self.get(k, 0) + other.get(k, 0) for k in self.keys() | other.keys()})

    def of(self, slots: tuple, classes: frozenset[str]) -> int:
        """The most triples that a pattern can match."""
        _, p, o = slots
        if not isinstance(p, Var) and p == RDF_TYPE and not isinstance(o, Var) and o in classes:
            return self.get((p, o), 0)
        return sum(n for (own, _), n in self.items() if isinstance(p, Var) or own == p)


def step(rule: Rule, sources: list[DataFrame], sizes: list[int] | None = None) -> DataFrame:
    """``s, p, o, rule, premises`` of a rule with a source of triples for each pattern.

    Patterns are joined from the first on, always along a shared variable if
    there is one, so that schema patterns narrow what follows. Patterns that match few triples, by
    ``sizes``, are broadcast: a join on the predicate would give one task all triples of it.
    """
    parts = [pattern(t, p, i) for i, (t, p) in enumerate(zip(sources, rule.body, strict=True))]
    if sizes is not None and len(parts) > 1:
        parts = [(F.broadcast(df) if n <= FEW else df, names) for (df, names), n in zip(parts, sizes, strict=True)]
    df, bound = parts[0]
    left = parts[1:]
    while left:
        k = next((i for i, (_, names) in enumerate(left) if set(names) & set(bound)), 0)
        other, names = left.pop(k)
        shared = [n for n in names if n in bound]
        on = [F.col(bound[n]) == F.col(names[n]) for n in shared]
        df = df.join(other, reduce(lambda a, b: a & b, on)) if on else df.crossJoin(other)
        bound = {**names, **bound}
    head = [F.col(bound[s.name]) if isinstance(s, Var) else F.lit(s) for s in rule.head]
    out = df.select(*[c.alias(n) for c, n in zip(head, "spo", strict=True)], F.lit(rule.name).alias("rule"), F.array(*[F.col(f"~{i}") for i in range(len(rule.body))]).alias("premises"))
    return out.where(~F.col("s").startswith('"') & F.col("p").startswith("<"))


def delta_steps(rule: Rule, known: DataFrame, new: DataFrame, dirty: set[str] | None = None, all_sizes: list[int] | None = None, new_sizes: list[int] | None = None) -> list[DataFrame]:
    """What a rule gives with at least one new triple: each place in turn takes the new ones, and the others all.

    With the numbers of triples that each place can match, places without any are left out.
    """
    out = []
    if all_sizes is not None and not all(all_sizes):
        return out
    for i, p in enumerate(rule.predicates):
        if (dirty is None or p is None or p in dirty) and (new_sizes is None or new_sizes[i]):
            sizes = None if all_sizes is None else [new_sizes[k] if k == i else all_sizes[k] for k in range(len(rule.body))]
            out.append(step(rule, [new if k == i else known for k in range(len(rule.body))], sizes))
    return out


def derived_again(rule: Rule, known: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of the wanted facts that a rule gives from what is known: the head is bound to them before the body is joined."""
    if len({s.name for s in rule.head if isinstance(s, Var)} & {s.name for p in rule.body for s in p if isinstance(s, Var)}) == 0:
        return step(rule, [known] * len(rule.body)).join(wanted, ["s", "p", "o"], "left_semi")
    asked = Rule(rule.name, (rule.head, *rule.body), rule.head)
    return step(asked, [wanted, *[known] * len(rule.body)]).select("s", "p", "o", "rule", F.expr("slice(premises, 2, size(premises) - 1)").alias("premises"))


#: Rules whose self-join would list all pairs of a group: the subject that they group by and the member that they make the same.
STARS = {"prp-fp": ("s", "o", "FunctionalProperty"), "prp-ifp": ("o", "s", "InverseFunctionalProperty")}


def star_step(rule: str, known: DataFrame, new: DataFrame, typed: str, kind: str, size: int | None = None) -> DataFrame:
    """What a functional property makes the same, in the groups that something new is in.

    Each member hangs on the least of its group, itself included; the closure of
    ``owl:sameAs`` makes the rest. A hot value of k members gives k rows and not k * k. ``size`` is the number of such properties.
    """
    by, member, _ = STARS[rule]
    props = known.where((F.col("p") == typed) & (F.col("o") == kind)).select(F.col("s").alias("p")).distinct()
    fresh = new.where((F.col("p") == typed) & (F.col("o") == kind)).select(F.col("s").alias("p")).distinct()
    if size is not None:
        props, fresh = light(props, size), light(fresh, size)
    rows = known.join(props, "p", "left_semi").select("s", "p", "o")
    touched = new.join(props, "p", "left_semi").select("p", by).unionByName(rows.join(fresh, "p", "left_semi").select("p", by)).distinct()
    rows = rows.join(touched, ["p", by], "left_semi")
    least = rows.groupBy("p", by).agg(F.min(member).alias("~least"))
    rows = rows.join(least, ["p", by])
    first = F.struct(*[(F.col("~least") if c == member else F.col(c)).alias(c) for c in "spo"])
    premises = F.array(F.struct(F.col("p").alias("s"), F.lit(typed).alias("p"), F.lit(kind).alias("o")), first, F.struct("s", "p", "o"))
    out = rows.select(F.col("~least").alias("~s"), F.col(member).alias("~o"), premises.alias("premises"))
    return out.select(F.col("~s").alias("s"), F.lit("<http://www.w3.org/2002/07/owl#sameAs>").alias("p"), F.col("~o").alias("o"), F.lit(rule).alias("rule"), "premises").where(~F.col("s").startswith('"'))
