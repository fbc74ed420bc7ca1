"""Plans over dictionary ids: patterns are joined on 64-bit ids, and terms come back at the end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .algebra import Dataset
from .mapping import connected, match
from .operators.closure import checkpointed, light
from .operators.joins import Relation
from .plans.values import Val
from .store import QuadGraph, dictionary, encode_ids, hot_terms, looked_up
from .terms import Term, Var


@dataclass(frozen=True)
class _Id:
    """A constant's id, in place of its stored form."""

    stored: int


class IdGraph(QuadGraph):
    """A source of patterns over encoded quads.

    Quads are encoded once and written by ranges of predicate and subject. A pattern's constants are looked up (a few
    rows), joins compare ids, and each variable of the answer is decoded by one join with the dictionary.
    """

    def __init__(self, quads: DataFrame, dataset: Dataset | None = None, strict: bool = False):
        super().__init__(quads, dataset, strict)
        self.terms = checkpointed(dictionary(quads))
        self.encoded = checkpointed(encode_ids(quads, self.terms).repartitionByRange("p", "s").sortWithinPartitions("p", "s"))

    def _ids(self, nodes: set[str]) -> dict[str, int]:
        return {r["term"]: r["id"] for r in self.terms.where(F.col("term").isin(sorted(nodes))).collect()} if nodes else {}

    def _scoped(self, scope: tuple) -> DataFrame:
        """The encoded quads of a scope; graphs are chosen by the ids of their names."""
        names = self.terms.where(F.col("term").startswith("<"))
        chosen = QuadGraph(names.select(F.col("term").alias("g"), F.col("id").alias("s"), F.lit(0).alias("p"), F.lit(0).alias("o")), self.dataset, self.strict)
        if scope[0] == "graph":
            ids = chosen.scope(scope).select(F.col("s").alias("g"))
        elif scope[0] == "var":
            ids = chosen.named().select(F.col("s").alias("g"))
        elif self.dataset.given:
            ids = names.where(F.col("term").isin(self.dataset.default)).select(F.col("id").alias("g"))
        elif self.strict:
            return self.encoded.where("g = 0").select("s", "p", "o")
        else:
            hidden = names.where(F.col("term").startswith("<urn:graphloom:")).select(F.col("id").alias("g"))
            return self.encoded.join(light(hidden, hidden.count()), "g", "left_anti").select("s", "p", "o").distinct()
        ids = ids.distinct()
        found = self.encoded.join(light(ids, ids.count()), "g", "left_semi")
        return found.select("s", "p", "o", "g") if scope[0] == "var" else found.select("s", "p", "o").distinct()

    def bgp_ids(self, patterns: list[tuple], scope: tuple) -> Relation | None:
        """Bindings as ids; ``None`` if a constant is no term of the graph."""
        known = self._ids({n.stored for t in patterns for n in t if isinstance(n, Term)})
        df = self._scoped(scope)
        r = Relation(df, {c: Val("int", F.col(c)) for c in df.columns})
        graph = (Var(scope[1]),) if scope[0] == "var" else ()
        parts = []
        for t in patterns:
            nodes = (*t, *graph)
            if any(isinstance(n, Term) and n.stored not in known for n in nodes):
                return None
            names = dict(zip("spog", nodes, strict=False))
            fixed = {c: known[n.stored] for c, n in names.items() if isinstance(n, Term)}
            rows = df
            for c, i in fixed.items():
                rows = rows.where(F.col(c) == i)
            free = {c: n for c, n in names.items() if isinstance(n, Var)}
            if free:
                only = Relation(rows, {c: r.vals[c] for c in free})
                parts.append(_matched(only, free))
            else:
                parts.append(Relation(rows.limit(1).select(F.lit(1).alias("~unit")), {}))
        return connected(parts, self.spark)

    def bgp(self, patterns: list[tuple], scope: tuple) -> Relation:
        found = self.bgp_ids(patterns, scope)
        if found is None:
            return super().bgp(patterns, scope)
        df, vals = found.df, found.vals
        df = df.select(*[v.col.alias(f"~{i}") for i, v in enumerate(vals.values())] or [F.lit(1).alias("~unit")])
        hot = hot_terms(self.terms) if vals else None
        for i in range(len(vals)):
            df = looked_up(df, f"~{i}", self.terms, "id", "term", hot)
        return Relation.of(df, {n: Val("term", F.col(f"~{i}")) for i, n in enumerate(vals)}) if vals else Relation(df, {})


def _matched(r: Relation, free: dict[str, Var]) -> Relation:
    """One pattern's variables, equal where one stands twice."""
    df, vals = r.df, {}
    for c, node in free.items():
        if node.name in vals:
            df = df.where(vals[node.name].col == F.col(c))
        else:
            vals[node.name] = r.vals[c]
    return Relation.of(df, vals)


__all__ = ["IdGraph", "match"]
