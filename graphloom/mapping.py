"""Relational tables as a virtual graph.

A row is a subject, an IRI of the table's name and the key; a column is a
predicate and its value a literal, or the IRI of the row that a foreign key
points at; ``rdf:type`` is the table. Nothing is materialised: patterns that share a
subject are one scan of the columns that they name (a null has no triple), joined
with others on native keys. A table without a key has blank nodes for
subjects, one for each row. Only a variable predicate unpivots columns.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .algebra import Refused
from .operators.joins import Relation, join, unit
from .plans import values as V
from .plans.expressions import equal
from .plans.values import Val
from .terms import RDF_TYPE, Term, Var

_KINDS = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "double", "float": "double", "string": "str", "timestamp": "time", "timestamp_ntz": "time", "boolean": "bool"}


@dataclass(frozen=True)
class Table:
    """A table's key column, or None, and the tables that its foreign keys point at."""

    name: str
    key: str | None
    foreign: Mapping[str, str] = field(default_factory=dict)


class MappedGraph:
    """Tables behind ``read(name)``, as one default graph."""

    def __init__(self, spark: SparkSession, tables: list[Table], read: Callable[[str], DataFrame], base: str):
        self.spark, self.read, self.base = spark, read, base
        self.tables = {t.name: t for t in tables}
        self._frames: dict[str, DataFrame] = {}
        self._columns: dict[str, list[str]] | None = None
        self._counts: list[tuple[str, int]] | None = None

    def frame(self, name: str) -> DataFrame:
        """A table's columns that are terms: dates are times and decimals doubles; others are named in a warning."""
        if name not in self._frames:
            df = self.read(name)
            cols, left = [], []
            for c, kind in df.dtypes:
                col = F.col(f"`{c}`")
                if kind in _KINDS:
                    cols.append(col)
                elif kind == "date":
                    cols.append(col.cast("timestamp").alias(c))
                elif kind.startswith("decimal"):
                    cols.append(col.cast("double").alias(c))
                else:
                    left.append(f"{c} {kind}")
            if left:
                warnings.warn(f"table {name}: no terms for {', '.join(left)}", stacklevel=2)
            self._frames[name] = df.select(*cols)
        return self._frames[name]

    def columns(self) -> dict[str, list[str]]:
        """The tables that have each column; a column of several is named ``table.column``."""
        if self._columns is None:
            self._columns = {}
            for name in self.tables:
                for c in self.frame(name).columns:
                    self._columns.setdefault(c, []).append(name)
                    self._columns[f"{name}.{c}"] = [name]
        return self._columns

    def _column(self, table: Table, column: str) -> Val:
        kind = dict(self.frame(table.name).dtypes)[column]
        if column in table.foreign:
            return Val("key", F.col(f"`{column}`").cast("long"), f"{self.base}{table.foreign[column]}/")
        col = F.col(f"`{column}`")
        return Val(_KINDS[kind], col.cast("long") if _KINDS[kind] == "int" else col)

    def _subject(self, table: Table) -> Val:
        if table.key:
            return Val("key", F.col(f"`{table.key}`").cast("long"), f"{self.base}{table.name}/")
        return Val("row", F.struct(F.lit(table.name).alias("~table"), *[F.col(f"`{c}`") for c in self.frame(table.name).columns]))

    def _table_of(self, star: list[tuple]) -> list[Table]:
        """The tables that can hold a star."""
        found: set[str] | None = None
        for s, p, o in star:
            if p.stored == RDF_TYPE:
                if not isinstance(o, Term):
                    continue
                own = {o.value.removeprefix(self.base)} & set(self.tables)
            else:
                own = set(self.columns().get(p.value.removeprefix(self.base), [])) if p.value.startswith(self.base) else set()
            found = own if found is None else found & own
        names = set(self.tables) if found is None else found
        if isinstance(star[0][0], Term):
            names = {n for n in names if star[0][0].value.startswith(f"{self.base}{n}/")}
        return [self.tables[n] for n in sorted(names)]

    def _star(self, table: Table, star: list[tuple]) -> Relation:
        df, vals = self.frame(table.name), {}
        subject = self._subject(table)
        node = star[0][0]
        conditions = []
        if isinstance(node, Term):
            conditions.append(equal(subject, V.constant(node)))
        else:
            vals[node.name] = subject
        for _, p, o in star:
            if p.stored == RDF_TYPE:
                if isinstance(o, Var):
                    vals[o.name] = V.constant(Term("iri", self.base + table.name))
                continue
            v = self._column(table, p.value.removeprefix(self.base).rpartition(".")[2])
            if isinstance(o, Var):
                conditions.append(v.col.isNotNull())
                if o.name in vals:
                    conditions.append(equal(vals[o.name], v))
                else:
                    vals[o.name] = v
            else:
                conditions.append(equal(v, V.constant(o)))
        if conditions:
            df = df.where(reduce(lambda a, b: a & b, conditions))
        return Relation.of(df, vals) if vals else Relation(df.limit(1).select(F.lit(1).alias("~unit")), {})

    def _cells(self, table: Table, df: DataFrame) -> DataFrame:
        """The triples of rows of a table, as stored terms under ``s, p, o``."""
        cells = [F.struct(F.lit(RDF_TYPE).alias("p"), F.lit(f"<{self.base}{table.name}>").alias("o"))]
        for c in self.frame(table.name).columns:
            name = c if len(self.columns()[c]) == 1 else f"{table.name}.{c}"
            cells.append(F.struct(F.lit(f"<{self.base}{name}>").alias("p"), V.stored(self._column(table, c)).alias("o")))
        return df.select(V.stored(self._subject(table)).alias("s"), F.inline(F.array(*cells))).where("o is not null")

    def _relation(self, parts: list[DataFrame]) -> Relation:
        df = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "s string, p string, o string")
        return Relation(df, {n: Val("term", F.col(n)) for n in "spo"})

    def triples(self, subject: object = None, tables: list[Table] | None = None) -> Relation:
        """All triples, of a ground subject or of some tables if given: the way of a variable predicate.

        A ground subject is a row of one table, found by its key in the scan.
        """
        if not isinstance(subject, Term):
            return self._relation([self._cells(t, self.frame(t.name)) for t in (self.tables.values() if tables is None else tables)])
        own = [t for t in self.tables.values() if t.key and subject.value.startswith(f"{self.base}{t.name}/")]
        return self._relation([self._cells(t, self.frame(t.name).where(equal(self._subject(t), V.constant(subject)))) for t in own])

    def triples_of(self, resources: DataFrame) -> Relation:
        """The triples whose subject is in column ``s``: only tables that have one are read, and by key."""
        kind = F.regexp_extract("s", f"^<{re.escape(self.base)}([^/]+)/[^/]*>$", 1)
        rows = resources.select("s", F.when(F.col("s").startswith("_:"), "_:").otherwise(kind).alias("kind")).where("kind <> ''")
        found = {r["kind"] for r in rows.select("kind").distinct().collect()}  # as many as there are tables
        parts = []
        for t in self.tables.values():
            if t.key and t.name in found:
                key = F.regexp_extract("s", "/([^/]*)>$", 1).try_cast("long")
                keys = rows.where(F.col("kind") == t.name).select(key.alias("~key")).distinct()
                parts.append(self._cells(t, self.frame(t.name).join(keys, F.col(f"`{t.key}`").cast("long") == F.col("~key"), "left_semi")))
            elif not t.key and "_:" in found:
                parts.append(self._cells(t, self.frame(t.name)).join(resources.select("s").distinct(), "s", "left_semi"))
        return self._relation(parts)

    def predicate_counts(self, scope: tuple) -> DataFrame:
        """``p, n``: the triples of each predicate, from counts of values that leave nothing to unpivot but a row a table.

        They are counted once and kept, a row for each predicate: a mapping's tables don't change while it lasts.
        """
        if scope[0] != "default":
            raise Refused("mapped tables are the default graph")
        if self._counts is None:
            parts = []
            for table in self.tables.values():
                df = self.frame(table.name)
                names = [c if len(self.columns()[c]) == 1 else f"{table.name}.{c}" for c in df.columns]
                counts = df.agg(F.count(F.lit(1)).alias("~rows"), *[F.count(f"`{c}`").alias(c) for c in df.columns])
                cells = [F.struct(F.lit(RDF_TYPE).alias("p"), F.col("~rows").alias("n"))]
                cells += [F.struct(F.lit(f"<{self.base}{n}>").alias("p"), F.col(f"`{c}`").alias("n")) for n, c in zip(names, df.columns, strict=True)]
                parts.append(counts.select(F.inline(F.array(*cells))))
            total = reduce(DataFrame.unionByName, parts).groupBy("p").agg(F.sum("n").alias("n")).where("n > 0")
            self._counts = [(r["p"], r["n"]) for r in total.collect()]
        return self.spark.createDataFrame(self._counts, "p string, n long")

    def graphs(self) -> DataFrame | None:
        return None

    def bgp(self, patterns: list[tuple], scope: tuple) -> Relation:
        if scope[0] == "graph" or scope[0] == "var":
            raise Refused("mapped tables are the default graph")
        stars: dict[object, list[tuple]] = {}
        parts: list[Relation] = []
        for t in patterns:
            if isinstance(t[1], Var):
                same = [x for x in patterns if x[0] == t[0] and not isinstance(x[1], Var)]
                parts.append(match(self.triples(t[0], self._table_of(same) if same and isinstance(t[0], Var) else None), t))
            else:
                stars.setdefault(t[0], []).append(t)
        for star in stars.values():
            tables = self._table_of(star)
            if tables:
                from .operators.joins import union

                parts.append(reduce(union, [self._star(t, star) for t in tables]))
            else:
                names = [n.name for t in star for n in t if isinstance(n, Var)]
                df = self.spark.createDataFrame([], "x string")
                parts.append(Relation.of(df, {n: Val("term", F.col("x")) for n in names}, F.lit(1).alias("~unit")))
        return connected(parts, self.spark)


def match(triples: Relation, pattern: tuple) -> Relation:
    """One pattern over frame columns ``s, p, o`` (and ``g``, if the pattern has four nodes)."""
    df, vals = triples.df, {}
    for name, node in zip("spog", pattern, strict=False):
        v = triples.vals[name]
        if isinstance(node, Term):
            df = df.where(v.col == node.stored)
        elif node.name in vals:
            df = df.where(vals[node.name].col == v.col)
        else:
            vals[node.name] = v
    return Relation.of(df, vals) if vals else Relation(df.limit(1).select(F.lit(1).alias("~unit")), {})


def connected(parts: list[Relation], spark: SparkSession) -> Relation:
    """Join the parts in order, but each next one with a variable in common if there is one."""
    if not parts:
        return unit(spark)
    out, rest = parts[0], parts[1:]
    while rest:
        k = next((i for i, r in enumerate(rest) if set(r.vals) & set(out.vals)), 0)
        out = join(out, rest.pop(k))
    return out
