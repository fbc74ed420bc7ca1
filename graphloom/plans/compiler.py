"""From algebra to DataFrames."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import algebra as A
from ..algebra import Refused
from ..operators import closure
from ..operators.joins import Relation, join, left_join, union, unit
from ..terms import Term, Var, iri
from . import values as V
from .expressions import aggregate, sort_keys, truth, value
from .values import Val, encode

#: The scope of patterns: ``("default",)``, ``("graph", stored IRI)`` or ``("var", variable)``.
DEFAULT = ("default",)


class Compiler:
    """Plans over one source, which answers ``bgp(patterns, scope)`` and ``graphs()``."""

    def __init__(self, spark: SparkSession, source: object):
        self.spark, self.source = spark, source
        self.fresh = 0

    def new(self) -> Var:
        self.fresh += 1
        return Var(f".p{self.fresh}")

    def run(self, node: object, scope: tuple = DEFAULT) -> Relation:
        return getattr(self, "on_" + type(node).__name__.lower())(node, scope)

    def on_bgp(self, node: A.Bgp, scope: tuple) -> Relation:
        if node.triples:
            return self.source.bgp(node.triples, scope)
        if scope[0] == "default":
            return unit(self.spark)
        graphs = self.source.graphs()
        if scope[0] == "graph":
            return Relation(graphs.where(F.col("g") == scope[1]).limit(1).select(F.lit(1).alias("~unit")), {})
        return Relation.of(graphs, {scope[1]: Val("term", F.col("g"))})

    def on_join(self, node: A.Join, scope: tuple) -> Relation:
        return join(self.run(node.left, scope), self.run(node.right, scope))

    def on_leftjoin(self, node: A.LeftJoin, scope: tuple) -> Relation:
        condition = (lambda vals: truth(node.condition, vals)) if node.condition is not None else None
        return left_join(self.run(node.left, scope), self.run(node.right, scope), condition)

    def on_filter(self, node: A.Filter, scope: tuple) -> Relation:
        r = self.run(node.inner, scope)
        return Relation(r.df.where(truth(node.condition, r.vals)), r.vals)

    def on_union(self, node: A.Union, scope: tuple) -> Relation:
        return union(self.run(node.left, scope), self.run(node.right, scope))

    def on_graph(self, node: A.Graph, scope: tuple) -> Relation:
        if isinstance(node.name, Term):
            return self.run(node.inner, ("graph", node.name.stored))
        _carried(node.inner, node.name.name)
        return self.run(node.inner, ("var", node.name.name))

    def on_extend(self, node: A.Extend, scope: tuple) -> Relation:
        r = self.run(node.inner, scope)
        v = value(node.expr, r.vals)
        return Relation.of(r.df, r.vals | {node.name: v if v.const is None else replace(v, const=None)})

    def on_values(self, node: A.Values, scope: tuple) -> Relation:
        if not node.names:
            return Relation(self.spark.range(len(node.rows)).select(F.lit(1).alias("~unit")), {})
        rows = [tuple(t.stored if t else None for t in row) for row in node.rows]
        df = self.spark.createDataFrame(rows, ", ".join(f"`{encode(n)}` string" for n in node.names))
        return Relation(df, {n: Val("term", F.col(f"`{encode(n)}`"), bound=all(r[i] is not None for r in rows)) for i, n in enumerate(node.names)})

    def counted(self, node: A.Group, scope: tuple) -> Relation | None:
        """``COUNT`` over all triples, or by predicate, from the source's own counts."""
        inner = node.inner
        if not (isinstance(inner, A.Bgp) and len(inner.triples) == 1 and len(node.aggregates) == 1 and scope[0] != "var"):
            return None
        triple, (name, agg) = inner.triples[0], node.aggregates[0]
        used = [n.name for n in triple if isinstance(n, Var)]
        plain = agg.name == "COUNT" and not agg.distinct and (agg.arg is None or isinstance(agg.arg, A.Ref) and agg.arg.name in used)
        by_predicate = len(node.keys) == 1 and node.keys[0][1] == A.Ref(used[1] if len(used) == 3 else "")
        if not plain or len(set(used)) != 3 or node.keys and not by_predicate:
            return None
        counts = self.source.predicate_counts(scope)
        if node.keys:
            return Relation.of(counts, {node.keys[0][0]: Val("term", F.col("p")), name: Val("int", F.col("n"))})
        return Relation.of(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), {name: Val("int", F.col("n"))})

    def on_group(self, node: A.Group, scope: tuple) -> Relation:
        if (known := self.counted(node, scope)) is not None:
            return known
        r = self.run(node.inner, scope)
        keys = {}
        for name, expr in node.keys:
            v = value(expr, r.vals)
            keys[name] = Val("term", V.stored(v), bound=v.bound) if v.kind == "row" or v.const else v
        made = {name: aggregate(a, r.vals) for name, a in node.aggregates}
        grouped = r.df.groupBy(*[v.col.alias(encode(n)) for n, v in keys.items()])
        if made:
            df = grouped.agg(*[v.col.alias(encode(n)) for n, v in made.items()])
        else:
            df = grouped.agg(F.count(F.lit(1)).alias("~count")).drop("~count")
        return Relation(df, {n: v.at(encode(n)) for n, v in (keys | made).items()})

    def on_project(self, node: A.Project, scope: tuple) -> Relation:
        r = self.run(node.inner, scope)
        if not node.names:
            return r
        return Relation.of(r.df, {n: r.vals.get(n, V.none()) for n in node.names})

    def on_distinct(self, node: A.Distinct, scope: tuple) -> Relation:
        r = self.run(node.inner, scope)
        vals = {n: Val("term", V.stored(v)) if v.kind == "row" else v for n, v in r.vals.items()}
        r = Relation.of(r.df, vals)
        return Relation(r.df.distinct(), r.vals)

    def on_orderby(self, node: A.OrderBy, scope: tuple) -> Relation:
        r = self.run(node.inner, scope)
        return Relation(r.df.orderBy(*[c for e, down in node.keys for c in sort_keys(value(e, r.vals), down)]), r.vals)

    def on_slice(self, node: A.Slice, scope: tuple) -> Relation:
        r = self.run(node.inner, scope)
        # a sort below a projection is kept by Spark only where the limit is right above it
        df = r.df.offset(node.offset) if node.offset else r.df
        return Relation(df.limit(node.limit) if node.limit is not None else df, r.vals)

    # paths

    def on_pathpattern(self, node: A.PathPattern, scope: tuple) -> Relation:
        r = self.path(node.path, node.subject, node.object, scope)
        names = list(dict.fromkeys(n.name for n in (node.subject, node.object) if isinstance(n, Var)))
        if scope[0] == "var":
            names.append(scope[1])
        if not names:
            return Relation(r.df.limit(1).select(F.lit(1).alias("~unit")), {})
        return self.distinct(r.only(names))

    def distinct(self, r: Relation) -> Relation:
        return Relation(r.df.distinct(), r.vals)

    def path(self, path: object, s: object, o: object, scope: tuple) -> Relation:
        if isinstance(path, A.Link):
            return self.source.bgp([(s, path.iri, o)], scope)
        if isinstance(path, A.Inverse):
            return self.path(path.path, o, s, scope)
        if isinstance(path, A.Sequence):
            middle = self.new()
            return join(self.path(path.left, s, middle, scope), self.path(path.right, middle, o, scope))
        if isinstance(path, A.Alternative):
            return union(self.path(path.left, s, o, scope), self.path(path.right, s, o, scope))
        if isinstance(path, A.Negated):
            return self.negated(path, s, o, scope)
        if path.how == "?":
            return self.optional(path, s, o, scope)
        return self.repeated(path, s, o, scope)

    def negated(self, path: A.Negated, s: object, o: object, scope: tuple) -> Relation:
        parts = []
        for iris, a, b in ((path.forward, s, o), (path.backward, o, s)):
            if iris:
                verb = self.new()
                r = self.source.bgp([(a, verb, b)], scope)
                parts.append(Relation(r.df.where(~r.vals[verb.name].col.isin(*[i.stored for i in iris])), r.vals))
        out = parts[0] if len(parts) == 1 else union(*parts)
        return out

    def optional(self, path: A.Repeat, s: object, o: object, scope: tuple) -> Relation:
        step = self.path(path.path, s, o, scope)
        if isinstance(s, Var) and isinstance(o, Var):
            raise Refused("a zero-length path between two variables")
        if isinstance(s, Term) and isinstance(o, Term):
            zero = unit(self.spark)
            return union(step, zero if s == o else Relation(zero.df.limit(0), {}))
        var, term = (s, o) if isinstance(s, Var) else (o, s)
        return union(step, self.on_values(A.Values([var.name], [[term]]), scope))

    def repeated(self, path: A.Repeat, s: object, o: object, scope: tuple) -> Relation:
        """``+`` and ``*``: a fixpoint over the pairs of the inner path, from the ground end if there is one."""
        if scope[0] == "var":
            raise Refused("a repeated path inside GRAPH with a variable")
        a, b = self.new(), self.new()
        inner = self.path(path.path, a, b, scope)
        x, y = V.unify(inner.vals[a.name], inner.vals[b.name])
        edges = inner.df.select(x.col.alias("src"), y.col.alias("dst"))
        x, y = x.at("src"), y.at("dst")
        star = path.how == "*"
        if isinstance(s, Term):
            start = self.spark.range(1).select(self.ground(s, x).alias("src"))
            found = closure.transitive(edges, start, star, target=self.ground(o, y) if isinstance(o, Term) else None)
        elif isinstance(o, Term):
            start = self.spark.range(1).select(self.ground(o, x).alias("src"))
            back = closure.transitive(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, star)
            found = back.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        else:
            found = closure.transitive(edges, None, star)
        vals: dict[str, Val] = {}
        for node, v in ((s, x), (o, y)):
            if isinstance(node, Term):
                found = found.where(v.col == self.ground(node, v))
            elif node.name in vals:
                found = found.where("src = dst")
            else:
                vals[node.name] = v
        return Relation.of(found, vals) if vals else Relation(found.select(F.lit(1).alias("~unit")), {})

    @staticmethod
    def ground(term: Term, v: Val) -> Column:
        """A constant in a value's representation."""
        from .expressions import _native

        native = _native(term, v)
        return native if native is not None else F.lit(None)


def _carried(node: object, name: str) -> None:
    """Refuse, inside GRAPH with a variable, forms that would need the graph one by one."""
    if isinstance(node, (A.Project, A.Distinct, A.Slice, A.Group, A.Graph, A.Values)):
        raise Refused(f"{type(node).__name__} inside GRAPH with a variable")
    if isinstance(node, A.PathPattern):
        raise Refused("a property path inside GRAPH with a variable")
    if isinstance(node, (A.Filter, A.LeftJoin)) and node.condition is not None and name in A.mentioned(node.condition):
        raise Refused(f"?{name} in a condition inside its GRAPH")
    if isinstance(node, A.Extend) and name in A.mentioned(node.expr):
        raise Refused(f"?{name} in BIND inside its GRAPH")
    for child in ("left", "right", "inner"):
        if hasattr(node, child):
            _carried(getattr(node, child), name)


def describe(source: object, targets: list[Term], resources: DataFrame | None) -> DataFrame:
    """``s, p, o`` of the triples whose subject is a target or one of ``resources(s)``, distinct and in order."""
    p, o = Var("p"), Var("o")
    parts = []
    for t in targets:
        r = source.bgp([(t, p, o)], DEFAULT)
        parts.append(r.df.select(F.lit(t.stored).alias("s"), *[V.stored(r.vals[n]).alias(n) for n in "po"]))
    if resources is not None:
        r = source.triples_of(resources.distinct())
        parts.append(r.df.select(*[V.stored(r.vals[n]).alias(n) for n in "spo"]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct().orderBy("s", "p", "o")


def construct(r: Relation, template: list[tuple]) -> DataFrame:
    """``s, p, o`` of the template for each row; rows with an unbound node are left out for that triple."""
    parts = []
    for triple in template:
        cols = []
        for name, node in zip("spo", triple, strict=True):
            if isinstance(node, Term):
                cols.append(F.lit(node.stored).alias(name))
            elif node.name in r.vals:
                cols.append(V.stored(r.vals[node.name]).alias(name))
            else:
                cols.append(F.lit(f"_:{node.name.strip('.')}" if node.name.startswith(".b") else None).cast("string").alias(name))
        parts.append(r.df.select(*cols).where("s is not null and p is not null and o is not null and p like '<%' and s not like '\"%'"))
    if not parts:
        return r.df.sparkSession.createDataFrame([], "s string, p string, o string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def output(r: Relation, names: list[str]) -> DataFrame:
    """Result columns under their variables' names; native where the kind is known."""
    return r.df.select(*[V.output(r.vals.get(n, V.none())).alias(n) for n in names])


__all__ = ["Compiler", "DEFAULT", "construct", "describe", "iri", "output"]
