"""Joins of relations, in which an unbound variable matches anything."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import values as V
from ..plans.values import Val, encode


@dataclass
class Relation:
    """Rows of bindings: a frame, and a value for each variable. Unbound is null."""

    df: DataFrame
    vals: dict[str, Val]

    @staticmethod
    def of(df: DataFrame, vals: dict[str, Val], *more: Column) -> Relation:
        """Select values into the columns named after their variables."""
        return Relation(df.select(*[v.col.alias(encode(n)) for n, v in vals.items()], *more), {n: v.at(encode(n)) for n, v in vals.items()})

    def only(self, names: list[str]) -> Relation:
        return Relation.of(self.df, {n: self.vals[n] for n in names if n in self.vals})


def unit(spark) -> Relation:  # noqa: ANN001
    """One row without bindings."""
    return Relation(spark.range(1).select(F.lit(1).alias("~unit")), {})


def _side(r: Relation, tag: str) -> tuple[DataFrame, dict[str, Val]]:
    df = r.df.select(*[r.vals[n].col.alias(f"{tag}{encode(n)}") for n in r.vals] or [F.lit(1).alias(f"{tag}~")])
    return df, {n: replace(v.at(f"{tag}{encode(n)}"), bound=v.bound) for n, v in r.vals.items()}


def merge(left: dict[str, Val], right: dict[str, Val], outer: bool) -> dict[str, Val]:
    """Values of joined rows: the bound side's."""
    out: dict[str, Val] = {}
    for n in dict.fromkeys([*left, *right]):
        if n not in right:
            out[n] = left[n]
        elif n not in left:
            out[n] = right[n].maybe() if outer else right[n]
        elif left[n].bound:
            out[n] = left[n]
        elif right[n].bound and not outer:
            out[n] = right[n]
        else:
            a, b = V.unify(left[n], right[n])
            out[n] = Val(a.kind, F.coalesce(a.col, b.col), a.prefix, bound=False)
    return out


def _agree(a: Val, b: Val) -> Column:
    x, y = V.unify(a, b)
    same = x.col == y.col
    if not a.bound:
        same = same | a.col.isNull()
    if not b.bound:
        same = same | b.col.isNull()
    return same


def join(left: Relation, right: Relation) -> Relation:
    """Inner join on the shared variables.

    Variables bound on both sides are an equi-join. If there are none, but some
    that may be unbound, the rows are split by whether the first such
    variable is bound on either side, so that the part with most rows still
    is an equi-join.
    """
    shared = [n for n in left.vals if n in right.vals]
    sure = [n for n in shared if left.vals[n].bound and right.vals[n].bound]
    open_ = [n for n in shared if n not in sure]
    if not sure and open_:
        name = open_[0]
        parts = []
        for l_bound in (True, False):
            for r_bound in (True, False):
                if not l_bound and left.vals[name].bound or not r_bound and right.vals[name].bound:
                    continue
                a, b = _split(left, name, l_bound), _split(right, name, r_bound)
                parts.append(_joined(a, b, {n for n in shared if n != name or l_bound and r_bound}))
        return reduce(union, parts)
    return _joined(left, right, set(shared))


def _split(r: Relation, name: str, bound: bool) -> Relation:
    col = r.vals[name].col
    kept = r.df.where(col.isNotNull() if bound else col.isNull())
    return Relation(kept, r.vals | {name: replace(r.vals[name], bound=bound)})


def _joined(left: Relation, right: Relation, on: set[str]) -> Relation:
    a, x = _side(left, "l~")
    b, y = _side(right, "r~")
    conditions = [_agree(x[n], y[n]) for n in x if n in y and n in on]
    df = a.join(b, reduce(lambda p, q: p & q, conditions)) if conditions else a.crossJoin(b)
    return Relation.of(df, merge(x, y, outer=False))


def left_join(left: Relation, right: Relation, condition=None) -> Relation:  # noqa: ANN001
    """OPTIONAL: the condition, a function of the merged values, is part of the match.

    If no shared variable is bound on both sides, left rows are split by whether the first that
    may be unbound there is bound, so that those where it is are an equi-join.
    """
    shared = [n for n in left.vals if n in right.vals]
    if any(left.vals[n].bound and right.vals[n].bound for n in shared):
        return _left_joined(left, right, condition, set(shared))
    return _left_split(left, right, condition, [n for n in shared if not left.vals[n].bound and right.vals[n].bound], set(shared))


def _left_split(left: Relation, right: Relation, condition, names: list[str], on: set[str]) -> Relation:  # noqa: ANN001
    if not names:
        return _left_joined(left, right, condition, on)
    name = names[0]
    known = _left_joined(_split(left, name, True), right, condition, on)
    return union(known, _left_split(_split(left, name, False), right, condition, names[1:], on - {name}))


def _left_joined(left: Relation, right: Relation, condition, names: set[str]) -> Relation:  # noqa: ANN001
    a, x = _side(left, "l~")
    b, y = _side(right, "r~")
    b = b.withColumn("r~match", F.lit(True))
    on = [_agree(x[n], y[n]) for n in x if n in y and n in names]
    if condition is not None:
        on.append(condition(merge(x, y, outer=False)))
    df = a.join(b, reduce(lambda p, q: p & q, on, F.lit(True)), "left")
    return Relation.of(df, merge(x, y, outer=True))


#: Keys of the smaller side up to which a join looks them up in the other side's scan.
LOOKUP = 256


def lookup_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """An inner join that reads only the right rows whose key the left has, if its keys are few.

    The left's distinct keys, ``LOOKUP`` of them at most, become a filter that reaches the right's scan;
    if there are more, it is a plain join, and Catalyst chooses how.
    """
    keys = [r[0] for r in left.select(on).where(F.col(on).isNotNull()).distinct().limit(LOOKUP + 1).collect()]
    return left.join(right.where(F.col(on).isin(keys)) if len(keys) <= LOOKUP else right, on)


def union(left: Relation, right: Relation) -> Relation:
    """Rows of both; a variable of one side only is unbound in the other's rows."""
    names = list(dict.fromkeys([*left.vals, *right.vals]))
    a, b = {}, {}
    for n in names:
        x, y = V.unify(left.vals.get(n, V.none()), right.vals.get(n, V.none()))
        bound = n in left.vals and n in right.vals and left.vals[n].bound and right.vals[n].bound
        a[n], b[n] = replace(x, bound=bound), replace(y, bound=bound)
    if not names:
        return Relation(left.df.select(F.lit(1).alias("~unit")).unionAll(right.df.select(F.lit(1).alias("~unit"))), {})
    l, r = Relation.of(left.df, a), Relation.of(right.df, b)
    kinds = {n: v if v.kind != "none" else b[n] for n, v in a.items()}
    return Relation(l.df.unionByName(r.df), {n: replace(v.at(encode(n)), bound=a[n].bound) for n, v in kinds.items()})
