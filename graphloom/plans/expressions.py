"""Expressions over values.

Truth has two values: an error or an unbound operand is false at every boolean
node, so ``!`` of an error is true. A filter drops rows that are null or
false alike, so conditions are made null-safe only below a negation, and bare
comparisons reach the scan. Equality is that of terms, ``IN`` and the orders are
by value: numbers if both sides read as numbers, else text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import algebra as A
from .. import terms as T
from ..algebra import Refused
from . import values as V
from .values import Val

Env = dict[str, Val]


def no() -> Column:
    return F.lit(False)


def boolean(col: Column) -> Val:
    return Val("bool", col, bound=False)


def text(col: Column) -> Val:
    return Val("str", col, bound=False)


def num(col: Column) -> Val:
    return Val("num", col, bound=False)


# truth


def truth(expr: A.Expr, env: Env) -> Column:
    """Effective boolean value; null for false is allowed."""
    if isinstance(expr, A.Call):
        if expr.name == "&&":
            return truth(expr.args[0], env) & truth(expr.args[1], env)
        if expr.name == "||":
            return strict(expr.args[0], env) | strict(expr.args[1], env)
        if expr.name == "!":
            return ~strict(expr.args[0], env)
    return ebv(value(expr, env))


def strict(expr: A.Expr, env: Env) -> Column:
    """The same with false for null."""
    return F.coalesce(truth(expr, env), no())


def ebv(v: Val) -> Column:
    if v.kind == "bool":
        return v.col
    if v.kind in V.NATIVE_NUMBERS:
        n = v.col.cast("double")
        return (n != 0) & ~F.isnan(n)
    if v.kind == "str":
        return F.length(v.col) > 0
    if v.kind == "term":
        lexical, behind = V.lex(v), T.suffix(v.col)
        n = T.number_of(lexical)
        return F.when(
            T.is_literal(v.col),
            F.when(behind == f"^^<{T.BOOLEAN}>", lexical.isin("true", "1"))
            .when(behind.isin(*[f"^^<{d}>" for d in T.NUMERIC]), F.coalesce((n != 0) & ~F.isnan(n), no()))
            .when((behind == "") | behind.startswith("@"), F.length(lexical) > 0),
        )
    return no()


# comparison


def equal(a: Val, b: Val) -> Column:
    """Equality of terms; two unbound values are equal."""
    if a.const and b.const:
        return F.lit(a.const == b.const)
    if a.const:
        a, b = b, a
    if b.const:
        native = _native(b.const, a)
        if native is not None:
            return F.coalesce(a.col == native, no()) if not a.bound else a.col == native
        if a.kind in ("key", "row", "str", "int", "bool", "time"):
            return no()
    if {a.kind, b.kind} <= {"int", "num"} and a.kind != b.kind:
        return a.col.cast("double").eqNullSafe(b.col.cast("double"))
    x, y = V.unify(a, b)
    return x.col == y.col if x.bound and y.bound else x.col.eqNullSafe(y.col)


def _native(term: T.Term, v: Val) -> Column | None:
    """The constant as a native column of the value's kind, if it is of that kind and canonical."""
    if v.kind == "term":
        return F.lit(term.stored)
    if v.kind == "key" and term.kind == "iri" and term.value.startswith(v.prefix):
        return F.lit(term.value[len(v.prefix) :]).try_cast("long")
    if term.kind == "literal":
        if v.kind == "str" and not term.lang and term.datatype in ("", T.STRING):
            return F.lit(term.value)
        if v.kind == "int" and term.datatype == T.INTEGER and re.fullmatch("0|-?[1-9][0-9]*", term.value):
            return F.lit(int(term.value))
        if v.kind == "bool" and term.datatype == T.BOOLEAN and term.value in ("true", "false"):
            return F.lit(term.value == "true")
        if v.kind == "time" and term.datatype == T.DATE_TIME and (t := _time(term.value)):
            return F.lit(t)
        if v.kind == "num" and term.datatype in (T.INTEGER, T.DECIMAL):
            return F.lit(float(term.value)) if (float(term.value) == int(float(term.value))) == (term.datatype == T.INTEGER) else None
    return None


def _time(lexical: str) -> datetime | None:
    """A date and time that sorts as its text does."""
    return datetime.fromisoformat(lexical) if re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d", lexical) else None


def ordered(op: str, a: Val, b: Val) -> Column:
    """An order, or ``=`` by value; null if a side is unbound."""
    test = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y, "=": lambda x, y: x == y}[op]
    for x, y, swapped in ((a, b, False), (b, a, True)):
        if x.kind == "time" and y.const and (t := _time(y.const.value)):
            return test(F.lit(t), x.col) if swapped else test(x.col, F.lit(t))
    if a.kind == b.kind == "time" or a.kind == b.kind == "int":
        return test(a.col, b.col)
    known = V.is_number(a), V.is_number(b)
    if known == (True, True):
        return test(V.number(a), V.number(b))
    if False in known:
        return test(V.lex(a), V.lex(b))
    x, y = V.number(a), V.number(b)
    return F.when(x.isNotNull() & y.isNotNull(), test(x, y)).otherwise(test(V.lex(a), V.lex(b)))


# values


def value(expr: A.Expr, env: Env) -> Val:
    if isinstance(expr, A.Const):
        return V.constant(expr.term)
    if isinstance(expr, A.Ref):
        return env.get(expr.name, V.none())
    if isinstance(expr, A.In):
        return boolean(_member(expr, env))
    if isinstance(expr, A.Aggregate):
        raise Refused("an aggregate inside an expression that isn't one of a group")
    name, args = expr.name, expr.args
    if name in ("&&", "||", "!"):
        return boolean(strict(expr, env))
    if name in ("=", "!="):
        _arity(name, args, 2, 2)
        same = equal(value(args[0], env), value(args[1], env))
        return boolean(same if name == "=" else ~same)
    if name in ("<", ">", "<=", ">="):
        return boolean(ordered(name, value(args[0], env), value(args[1], env)))
    if name in ("+", "-", "*", "/", "neg", "pos"):
        return num(_arithmetic(name, [V.number(value(a, env)) for a in args]))
    if name == "IF":
        _arity(name, args, 3, 3)
        a, b = V.unify(value(args[1], env), value(args[2], env))
        return Val(a.kind, F.when(strict(args[0], env), a.col).otherwise(b.col), a.prefix, bound=False)
    if name == "COALESCE":
        out = [value(a, env) for a in args] or [V.none()]
        first = out[0]
        for other in out[1:]:
            x, y = V.unify(first, other)
            first = Val(x.kind, F.coalesce(x.col, y.col), x.prefix, bound=False)
        return first
    if name == "BOUND":
        if len(args) != 1 or not isinstance(args[0], A.Ref):
            raise Refused("BOUND takes a variable")
        return boolean(value(args[0], env).col.isNotNull())
    least, most, make = BUILT_IN[name]
    _arity(name, args, least, most)
    return make(*[value(a, env) for a in args])


def _arity(name: str, args: tuple, least: int, most: int | None) -> None:
    if len(args) < least or most is not None and len(args) > most:
        raise Refused(f"{name} of {len(args)} arguments")


def _member(expr: A.In, env: Env) -> Column:
    left = value(expr.value, env)
    hits = []
    for item in expr.items:
        right = value(item, env)
        hit = ordered("=", left, right)
        if not (V.is_number(left) and V.is_number(right)):
            hit = F.coalesce(hit, no()) | (equal(left, right) & right.col.isNotNull())
        hits.append(F.coalesce(hit, no()))
    found = no()
    for h in hits:
        found = found | h
    return F.when(left.col.isNotNull(), ~found if expr.negated else found)


def _arithmetic(name: str, args: list[Column]) -> Column:
    if name == "pos":
        return args[0]
    if name == "neg":
        return -args[0]
    a, b = args
    return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, F.when(b != 0, b))}[name]


def _flags(pattern: Val, flags: Val | None) -> str:
    """A literal pattern with its flags in the dialect of the JVM."""
    if not pattern.const or flags and not flags.const:
        raise Refused("a pattern that isn't a constant")
    given = flags.const.value if flags else ""
    if set(given) - set("ismx"):
        return ""
    if re.search(r"\\[1-9]|\(\?<?[=!]", pattern.const.value):
        return ""  # the reference dialect has neither back references nor look-around
    try:
        re.compile(pattern.const.value)
    except re.error:
        return ""
    return (f"(?{given})" if given else "") + pattern.const.value


def _regex(s: Val, pattern: Val, flags: Val | None = None) -> Val:
    p = _flags(pattern, flags)
    return boolean(V.lex(s).rlike(p) if p or not pattern.const.value else F.lit(None).cast("boolean"))


def _replace(s: Val, pattern: Val, by: Val, flags: Val | None = None) -> Val:
    p = _flags(pattern, flags)
    if not p:
        return V.none()
    if by.const:
        return text(F.regexp_replace(V.lex(s), F.lit(p), F.lit(by.const.value.replace("\\", "\\\\").replace("$$", "\\$"))))
    return text(F.regexp_replace(V.lex(s), F.lit(p), V.lex(by)))


def _substring(s: Val, start: Val, length: Val | None = None) -> Val:
    a = F.greatest(F.floor(V.number(start) + 0.5), F.lit(1)).cast("int")
    n = F.greatest(F.floor(V.number(length) + 0.5), F.lit(0)).cast("int") if length else F.lit((1 << 31) - 1)
    return text(F.substring(V.lex(s), a, n))


def _before(s: Val, sub: Val) -> Val:
    at = F.instr(V.lex(s), V.lex(sub))
    return text(F.when(at > 0, F.substring(V.lex(s), F.lit(1), at - 1)).when(at == 0, F.lit("")))


def _after(s: Val, sub: Val) -> Val:
    at = F.instr(V.lex(s), V.lex(sub))
    return text(F.when(at > 0, F.substring(V.lex(s), at + F.length(V.lex(sub)), F.lit((1 << 31) - 1))).when(at == 0, F.lit("")))


def _lang(v: Val) -> Val:
    if v.kind == "term":
        return text(F.when(T.is_literal(v.col), T.language(v.col)))
    return text(F.when(v.col.isNotNull(), F.lit("")) if v.kind not in ("key", "row", "none") else F.lit(None).cast("string"))


def _lang_matches(tag: Val, range_: Val) -> Val:
    t, r = F.lower(V.lex(tag)), F.lower(V.lex(range_))
    return boolean(F.when(r == "*", F.length(t) > 0).otherwise((t == r) | t.startswith(F.concat(r, F.lit("-")))))


def _datatype(v: Val) -> Val:
    if v.kind == "term":
        kind = F.when(T.is_literal(v.col), T.datatype(v.col))
    elif v.kind == "num":
        kind = F.when((v.col == F.floor(v.col)) & (F.abs(v.col) < 9.007e15), T.INTEGER).when(v.col.isNotNull(), T.DECIMAL)
    elif v.kind in ("key", "row", "none"):
        kind = F.lit(None).cast("string")
    else:
        kind = F.when(v.col.isNotNull(), {"int": T.INTEGER, "double": T.DOUBLE, "bool": T.BOOLEAN, "time": T.DATE_TIME, "str": T.STRING}[v.kind])
    return Val("term", F.concat(F.lit("<"), kind, F.lit(">")), bound=False)


def _kind(test: Callable[[Column], Column], native: tuple[str, ...]) -> Callable[[Val], Val]:
    def make(v: Val) -> Val:
        if v.kind == "term":
            return boolean(test(v.col))
        return boolean(F.when(v.col.isNotNull(), F.lit(v.kind in native)))

    return make


def _is_numeric(v: Val) -> Val:
    if v.kind == "term":
        behind = T.suffix(v.col)
        return boolean(F.when(v.col.isNotNull(), T.is_literal(v.col) & behind.isin(*[f"^^<{d}>" for d in T.NUMERIC]) & T.number_of(V.lex(v)).isNotNull()))
    return boolean(F.when(v.col.isNotNull(), F.lit(v.kind in V.NATIVE_NUMBERS)))


#: A date and time as the fields are read from it.
SHAPE = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d"


def _field(start: int, size: int) -> Callable[[Val], Val]:
    part = {1: F.year, 6: F.month, 9: F.dayofmonth, 12: F.hour, 15: F.minute}[start]

    def make(v: Val) -> Val:
        if v.kind == "time":
            return Val("int", part(v.col).cast("long"), bound=False)
        if v.kind != "term":
            return V.none()
        lexical = V.lex(v)
        return Val("int", F.when((T.suffix(v.col) == f"^^<{T.DATE_TIME}>") & lexical.rlike(SHAPE), F.substring(lexical, start, size).try_cast("long")), bound=False)

    return make


def _seconds(v: Val) -> Val:
    if v.kind == "time":
        return num(F.second(v.col).cast("double") + F.date_format(v.col, "SSSSSS").cast("double") / 1e6)
    if v.kind != "term":
        return V.none()
    lexical = V.lex(v)
    return num(F.when((T.suffix(v.col) == f"^^<{T.DATE_TIME}>") & lexical.rlike(SHAPE), F.regexp_extract(lexical, r"^.{17}(\d\d(?:\.\d+)?)", 1).try_cast("double")))


def _one_number(f: Callable[[Column], Column]) -> Callable[[Val], Val]:
    return lambda v: num(f(V.number(v)).cast("double"))


def _pair(f: Callable[[Column, Column], Column]) -> Callable[[Val, Val], Val]:
    return lambda a, b: boolean(f(V.lex(a), V.lex(b)))


#: Fewest and most arguments, and the function.
BUILT_IN: dict[str, tuple[int, int | None, Callable[..., Val]]] = {
    "STR": (1, 1, lambda v: text(V.lex(v))),
    "LANG": (1, 1, _lang),
    "LANGMATCHES": (2, 2, _lang_matches),
    "DATATYPE": (1, 1, _datatype),
    "STRLEN": (1, 1, lambda v: Val("int", F.char_length(V.lex(v)).cast("long"), bound=False)),
    "SUBSTR": (2, 3, _substring),
    "UCASE": (1, 1, lambda v: text(F.upper(V.lex(v)))),
    "LCASE": (1, 1, lambda v: text(F.lower(V.lex(v)))),
    "STRSTARTS": (2, 2, _pair(F.startswith)),
    "STRENDS": (2, 2, _pair(F.endswith)),
    "CONTAINS": (2, 2, _pair(F.contains)),
    "STRBEFORE": (2, 2, _before),
    "STRAFTER": (2, 2, _after),
    "CONCAT": (0, None, lambda *v: text(F.concat(*[V.lex(x) for x in v]) if v else F.lit(""))),
    "REPLACE": (3, 4, _replace),
    "REGEX": (2, 3, _regex),
    "ABS": (1, 1, _one_number(F.abs)),
    "CEIL": (1, 1, _one_number(F.ceil)),
    "FLOOR": (1, 1, _one_number(F.floor)),
    "ROUND": (1, 1, _one_number(lambda x: F.floor(x + 0.5))),
    "ISIRI": (1, 1, _kind(T.is_iri, ("key",))),
    "ISBLANK": (1, 1, _kind(T.is_bnode, ("row",))),
    "ISLITERAL": (1, 1, _kind(T.is_literal, ("int", "double", "num", "str", "bool", "time"))),
    "ISNUMERIC": (1, 1, _is_numeric),
    "YEAR": (1, 1, _field(1, 4)),
    "MONTH": (1, 1, _field(6, 2)),
    "DAY": (1, 1, _field(9, 2)),
    "HOURS": (1, 1, _field(12, 2)),
    "MINUTES": (1, 1, _field(15, 2)),
    "SECONDS": (1, 1, _seconds),
}


# aggregates


def sort_keys(v: Val, descending: bool) -> list[Column]:
    """Unbound first when ascending; then numbers by value, and text."""
    way = (lambda c: c.desc_nulls_last()) if descending else (lambda c: c.asc_nulls_first())
    if v.kind in (*V.NATIVE_NUMBERS, "time", "bool", "none"):
        return [way(v.col)]
    if v.kind == "key":
        return [way(V.lex(v))]
    n = V.number(v)
    return [way(F.when(v.col.isNotNull(), n.isNull())), way(n), way(V.lex(v))]


def aggregate(agg: A.Aggregate, env: Env) -> Val:
    """An aggregate as a value over grouped rows."""
    if agg.arg is None:
        everything = F.struct(*[V.stored(v).alias(f"c{i}") for i, v in enumerate(env.values())] or [F.lit(1).alias("c")])
        return Val("int", F.count_distinct(everything) if agg.distinct else F.count(F.lit(1)))
    v = value(agg.arg, env)
    name = agg.name
    if name == "COUNT":
        col = v.col if v.kind not in ("row",) else V.stored(v)
        return Val("int", F.count_distinct(col) if agg.distinct else F.count(col))
    if name in ("SUM", "AVG"):
        n = V.number(v)
        if agg.distinct:
            # terms are distinct, not their numbers
            pairs = F.collect_set(F.when(n.isNotNull(), F.struct(V.stored(v).alias("t"), n.alias("n"))))
            total = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x["n"])
            return num(total if name == "SUM" else F.when(F.size(pairs) > 0, total / F.size(pairs)).otherwise(0.0))
        return num(F.coalesce(F.sum(n) if name == "SUM" else F.avg(n), F.lit(0.0)))
    if name in ("MIN", "MAX"):
        least = name == "MIN"
        pick, by = (F.min, F.min_by) if least else (F.max, F.max_by)
        if v.kind in (*V.NATIVE_NUMBERS, "time"):
            return Val(v.kind, pick(v.col), bound=False)
        if v.kind in ("key", "row", "none"):
            return Val("term", pick(V.stored(v)), bound=False)
        n = V.number(v)
        numeric = F.bool_and(F.when(v.col.isNotNull(), n.isNotNull()))
        # among equal numbers the least text, so that the result doesn't hang on row order
        return Val(v.kind, F.when(numeric, by(v.col, F.struct(n, v.col))).otherwise(pick(v.col)), v.prefix, bound=False)
    if name == "SAMPLE":
        return Val(v.kind, F.min(v.col), v.prefix, bound=False) if v.kind != "row" else Val("term", F.min(V.stored(v)), bound=False)
    if name == "GROUP_CONCAT":
        items = (F.collect_set if agg.distinct else F.collect_list)(V.lex(v))
        return text(F.array_join(F.array_sort(items), agg.separator))
    raise Refused(f"{name} is not supported")
