"""Values: a column and what is known of it when the plan is made.

A variable or expression is either a stored term or a native column, kept native
as long as its kind is known, so that joins and filters reach the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import terms as T

#: ``key``: an IRI, a prefix and a native key; ``row``: a blank node for a row; ``num``: a double from arithmetic.
NATIVE_NUMBERS = ("int", "double", "num")


@dataclass(frozen=True)
class Val:
    kind: str  # key, row, int, double, num, str, bool, time, term or none
    col: Column
    prefix: str = ""
    bound: bool = True
    const: T.Term | None = None

    def at(self, name: str) -> Val:
        """The same value as a column of a frame."""
        return replace(self, col=F.col(f"`{name}`"), const=None)

    def maybe(self) -> Val:
        return replace(self, bound=False, const=None)


def encode(name: str) -> str:
    """A variable's column name; Spark's names don't tell upper from lower case."""
    return "".join("__" if c == "_" else "_" + c.lower() if c.isupper() else c for c in name)


def constant(term: T.Term) -> Val:
    return Val("term", F.lit(term.stored), const=term)


def none() -> Val:
    """Unbound."""
    return Val("none", F.lit(None).cast("string"), bound=False)


def iso(col: Column) -> Column:
    """A timestamp's lexical form; a fraction only where there is one."""
    whole = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(col, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), F.rtrim(micros, F.lit("0"))))


def plain_number(col: Column) -> Column:
    """A double's lexical form without exponent where it is a whole number."""
    return F.when((col == F.floor(col)) & (F.abs(col) < 9.007e15), col.try_cast("long").cast("string")).otherwise(col.cast("string"))


def lex(v: Val) -> Column:
    """Lexical value: what STR gives."""
    if v.const:
        return F.lit(v.const.value)
    if v.kind == "key":
        return F.concat(F.lit(v.prefix), v.col.cast("string"))
    if v.kind == "row":
        return F.sha2(v.col.cast("string"), 256)
    if v.kind == "term":
        return T.lexical(v.col)
    if v.kind == "time":
        return iso(v.col)
    if v.kind == "num":
        return plain_number(v.col)
    return v.col.cast("string")


def stored(v: Val) -> Column:
    """The term, as it is stored."""
    if v.kind in ("term", "none"):
        return v.col
    if v.kind == "key":
        return F.concat(F.lit("<"), lex(v), F.lit(">"))
    if v.kind == "row":
        return F.concat(F.lit("_:"), lex(v))
    quoted = F.concat(F.lit('"'), lex(v), F.lit('"'))
    if v.kind == "str":
        return quoted
    if v.kind == "num":
        whole = (v.col == F.floor(v.col)) & (F.abs(v.col) < 9.007e15)
        return F.concat(quoted, F.when(whole, f"^^<{T.INTEGER}>").otherwise(f"^^<{T.DECIMAL}>"))
    kind = {"int": T.INTEGER, "double": T.DOUBLE, "bool": T.BOOLEAN, "time": T.DATE_TIME}[v.kind]
    return F.concat(quoted, F.lit(f"^^<{kind}>"))


def number(v: Val) -> Column:
    """The double that the lexical value reads as, or null."""
    if v.const:
        n = v.const.value.strip() if v.const.kind == "literal" else ""
        return T.number_of(F.lit(n)) if n else F.lit(None).cast("double")
    if v.kind in NATIVE_NUMBERS:
        return v.col.cast("double")
    if v.kind == "str":
        return T.number_of(v.col)
    if v.kind == "term":
        return F.when(T.is_literal(v.col), T.number_of(T.lexical(v.col)))
    return F.lit(None).cast("double")


def is_number(v: Val) -> bool | None:
    """Whether the value reads as a number, if that is known."""
    if v.kind in NATIVE_NUMBERS:
        return True
    if v.const:
        if v.const.kind != "literal":
            return False
        try:
            float(v.const.value.strip())
        except ValueError:
            return False
        return "_" not in v.const.value
    return None if v.kind in ("term", "str") else False


def as_term(v: Val) -> Val:
    return v if v.kind == "term" else Val("term", stored(v), bound=v.bound)


def unify(a: Val, b: Val) -> tuple[Val, Val]:
    """The two in one representation."""
    if a.kind == b.kind and a.prefix == b.prefix and a.kind != "row":
        return a, b
    if a.kind == "none" and b.kind not in ("row",):
        return replace(b, col=F.lit(None).cast("string") if b.kind in ("term", "str") else F.lit(None), bound=False, const=None), b
    if b.kind == "none":
        y, x = unify(b, a)
        return x, y
    return as_term(a), as_term(b)


def output(v: Val) -> Column:
    """What a result column holds: native values, IRIs and labels of keys as text, stored terms."""
    if v.kind in ("key", "row"):
        return lex(v)
    if v.kind == "num":
        return v.col.cast("double")
    return v.col
