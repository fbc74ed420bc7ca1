"""Datatypes: the lattice, value classes of literals, ill-typed literals and intersections of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as T
from ..terms import OWL, RDF, RDF_TYPE, RDFS, XSD

#: Bounds of the integer types, None where there is none, and the type right above each.
INTEGERS: dict[str, tuple[int | None, int | None, str]] = {
    "integer": (None, None, "decimal"),
    "nonPositiveInteger": (None, 0, "integer"),
    "negativeInteger": (None, -1, "nonPositiveInteger"),
    "long": (-(1 << 63), (1 << 63) - 1, "integer"),
    "int": (-(1 << 31), (1 << 31) - 1, "long"),
    "short": (-32768, 32767, "int"),
    "byte": (-128, 127, "short"),
    "nonNegativeInteger": (0, None, "integer"),
    "unsignedLong": (0, (1 << 64) - 1, "nonNegativeInteger"),
    "unsignedInt": (0, (1 << 32) - 1, "unsignedLong"),
    "unsignedShort": (0, 65535, "unsignedInt"),
    "unsignedByte": (0, 255, "unsignedShort"),
    "positiveInteger": (1, None, "nonNegativeInteger"),
}
OTHERS = ("decimal", "string", "boolean", "dateTime")
NOTHING = f"<{OWL}Nothing>"


def axioms(spark: SparkSession) -> DataFrame:
    """Declarations of the datatypes and their lattice."""
    rows = [(f"<{XSD}{n}>", RDF_TYPE, f"<{RDFS}Datatype>") for n in (*INTEGERS, *OTHERS)]
    rows.append((f"<{RDFS}Literal>", RDF_TYPE, f"<{RDFS}Datatype>"))
    rows += [(f"<{XSD}{n}>", f"<{RDFS}subClassOf>", f"<{XSD}{up}>") for n, (_, _, up) in INTEGERS.items()]
    rows.append((f"<{XSD}decimal>", f"<{RDFS}subClassOf>", f"<{RDFS}Literal>"))
    return spark.createDataFrame(rows, "s string, p string, o string")


def value_class(term: Column) -> Column:
    """What equal literals have in common: the kind and the canonical value. Null for other kinds and ill-typed ones."""
    lex, kind = T.lexical(term), T.datatype(term)
    whole = F.regexp_extract(F.trim(lex), r"^([+-]?\d+)$", 1)
    digits = F.regexp_replace(whole, r"^\+", "")
    canonical = F.regexp_replace(F.regexp_replace(digits, r"^(-?)0+(?=\d)", "$1"), "^-0$", "0")
    integer = kind.isin(*[XSD + n for n in INTEGERS])
    return (
        F.when(~T.is_literal(term), F.lit(None))
        .when(integer & (whole != ""), F.concat(F.lit("i"), canonical))
        .when((kind == T.BOOLEAN) & lex.isin("true", "1"), F.lit("btrue"))
        .when((kind == T.BOOLEAN) & lex.isin("false", "0"), F.lit("bfalse"))
        .when(kind == T.STRING, F.concat(F.lit("p"), lex))
    )


def ill_typed(term: Column, kind: Column) -> Column:
    """Whether a literal can't have a datatype (an IRI without brackets): its form, or an integer's range."""
    lex = F.trim(T.lexical(term))
    whole = lex.rlike(r"^[+-]?\d{1,38}$")
    n = F.when(whole, lex.try_cast("decimal(38,0)"))
    bad = F.when(kind == T.BOOLEAN, ~lex.isin("true", "false", "1", "0"))
    for name, (low, high, _) in INTEGERS.items():
        outside = ~lex.rlike(r"^[+-]?\d+$")
        if low is not None:
            outside = outside | (n < F.lit(str(low)).cast("decimal(38,0)"))
        if high is not None:
            outside = outside | (n > F.lit(str(high)).cast("decimal(38,0)"))
        bad = bad.when(kind == XSD + name, outside)
    return F.coalesce(bad.when(kind == XSD + "decimal", ~lex.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$")), F.lit(False))


def literal_facts(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``owl:sameAs`` between literals of one value, hung on the least, and ``owl:Nothing`` for ill-typed ones."""
    literals = triples.select(F.col("o").alias("t")).where(T.is_literal(F.col("o"))).distinct()
    classes = literals.withColumn("v", value_class(F.col("t"))).where("v is not null")
    least = classes.groupBy("v").agg(F.min("t").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = classes.join(least, "v").where("t <> m").select(F.col("m").alias("s"), F.lit(f"<{OWL}sameAs>").alias("p"), F.col("t").alias("o"))
    bad = literals.where(ill_typed(F.col("t"), T.datatype(F.col("t")))).select(F.col("t").alias("s"), F.lit(RDF_TYPE).alias("p"), F.lit(NOTHING).alias("o"))
    return same, bad


def literal_differences(triples: DataFrame) -> DataFrame:
    """``dt-diff`` where it can matter, ``s, p, o, rule``: literals of one kind but other values that something makes the same.

    All pairs of literals of a corpus would be its square. What can make two literals the same is
    ``owl:sameAs`` itself and the values of a functional property, so only these are compared, each value with
    the least of its group; ``eq-diff1`` then puts it into ``owl:Nothing``.
    """
    functional = triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == f"<{OWL}FunctionalProperty>")).select(F.col("s").alias("p")).distinct()
    values = triples.where(T.is_literal(F.col("o"))).join(functional, "p", "left_semi").select("s", "p", F.col("o").alias("t"))
    least = values.groupBy("s", "p").agg(F.min("t").alias("m"), F.count_distinct("t").alias("n")).where("n > 1")
    pairs = values.join(least, ["s", "p"]).select("m", "t")
    same = triples.where((F.col("p") == f"<{OWL}sameAs>") & T.is_literal(F.col("s")) & T.is_literal(F.col("o"))).select(F.col("s").alias("m"), F.col("o").alias("t"))
    pairs = pairs.unionByName(same).where("m <> t").distinct().select("m", "t", value_class(F.col("m")).alias("a"), value_class(F.col("t")).alias("b"))
    pairs = pairs.where("substring(a, 1, 1) = substring(b, 1, 1) and a <> b")
    differ = pairs.select(F.col("m").alias("s"), F.lit(f"<{OWL}differentFrom>").alias("p"), F.col("t").alias("o"), F.lit("dt-diff").alias("rule"))
    return differ.unionByName(pairs.select(F.col("m").alias("s"), F.lit(RDF_TYPE).alias("p"), F.lit(NOTHING).alias("o"), F.lit("eq-diff1").alias("rule")).distinct())


def membership_faults(triples: DataFrame) -> DataFrame:
    """``owl:Nothing`` for literals that a range puts into a datatype which can't hold them."""
    ranges = triples.where(F.col("p") == f"<{RDFS}range>").where(F.col("o").startswith(f"<{XSD}")).select(F.col("s").alias("rp"), F.expr("substring(o, 2, length(o) - 2)").alias("kind"))
    used = triples.where(T.is_literal(F.col("o"))).join(ranges, F.col("p") == F.col("rp"))
    return used.where(ill_typed(F.col("o"), F.col("kind"))).select(F.col("o").alias("s"), F.lit(RDF_TYPE).alias("p"), F.lit(NOTHING).alias("o")).distinct()


def narrowed_ranges(ranges: dict[str, list[str]]) -> list[tuple[str, str]]:
    """Ranges that two or more ranges of a property imply together: every integer type that holds their intersection."""
    out = []
    for prop, kinds in ranges.items():
        own = [k for k in kinds if k in INTEGERS]
        if len(own) < 2:
            continue
        lows = [INTEGERS[k][0] for k in own if INTEGERS[k][0] is not None]
        highs = [INTEGERS[k][1] for k in own if INTEGERS[k][1] is not None]
        low, high = max(lows, default=None), min(highs, default=None)
        for name, (a, b, _) in INTEGERS.items():
            holds = (a is None or low is not None and low >= a) and (b is None or high is not None and high <= b)
            if holds and name not in kinds:
                out.append((prop, f"<{XSD}{name}>"))
    return out


__all__ = ["INTEGERS", "RDF", "axioms", "ill_typed", "literal_differences", "literal_facts", "membership_faults", "narrowed_ranges", "value_class"]
