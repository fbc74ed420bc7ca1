"""Rules over lists and restrictions: chains, keys, intersections, unions, disjointness, cardinality, difference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.closure import checkpointed, together
from ..terms import OWL, RDF, RDF_TYPE, RDFS

NIL, FIRST, REST = f"<{RDF}nil>", f"<{RDF}first>", f"<{RDF}rest>"
SUBCLASS, SAME, DIFFERENT, NOTHING, THING = f"<{RDFS}subClassOf>", f"<{OWL}sameAs>", f"<{OWL}differentFrom>", f"<{OWL}Nothing>", f"<{OWL}Thing>"
#: Predicates whose object is a list.
LISTED = [f"<{OWL}{n}>" for n in ("intersectionOf", "unionOf", "propertyChainAxiom", "hasKey", "members", "distinctMembers")]


def predicate(triples: DataFrame, name: str, a: str = "s", b: str = "o") -> DataFrame:
    return triples.where(F.col("p") == (name if name.startswith("<") else f"<{OWL}{name}>")).select(F.col("s").alias(a), F.col("o").alias(b))


def typed(triples: DataFrame, a: str = "x", b: str = "c") -> DataFrame:
    return triples.where(F.col("p") == RDF_TYPE).select(F.col("s").alias(a), F.col("o").alias(b))


def collections(triples: DataFrame) -> DataFrame:
    """``axiom, how, n, position, item`` of each list that an axiom has; lists with a gap or a cycle are left out.

    All lists are walked together, by doubling: what is known of their first cells and jumps
    of that length give as many cells more, so the longest list takes the logarithm of its length in rounds.
    """
    heads = triples.where(F.col("p").isin(LISTED)).select(F.col("s").alias("axiom"), F.col("p").alias("how"), F.col("o").alias("head")).distinct()
    first, rest = predicate(triples, FIRST, "cell", "item"), predicate(triples, REST, "cell", "next")
    jump = checkpointed(rest.where(F.col("next") != NIL).distinct())
    walk = checkpointed(heads.where(F.col("head") != NIL).select("axiom", "how", "head", F.col("head").alias("cell"), F.lit(0).cast("long").alias("position")))
    parts, size, most = [walk], 1, jump.count() + 1
    # a list is at most as long as there are cells; one that is longer has a cycle
    while size <= most:
        ahead = together(parts).join(jump, "cell").select("axiom", "how", "head", F.col("next").alias("cell"), (F.col("position") + size).alias("position"))
        found = checkpointed(ahead)
        if found.isEmpty():
            break
        parts.append(found)
        jump = checkpointed(jump.join(jump.select(F.col("cell").alias("next"), F.col("next").alias("far")), "next").select("cell", F.col("far").alias("next")))
        size *= 2
    cells = together(parts).join(first, "cell")
    last = cells.join(rest.where(F.col("next") == NIL), "cell").groupBy("axiom", "how", "head").agg((F.max("position") + 1).cast("int").alias("n"))
    ends = cells.groupBy("axiom", "how", "head").agg(F.count_distinct("position").alias("seen"))
    whole = last.join(ends, ["axiom", "how", "head"]).where("seen = n").drop("seen")
    return cells.join(whole, ["axiom", "how", "head"]).select("axiom", "how", "n", F.col("position").cast("int").alias("position"), "item")


def _of(lists: DataFrame, name: str) -> DataFrame:
    return lists.where(F.col("how") == f"<{OWL}{name}>").drop("how")


def _facts(df: DataFrame, s: Column, p: str, o: Column, rule: str) -> DataFrame:
    return df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(rule).alias("rule"))


def _star(df: DataFrame, by: list[str], member: str, rule: str) -> DataFrame:
    """``owl:sameAs`` from the least member of a group to the others: the closure makes the rest, and no pairs are listed."""
    least = df.groupBy(*by).agg(F.min(member).alias("~least"))
    rows = df.join(least, by).where(F.col(member) != F.col("~least"))
    return _facts(rows.select("~least", member).distinct(), F.col("~least"), SAME, F.col(member), rule)


def restrictions(triples: DataFrame) -> DataFrame:
    """``x, p, bound, filler`` of cardinality restrictions to 0 or 1; no filler is null."""
    out = []
    for name, qualified in (("maxCardinality", False), ("maxQualifiedCardinality", True), ("cardinality", False)):
        if name == "cardinality":
            continue
        size = predicate(triples, name, "x", "size").withColumn("bound", F.regexp_extract("size", r'^"\s*\+?0*([01])\s*"', 1).try_cast("int")).where("bound is not null")
        df = size.join(predicate(triples, "onProperty", "x", "p"), "x")
        if qualified:
            df = df.join(predicate(triples, "onClass", "x", "filler"), "x")
        else:
            df = df.withColumn("filler", F.lit(None).cast("string"))
        out.append(df.select("x", "p", "bound", "filler"))
    return reduce(DataFrame.unionByName, out)


def list_rules(triples: DataFrame, lists: DataFrame) -> list[DataFrame]:
    """One round of every rule of this kind: ``s, p, o, rule``."""
    out: list[DataFrame] = []
    kinds = typed(triples)
    x = F.col("x")

    # property chains: one chain of joins for each axiom; axioms are schema
    chains: dict[tuple, list] = {}
    for row in _of(lists, "propertyChainAxiom").orderBy("axiom", "position").collect():
        chains.setdefault((row["axiom"], row["n"]), []).append(row["item"])
    for (prop, n), steps in chains.items():
        if len(steps) == n:
            df = predicate(triples, steps[0], "x", "y")
            for p in steps[1:]:
                df = df.join(predicate(triples, p, "y", "z"), "y").select("x", F.col("z").alias("y"))
            out.append(_facts(df.distinct(), x, prop, F.col("y"), "prp-spo2"))

    # keys: equal values of all keys within the class
    keys = _of(lists, "hasKey")
    values = triples.select(F.col("s").alias("x"), F.col("p").alias("item"), F.col("o").alias("value"))
    for n in [r["n"] for r in keys.select("n").distinct().collect()]:
        df = None
        for i in range(n):
            own = keys.where((F.col("n") == n) & (F.col("position") == i)).select("axiom", "item").join(values, "item").select("axiom", "x", F.col("value").alias(f"v{i}"))
            df = own if df is None else df.join(own, ["axiom", "x"])
        if df is not None:
            df = df.join(kinds.withColumnRenamed("c", "axiom"), ["axiom", "x"]).distinct()
            out.append(_star(df, ["axiom", *[f"v{i}" for i in range(n)]], "x", "prp-key"))

    # intersections and unions
    both = _of(lists, "intersectionOf")
    members = both.select("axiom", "n", F.col("item").alias("c")).distinct().join(kinds, "c")
    needed = both.groupBy("axiom").agg(F.count_distinct("item").alias("need"))
    found = members.groupBy("axiom", "x").agg(F.count_distinct("c").alias("has")).join(needed, "axiom").where("has = need")
    out.append(_facts(found, x, RDF_TYPE, F.col("axiom"), "cls-int1"))
    out.append(_facts(both.distinct(), F.col("axiom"), SUBCLASS, F.col("item"), "scm-int"))
    any_ = _of(lists, "unionOf").select("axiom", F.col("item").alias("c")).join(kinds, "c").select("axiom", "x").distinct()
    out.append(_facts(any_, x, RDF_TYPE, F.col("axiom"), "cls-uni"))

    # disjointness and difference of all members
    listed = _of(lists, "members").unionByName(_of(lists, "distinctMembers"))
    of = lambda kind: listed.join(kinds.where(F.col("c") == f"<{OWL}{kind}>").select(F.col("x").alias("axiom")), "axiom", "left_semi")
    twice = of("AllDisjointClasses").select("axiom", F.col("item").alias("c")).distinct().join(kinds, "c").groupBy("axiom", "x").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    out.append(_facts(twice, x, RDF_TYPE, F.lit(NOTHING), "cax-adc"))
    used = of("AllDisjointProperties").select("axiom", "position", F.col("item").alias("p")).join(triples, "p").groupBy("axiom", "s", "o").agg(F.count_distinct("position").alias("k")).where("k > 1")
    out.append(_facts(used, F.col("s"), RDF_TYPE, F.lit(NOTHING), "prp-adp"))
    a = of("AllDifferent").select("axiom", F.col("position").alias("i"), F.col("item").alias("x"))
    b = of("AllDifferent").select("axiom", F.col("position").alias("j"), F.col("item").alias("y"))
    out.append(_facts(a.join(b, "axiom").where("i != j"), x, DIFFERENT, F.col("y"), "eq-diff2"))

    # cardinality
    bounds = restrictions(triples)
    uses = bounds.join(kinds.select(F.col("x").alias("u"), F.col("c").alias("x")), "x").join(triples.select(F.col("s").alias("u"), "p", F.col("o").alias("y")), ["u", "p"])
    filled = uses.join(kinds.select(F.col("x").alias("y"), F.col("c").alias("filler")), ["y", "filler"], "left_semi").select(*uses.columns)
    plain = uses.where(F.col("filler").isNull() | (F.col("filler") == THING))
    qualified = filled.where(F.col("filler") != THING)
    for df, zero, one in ((plain, "cls-maxc1", "cls-maxc2"), (qualified, "cls-maxqc1", "cls-maxqc3")):
        out.append(_facts(df.where("bound = 0").select("u").distinct(), F.col("u"), RDF_TYPE, F.lit(NOTHING), zero))
        out.append(_star(df.where("bound = 1").select("x", "p", "u", "y").distinct(), ["x", "p", "u"], "y", one))
    return out
