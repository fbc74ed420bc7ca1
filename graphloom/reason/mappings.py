"""Mapping rules: inference over mappings with confidence and justification, and mapping nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.closure import transitive
from ..terms import OWL, RDF_TYPE, SKOS
from .engine import Materialised, fixpoint
from .rules import CLOSED, SEMAPV, mapping_rules

SSSOM = "https://w3id.org/sssom/"


def infer(mappings: DataFrame) -> Materialised:
    """What follows from mappings by generalising, inverting, chaining, transitivity and negation. Identity is not touched."""
    return fixpoint(mappings, mapping_rules(), {k: v for k, v in CLOSED.items() if k.startswith("sssom")}, pairs=False)


def justification(rule: Column) -> Column:
    """How a mapping came about."""
    return F.when(rule.startswith("sssom-ri"), F.lit(f"<{SEMAPV}MappingInversion>")).when(rule.isNotNull(), F.lit(f"<{SEMAPV}MappingChaining>"))


def confidence(premises: Column) -> Column:
    """Product of the premises' confidences; one without counts as 1."""
    return F.aggregate(premises, F.lit(1.0), lambda acc, x: acc * F.coalesce(x, F.lit(1.0)))


def chained_confidence(left: DataFrame, right: DataFrame) -> DataFrame:
    """Mappings ``s, p, o, confidence`` chained through an exact match on the left."""
    exact = left.where(F.col("p") == f"<{SKOS}exactMatch>").select("s", F.col("o").alias("m"), F.col("confidence").alias("c1"))
    onward = right.select(F.col("s").alias("m"), "p", "o", F.col("confidence").alias("c2"))
    rows = exact.join(onward, "m").select("s", "p", "o", confidence(F.array("c1", "c2")).alias("confidence"))
    return rows.groupBy("s", "p", "o").agg(F.max("confidence").alias("confidence"))


def nodes(facts: DataFrame) -> DataFrame:
    """``s, p, o`` of a mapping node for each inferred mapping, and of what it derives from."""
    node = F.concat(F.lit("_:m"), F.sha2(F.concat_ws(" ", "s", "p", "o"), 256))
    made = facts.where("rule is not null").select(node.alias("node"), "s", "p", "o", justification(F.col("rule")).alias("why"), "premises")
    cells = F.array(
        *[
            F.struct(F.lit(p).alias("p"), o.alias("o"))
            for p, o in (
                (RDF_TYPE, F.lit(f"<{SSSOM}Mapping>")),
                (f"<{OWL}annotatedSource>", F.col("s")),
                (f"<{OWL}annotatedProperty>", F.col("p")),
                (f"<{OWL}annotatedTarget>", F.col("o")),
                (f"<{SSSOM}mapping_justification>", F.col("why")),
            )
        ]
    )
    five = made.select(F.col("node").alias("s"), F.inline(cells))
    premise = F.concat(F.lit("_:m"), F.sha2(F.concat_ws(" ", "x.s", "x.p", "x.o"), 256))
    derived = made.select("node", F.explode("premises").alias("x")).select(F.col("node").alias("s"), F.lit(f"<{SSSOM}derived_from>").alias("p"), premise.alias("o"))
    return five.unionByName(derived)


__all__ = ["chained_confidence", "confidence", "infer", "justification", "nodes", "transitive"]
