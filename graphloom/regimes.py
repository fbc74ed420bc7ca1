"""Entailment regimes: what each is called and how a query is answered under it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .algebra import Refused
from .engine import Engine

#: The regimes and their public names.
REGIMES = {"simple": "http://www.w3.org/ns/entailment/Simple", "owl-rl": "http://www.w3.org/ns/owl-profile/RL"}


def entailed(quads: DataFrame, regime: str) -> DataFrame:
    """The quads that a regime answers over: as they are, or with what follows from the default graph."""
    if regime not in REGIMES:
        raise Refused(f"no entailment regime {regime}")
    if regime == "simple":
        return quads
    from .reason.engine import materialise

    facts = materialise(quads.where(F.col("g").isNull()).select("s", "p", "o")).triples
    return quads.where(F.col("g").isNotNull()).unionByName(facts.select(F.lit(None).cast("string").alias("g"), "s", "p", "o"))


def answer(engine: Engine, text: str, regime: str = "simple") -> DataFrame:
    """A query's rows under a regime; only graphs of quads can be reasoned over."""
    if regime != "simple" and not isinstance(engine.source, DataFrame):
        raise Refused("reasoning over mapped tables")
    source = engine.source if regime == "simple" else entailed(engine.source, regime)
    return Engine(engine.spark, source, engine.strict, engine.prefixes).select(text)
