"""Queries over a source: parse, rewrite, plan, and what each form gives."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import algebra as A
from .parser.sparql import parse_query
from .plans.compiler import Compiler, construct, describe, output
from .plans.rewrite import indented, optimise, tree
from .plans.values import none, stored
from .store import QuadGraph
from .terms import Term


class Engine:
    """Answers SPARQL over quads or mapped tables."""

    def __init__(self, spark: SparkSession, source: object, strict: bool = False, prefixes: dict[str, str] | None = None):
        self.spark, self.source, self.strict, self.prefixes = spark, source, strict, prefixes or {}

    def _source(self, dataset: A.Dataset) -> object:
        if isinstance(self.source, DataFrame):
            return QuadGraph(self.source, dataset, self.strict)
        if dataset.given:
            raise A.Refused("FROM over mapped tables")
        return self.source

    def query(self, text: str, terms: bool = False) -> DataFrame | bool | str:
        """A frame for SELECT, CONSTRUCT and DESCRIBE, a boolean for ASK, text for EXPLAIN.

        SELECT's columns are native where the kind is known, or with ``terms`` all stored terms, which tell an IRI from a text:
        what result formats are written from.
        """
        q = parse_query(text, prefixes=self.prefixes)
        pattern = optimise(q.pattern, q.disabled)
        source = self._source(q.dataset)
        if q.explain:
            return self._explain(q, pattern, source)
        r = Compiler(self.spark, source).run(pattern)
        if q.form == "select":
            return r.df.select(*[stored(r.vals[n] if n in r.vals else none()).alias(n) for n in q.names]) if terms else output(r, q.names)
        if q.form == "ask":
            return not r.df.isEmpty()
        if q.form == "construct":
            return construct(r, q.template)
        named = [r.df.select(stored(r.vals[n]).alias("s")).where("s is not null") for n in q.names if n in r.vals]
        targets = [t for t in q.targets if isinstance(t, Term)]
        if not targets and not named:
            return self.spark.createDataFrame([], "s string, p string, o string")
        return describe(source, targets, reduce(DataFrame.unionByName, named) if named else None)

    def _explain(self, q: A.Query, pattern: object, source: object) -> str:
        plan = tree(pattern)
        df = Compiler(self.spark, source).run(pattern).df
        spark_plan = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if q.explain == "json":
            return json.dumps({"form": q.form, "plan": plan, "estimated_bytes": estimate, "physical": spark_plan})
        return f"{q.form}\n{indented(plan)}\nestimated bytes: {estimate}\n{spark_plan}"

    def select(self, text: str, terms: bool = False) -> DataFrame:
        out = self.query(text, terms)
        if not isinstance(out, DataFrame):
            raise A.Refused("not a form with rows")
        return out

    def ask_row(self, text: str) -> DataFrame:
        """ASK as a frame of one row."""
        q = parse_query(text, prefixes=self.prefixes)
        r = Compiler(self.spark, self._source(q.dataset)).run(optimise(q.pattern, q.disabled))
        return r.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
