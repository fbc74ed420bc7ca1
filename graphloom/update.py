"""SPARQL updates: each operation is one change ``S' = (S - D) + A`` of the store."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import algebra as A
from .algebra import Refused
from .operators.joins import Relation
from .parser.sparql import parse_update
from .plans.compiler import Compiler
from .plans.rewrite import optimise
from .plans.values import stored
from .sources.files import file_path, read
from .store import RESERVED, SCHEMA, QuadGraph, Store, reserved
from .terms import Term, Var


def _written(op: object) -> list[str | None]:
    """The graphs that an operation names as targets of writes."""
    if isinstance(op, A.Data):
        return [q[0].stored for q in op.quads if isinstance(q[0], Term)]
    if isinstance(op, A.Modify):
        return [q[0].stored for q in op.delete + op.insert if isinstance(q[0], Term)] + [op.with_graph]
    if isinstance(op, A.Manage):
        return [op.target]
    if isinstance(op, A.Transfer):
        return [op.to] + ([op.source] if op.verb == "move" else [])
    return [op.into]


class Updater:
    """Applies requests to a store; a request is checked whole before its first operation."""

    def __init__(self, spark: SparkSession, store: Store, prefixes: dict[str, str] | None = None):
        self.spark, self.store, self.prefixes = spark, store, prefixes or {}

    def run(self, text: str) -> list[tuple[int, int]]:
        """Real deletions and additions of each operation."""
        ops = parse_update(text, prefixes=self.prefixes)
        for op in ops:
            if any(map(reserved, _written(op))):
                raise Refused("a reserved graph is not written")
        self.store.prepare()
        return [getattr(self, "on_" + type(op).__name__.lower())(op) for op in ops]

    def rows(self, quads: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(quads, SCHEMA)

    def exists(self, graph: str) -> bool:
        return not self.store.quads.where(F.col("g") == graph).isEmpty()

    def on_data(self, op: A.Data) -> tuple[int, int]:
        fresh = uuid.uuid4().hex[:12]
        name = lambda n: None if n is None else n.stored if isinstance(n, Term) else f"_:u{fresh}{n.name.strip('.')}"
        quads = [tuple(map(name, q)) for q in op.quads]
        if any(q[1].startswith('"') for q in quads):
            raise Refused("a literal as subject")
        df = self.rows(quads)
        return self.store.apply(None, df) if op.insert else self.store.apply(df, None)

    def on_modify(self, op: A.Modify) -> tuple[int, int]:
        dataset = op.dataset if op.dataset.given or not op.with_graph else A.Dataset([op.with_graph], self._all_named())
        # without a clause the pattern sees the unnamed graph alone, unlike a query
        source = QuadGraph(self.store.quads, dataset, strict=True)
        r = Compiler(self.spark, source).run(optimise(op.pattern))
        delete = self.instances(r, op.delete, op.with_graph, fresh=False)
        insert = self.instances(r, op.insert, op.with_graph, fresh=True)
        return self.store.apply(delete, insert)

    def _all_named(self) -> list[str]:
        return [row["g"] for row in self.store.quads.where(F.col("g").isNotNull() & ~F.col("g").startswith(RESERVED)).select("g").distinct().collect()]

    def instances(self, r: Relation, template: list[A.Quad], graph: str | None, fresh: bool) -> DataFrame | None:
        """Quads of a template for each row; blank nodes are new in each row, and a quad with an unbound or wrong term is left out."""
        if not template:
            return None
        df = r.df
        if fresh and any(isinstance(n, Var) and n.name not in r.vals for q in template for n in q):
            # one name for a row in all quads: the rows are written before they are named
            from .operators.closure import checkpointed

            df = checkpointed(df).withColumn("~row", F.concat(F.lit(uuid.uuid4().hex[:12] + "."), F.monotonically_increasing_id().cast("string")))
        parts = []
        for q in template:
            cols, keep = [], F.lit(True)
            for name, node in zip("gspo", q, strict=True):
                if node is None:
                    col = F.lit(graph)
                elif isinstance(node, Term):
                    col = F.lit(node.stored)
                elif node.name in r.vals:
                    col = stored(r.vals[node.name])
                elif node.name.startswith(".b") and fresh:
                    col = F.concat(F.lit(f"_:u{node.name.strip('.')}."), F.col("~row"))
                else:
                    col = F.lit(None)
                col = col.cast("string")
                cols.append(col.alias(name))
                if name == "g" and isinstance(node, Var):
                    keep = keep & col.startswith("<") & ~col.startswith(RESERVED)
                elif name != "g":
                    keep = keep & col.isNotNull()
                if name == "s":
                    keep = keep & ~col.startswith('"')
                if name == "p":
                    keep = keep & col.startswith("<")
            parts.append(df.where(keep).select(*cols))
        return reduce(DataFrame.unionByName, parts)

    def on_manage(self, op: A.Manage) -> tuple[int, int]:
        q, target = self.store.quads, op.target
        if op.verb == "create":
            if self.exists(target) and not op.silent:
                raise Refused(f"{target} exists")
            return 0, 0
        free = F.col("g").isNull() | ~F.col("g").startswith(RESERVED)
        if target == "ALL":
            gone = q.where(free)
        elif target == "DEFAULT":
            gone = q.where(F.col("g").isNull())
        elif target == "NAMED":
            gone = q.where(free & F.col("g").isNotNull())
        else:
            if not op.silent and not self.exists(target):
                raise Refused(f"no graph {target}")
            gone = q.where(F.col("g") == target)
        return self.store.apply(gone, None)

    def on_transfer(self, op: A.Transfer) -> tuple[int, int]:
        if op.source == op.to:
            return 0, 0
        if op.source is not None and not op.silent and not self.exists(op.source):
            raise Refused(f"no graph {op.source}")
        q = self.store.quads
        own = q.where(F.col("g").eqNullSafe(F.lit(op.source)))
        moved = own.select(F.lit(op.to).cast("string").alias("g"), "s", "p", "o")
        gone = None
        if op.verb in ("move", "copy"):
            gone = q.where(F.col("g").eqNullSafe(F.lit(op.to)))
        if op.verb == "move":
            gone = gone.unionByName(own)
        return self.store.apply(gone, moved)

    def on_load(self, op: A.Load) -> tuple[int, int]:
        try:
            path = file_path(op.source)
            quads = read(self.spark, path, base=op.source)
            if path.rsplit(".", 1)[-1].lower() in ("nq", "trig"):
                if op.into:
                    raise Refused("INTO GRAPH with a format that names graphs")
                quads = quads.where(F.col("g").isNull() | ~F.col("g").startswith(RESERVED))
            elif op.into:
                quads = quads.withColumn("g", F.lit(op.into))
            return self.store.apply(None, quads)
        except Exception:
            if op.silent:
                return 0, 0
            raise
