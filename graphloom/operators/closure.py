"""Fixpoints over edges: reachability, best-confidence closure, components, incremental upkeep.

Each round is a join with what is new and an anti-join with what is known, and is
checkpointed, so that plans stay short and lost executors re-read files.
"""

from __future__ import annotations

import tempfile
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds after which a fixpoint is taken to be wrong.
GUARD = 4096
#: Rows of new pairs, counted in each round, up to which they are broadcast.
FEW = 50_000
#: Parts that are kept apart before they are written as one.
PARTS = 8


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, with their lineage cut, in the cluster's checkpoint folder.

    A temporary folder is made only where none is set and the driver runs all tasks; on a
    cluster it would lose data, so that is refused.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster checkpoints need a shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loom-ckpt-"))
    # what the optimiser infers of constant columns is not kept with the rows: a union of such rows
    # with others, one side of an anti-join, can't be planned (the optimiser looks up a column that is gone)
    conf, name = df.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return df.checkpoint()
    finally:
        conf.set(name, before)


def light(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where the counted rows allow it."""
    return F.broadcast(df) if rows <= FEW else df


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@dataclass
class Metrics:
    """Rounds, the number of pairs after each, and seconds."""

    sizes: list[int] = field(default_factory=list)
    seconds: float = 0.0
    nodes: int = 0

    @property
    def rounds(self) -> int:
        return len(self.sizes)

    @property
    def density(self) -> float:
        """The share of all pairs of nodes that the closure has."""
        return self.sizes[-1] / self.nodes**2 if self.sizes and self.nodes else 0.0


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.col(a).alias("src"), F.col(b).alias("dst"))


def compose(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs ``(a, c)`` with ``(a, b)`` in the left and ``(b, c)`` in the right."""
    return left.select("src", F.col("dst").alias("mid")).join(_pairs(right, "src", "dst").withColumnRenamed("src", "mid"), "mid").select("src", "dst")


def without(new: DataFrame, known: DataFrame) -> DataFrame:
    return new.join(known, ["src", "dst"], "left_anti")


def transitive(edges: DataFrame, sources: DataFrame | None = None, reflexive: bool = False, metrics: Metrics | None = None, target: Column | None = None) -> DataFrame:
    """``src, dst`` of every path of one edge or more.

    Without ``sources`` what is new is composed with all that is known, which
    doubles the length of paths in a round. With them (column ``src``), only
    what they reach is computed, an edge a round, and with a ``target`` only until it is
    reached. ``reflexive`` adds each node of the edges, and each source, with itself.

    A round writes what is new and nothing else; parts are put together now and then.
    """
    began = time.monotonic()
    edges = _pairs(edges, "src", "dst").where("src is not null and dst is not null")
    if sources is None:
        edges = new = checkpointed(edges.distinct())
    else:
        new = checkpointed(edges.join(sources.select("src").distinct(), "src", "left_semi").distinct())
    parts, n = [new], new.count()
    total = n
    for rounds in range(GUARD):
        if metrics is not None:
            metrics.sizes.append(total)
        if not n or target is not None and not new.where(F.col("dst") == target).isEmpty():
            break
        if rounds == 2 and sources is not None:
            edges = checkpointed(edges.distinct())  # a long way: what made the edges is not done again each round
        known = together(parts)
        step = compose(light(new, n), known if sources is None else edges).distinct()
        new = checkpointed(without(step, known))
        n = new.count()
        total += n
        if n:
            parts.append(new)
        if len(parts) > PARTS:
            parts = [checkpointed(together(parts))]
    else:
        raise RuntimeError("the closure did not settle")
    known = together(parts)
    if metrics is not None:
        metrics.seconds += time.monotonic() - began
        metrics.nodes = edges.select(F.explode(F.array("src", "dst")).alias("n")).distinct().count()
    if reflexive:
        nodes = edges.select("src").unionByName(edges.select(F.col("dst").alias("src"))) if sources is None else sources.select("src")
        known = known.unionByName(nodes.select("src", F.col("src").alias("dst"))).distinct()
    return known


def valued(edges: DataFrame, times: Callable[[Column, Column], Column], plus: Callable[[Column], Column], better: Callable[[Column, Column], Column], sources: DataFrame | None = None, metrics: Metrics | None = None) -> DataFrame:
    """``src, dst, value`` over a semiring of the caller's: ``times`` along a path of one edge or more, ``plus`` (an aggregate) over paths.

    ``better`` tells whether a value improves on another; values that cycles improve without end
    are caught by the guard on rounds.
    """
    began = time.monotonic()
    base = checkpointed(edges.groupBy("src", "dst").agg(plus(F.col("value")).alias("value")))
    best = base if sources is None else checkpointed(base.join(sources.select("src").distinct(), "src", "left_semi"))
    new, n = best, best.count()
    onward = base.select(F.col("src").alias("mid"), "dst", F.col("value").alias("~more"))
    for _ in range(GUARD):
        if metrics is not None:
            metrics.sizes.append(best.count())
        if not n:
            if metrics is not None:
                metrics.seconds += time.monotonic() - began
            return best
        step = light(new, n).select("src", F.col("dst").alias("mid"), "value").join(onward, "mid")
        step = step.groupBy("src", "dst").agg(plus(times(F.col("value"), F.col("~more"))).alias("~found"))
        gain = step.join(best, ["src", "dst"], "left").where(F.col("value").isNull() | better(F.col("~found"), F.col("value")))
        new = checkpointed(gain.select("src", "dst", F.col("~found").alias("value")))
        n = new.count()
        if n:
            best = checkpointed(best.unionByName(new).groupBy("src", "dst").agg(plus(F.col("value")).alias("value")))
    raise RuntimeError("the closure did not settle")


def best_confidence(edges: DataFrame, metrics: Metrics | None = None, sources: DataFrame | None = None) -> DataFrame:
    """``src, dst, confidence``: the best product of confidences along a path, of one edge or more.

    Confidences lie in (0, 1], so cycles don't improve a path and the rounds end. Equal edges keep the best.
    """
    bad = edges.where(~((F.col("confidence") > 0) & (F.col("confidence") <= 1)) | F.col("confidence").isNull())
    if not bad.isEmpty():
        raise ValueError("a confidence outside (0, 1]")
    rows = edges.select("src", "dst", F.col("confidence").alias("value"))
    return valued(rows, lambda a, b: a * b, F.max, lambda a, b: a > b, sources, metrics).withColumnRenamed("value", "confidence")


def crosswalk(edges: DataFrame, src: object, dst: object) -> float | None:
    """The best confidence between two nodes, from what the first reaches."""
    start = edges.sparkSession.range(1).select(F.lit(src).alias("src"))
    found = best_confidence(edges, sources=start).where(F.col("dst") == F.lit(dst)).select("confidence").first()
    return found[0] if found else None


def components(links: DataFrame) -> DataFrame:
    """``node, canon`` of each node of ``src, dst``: the least node of its component, by alternating stars."""
    edges = checkpointed(links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    nodes = links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).where("node is not null").distinct()
    last = None
    for _ in range(GUARD):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == last:
            return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("canon")), "node", "left").select("node", F.coalesce("canon", "node").alias("canon"))
        last = now
    raise RuntimeError("components did not settle")


def insert_edges(base: DataFrame, closed: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The closure after edges were added, and the pairs that are new.

    New pairs run through a new edge: what reaches its source or is it, and what
    its target reaches or is. Chains of new edges compose among themselves first.
    """
    fresh = without(_pairs(added, "src", "dst").distinct(), closed)
    through = transitive(fresh.unionByName(compose(compose(fresh, closed), fresh)).distinct()) if not fresh.isEmpty() else fresh
    before = compose(closed, through)
    after = compose(through, closed)
    around = compose(before, closed)
    new = checkpointed(without(through.unionByName(before).unionByName(after).unionByName(around).distinct(), closed))
    return closed.unionByName(new), new


def delete_edges(base: DataFrame, closed: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The closure after edges were removed from the base, and the pairs withdrawn.

    Pairs that some path through a removed edge supports are withdrawn, and
    those that the rest of the base still supports are derived again. ``base`` is
    that of before; what stays is exact for any graph, cyclic or not.
    """
    left = without(base.distinct(), removed)
    gone = _pairs(removed, "src", "dst").distinct()
    suspect = checkpointed(suspects(closed, gone))
    sure = checkpointed(without(closed, suspect))
    # derive again, from what is sure and the base that is left, the suspects that still hold
    found = checkpointed(left.join(suspect, ["src", "dst"], "left_semi"))
    known = sure.unionByName(found)
    new = known
    for _ in range(GUARD):
        step = compose(left, new).distinct().join(suspect, ["src", "dst"], "left_semi")
        new = checkpointed(without(step, known))
        if new.isEmpty():
            return known, without(suspect, known)
        known = checkpointed(known.unionByName(new))
    raise RuntimeError("the closure did not settle")


@dataclass
class Kept:
    """A closure kept under changes of its edges.

    Seeded with the edges (``of_base``), what is withdrawn is exact. Seeded with pairs that
    are closed already (``of_closed``), these count as edges of their own: sound, but a pair whose
    support goes stays if it was seeded. A change whose ``sink`` raises leaves all as it was.
    """

    base: DataFrame
    closed: DataFrame

    @staticmethod
    def of_base(edges: DataFrame) -> Kept:
        base = checkpointed(_pairs(edges, "src", "dst").distinct())
        return Kept(base, transitive(base))

    @staticmethod
    def of_closed(pairs: DataFrame) -> Kept:
        closed = checkpointed(_pairs(pairs, "src", "dst").distinct())
        return Kept(closed, closed)

    def insert(self, added: DataFrame, sink: Callable[[DataFrame], None] | None = None) -> DataFrame:
        """The pairs that are new."""
        added = _pairs(added, "src", "dst")
        closed, new = insert_edges(self.base, self.closed, added)
        base = checkpointed(self.base.unionByName(added).distinct())
        if sink is not None:
            sink(new)
        self.base, self.closed = base, checkpointed(closed)
        return new

    def delete(self, removed: DataFrame, how: str = "support", sink: Callable[[DataFrame], None] | None = None) -> tuple[DataFrame, DataFrame]:
        """The pairs withdrawn, and those that a removed edge supported and that stay.

        ``support`` looks for other support of what is suspect; ``recompute`` closes what is
        left again, from the sources of what is suspect. Both give the same.
        """
        removed = _pairs(removed, "src", "dst").distinct()
        suspect = checkpointed(suspects(self.closed, removed))
        base = checkpointed(without(self.base, removed))
        if how == "recompute":
            again = transitive(base, suspect.select("src").distinct())
            left = checkpointed(without(self.closed, suspect).unionByName(suspect.join(again, ["src", "dst"], "left_semi")))
        else:
            left = checkpointed(delete_edges(self.base, self.closed, removed)[0])
        withdrawn, survived = without(suspect, left), suspect.join(left, ["src", "dst"], "left_semi")
        if sink is not None:
            sink(withdrawn)
        self.base, self.closed = base, left
        return withdrawn, survived


def suspects(closed: DataFrame, removed: DataFrame) -> DataFrame:
    """The pairs that some path through a removed edge supports."""
    ends = removed.unionByName(compose(closed, removed)).unionByName(compose(removed, closed)).unionByName(compose(compose(closed, removed), closed)).distinct()
    return closed.join(ends, ["src", "dst"], "left_semi")


def empty_pairs(spark: SparkSession, kind: str = "string") -> DataFrame:
    return spark.createDataFrame([], f"src {kind}, dst {kind}")
