"""Incremental maintenance: Z-sets, delta rules, ticks of assertions and retractions, the change feed and snapshots."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.closure import FEW, GUARD, PARTS, Kept, checkpointed, light, together
from .reason.engine import fixpoint
from .reason.evaluate import delta_steps, derived_again, pattern, step
from .reason.rules import Rule

KEY = ["s", "p", "o"]
#: Changes, as a share of a table's rows, from which they are put into it.
FOLD = 0.25
FEED = "s string, p string, o string, mult long, time long, kind string, rule string"


# Z-sets: rows and how often they are there, zero rows left out


def consolidated(z: DataFrame) -> DataFrame:
    """Equal rows added up."""
    keys = [c for c in z.columns if c != "mult"]
    return z.groupBy(*keys).agg(F.sum("mult").alias("mult")).where("mult <> 0")


def zset(df: DataFrame) -> DataFrame:
    return consolidated(df.withColumn("mult", F.lit(1).cast("long")))


def plus(a: DataFrame, b: DataFrame) -> DataFrame:
    return consolidated(a.unionByName(b))


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return plus(a, b.withColumn("mult", -F.col("mult")))


def present(z: DataFrame) -> DataFrame:
    """Rows that are there: a row taken away more often than put in is absent."""
    return z.where("mult > 0").drop("mult")


def linear(delta: DataFrame, rule: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A rule of one pattern acts on the change alone."""
    return consolidated(rule(delta))


def product(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """The join of two Z-sets: multiplicities multiply."""
    left, right = a.withColumnRenamed("mult", "~l"), b.withColumnRenamed("mult", "~r")
    return consolidated(left.join(right, on).withColumn("mult", F.col("~l") * F.col("~r")).drop("~l", "~r"))


def bilinear(a: DataFrame, da: DataFrame, b: DataFrame, db: DataFrame, on: list[str]) -> DataFrame:
    """The change of a join: ``dA * B + A * dB + dA * dB``."""
    return plus(plus(product(da, b, on), product(a, db, on)), product(da, db, on))


def rule_full(rule: Rule, z: DataFrame) -> DataFrame:
    """The head of a rule over a Z-set, each row as often as it is derived."""
    return _weighted(rule, [z] * len(rule.body))


def rule_delta(rule: Rule, z: DataFrame, dz: DataFrame) -> DataFrame:
    """The change of a rule's head: old rows before the place that takes the change, new ones behind it."""
    after = plus(z, dz)
    n = len(rule.body)
    return consolidated(reduce(DataFrame.unionByName, [_weighted(rule, [z] * i + [dz] + [after] * (n - 1 - i)) for i in range(n)]))


def _weighted(rule: Rule, sources: list[DataFrame]) -> DataFrame:
    """Left-deep joins with multiplicities."""
    df, bound = None, {}
    for i, (z, slots) in enumerate(zip(sources, rule.body, strict=True)):
        own, names = pattern(z.withColumn("s", F.col("s")), slots, i)
        # the triple itself finds its multiplicity
        counted = own.join(z.select(F.struct("s", "p", "o").alias(f"~{i}"), F.col("mult").alias(f"m{i}")), f"~{i}").drop(f"~{i}")
        if df is None:
            df = counted
        else:
            on = [F.col(bound[k]) == F.col(v) for k, v in names.items() if k in bound]
            df = df.join(counted, reduce(lambda a, b: a & b, on)) if on else df.crossJoin(counted)
        bound = {**names, **bound}
    total = reduce(lambda a, b: a * b, [F.col(f"m{i}") for i in range(len(sources))])
    head: list[Column] = [(F.lit(s) if isinstance(s, str) else F.col(bound[s.name])).alias(c) for c, s in zip("spo", rule.head, strict=True)]
    return consolidated(df.select(*head, total.alias("mult")))


# ticks


@dataclass
class Keyed:
    """A table of facts with one value each, as a base and the changes since; the last change of a fact tells.

    Changes are kept beside the base, and put into a new one when they are more than ``FOLD`` of it.
    """

    base: DataFrame
    value: str
    rows: int = 0
    events: list[DataFrame] = field(default_factory=list)
    changed: int = 0

    @property
    def empty(self) -> bool:
        return not self.rows and not self.events

    def overlay(self) -> DataFrame:
        if len(self.events) == 1:  # a change has each fact once
            return self.events[0].select(*KEY, self.value, "there")
        last = F.max_by(F.struct(self.value, "there"), "at").alias("x")
        return together(self.events).groupBy(*KEY).agg(last).select(*KEY, f"x.{self.value}", "x.there")

    def current(self) -> DataFrame:
        if not self.events:
            return self.base
        over = self.overlay()
        there = over.where("there").select(*KEY, self.value)
        if not self.rows:
            return there
        return self.base.join(light(over.select(*KEY), self.changed), KEY, "left_anti").unionByName(there)

    def lookup(self, keys: DataFrame, n: int) -> DataFrame:
        """The rows of some facts: the base is scanned, and shuffled only if they are many."""
        asked = light(keys.select(*KEY), n)
        found = self.base.join(asked, KEY, "left_semi")
        if not self.events:
            return found
        over = self.overlay().join(asked, KEY, "left_semi")
        there = over.where("there").select(*KEY, self.value)
        return found.join(over, KEY, "left_anti").unionByName(there) if self.rows else there

    def write(self, rows: DataFrame) -> int:
        """Facts with their new value, and ``there`` false for those that go."""
        part = checkpointed(rows.select(*KEY, self.value, "there", F.lit(len(self.events)).alias("at")))
        n = part.count()
        if n:
            self.events.append(part)
            self.changed += n
            if self.changed > max(FEW, FOLD * self.rows) or len(self.events) > 4 * PARTS:
                first = not self.rows and len(self.events) == 1  # these are in a checkpoint of their own
                self.base = self.current() if first else checkpointed(self.current())
                self.rows, self.events, self.changed = self.base.count(), [], 0
        return n


@dataclass
class Circuit:
    """Facts kept current under assertions and retractions.

    A tick takes what was logged since the last one. Retracted facts take with them
    all that was derived through them; what the survivors still derive comes
    back, so facts that only support each other in a cycle go. Only net changes
    are published. What is there depends on the log alone, not on its ticks.

    A tick looks up, joins and writes what is touched. The facts are scanned as the other side of those
    joins, and are neither shuffled nor rewritten while what is touched is small.
    """

    spark: SparkSession
    rules: list[Rule]
    time: int = 0
    feed: list[DataFrame] = field(default_factory=list)
    asserted: Keyed | None = None
    known: Keyed | None = None
    #: Rows that the last tick wrote.
    written: int = 0
    _log: list[DataFrame] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.asserted is None:
            self.asserted = Keyed(self.spark.createDataFrame([], "s string, p string, o string, mult long"), "mult")
            self.known = Keyed(self.spark.createDataFrame([], "s string, p string, o string, rule string"), "rule")

    @property
    def base(self) -> DataFrame:
        return self.asserted.current()

    @property
    def facts(self) -> DataFrame:
        return self.known.current()

    def assert_(self, triples: DataFrame) -> None:
        self.log(triples.select(*KEY, F.lit(1).cast("long").alias("mult")))

    def retract(self, triples: DataFrame) -> None:
        self.log(triples.select(*KEY, F.lit(-1).cast("long").alias("mult")))

    def log(self, changes: DataFrame) -> None:
        """Signed changes ``s, p, o, mult``."""
        self._log.append(changes.select(*KEY, F.col("mult").cast("long").alias("mult")))

    def _once(self, known: DataFrame, new: DataFrame) -> DataFrame | None:
        """What the rules give with at least one new fact."""
        dirty = {r["p"] for r in new.select("p").distinct().collect()}
        steps = [s.select(*KEY, "rule") for r in self.rules for s in delta_steps(r, known, new, dirty)]
        return self._least(together(steps)) if steps else None

    def _least(self, found: DataFrame) -> DataFrame:
        """Each fact once, with the first of its rules by name: by their numbers, which are grouped without a sort."""
        names = F.array(*[F.lit(n) for n in sorted({r.name for r in self.rules})])
        least = found.groupBy(*KEY).agg(F.min(F.array_position(names, F.col("rule"))).alias("~rule"))
        return least.select(*KEY, F.element_at(names, F.col("~rule").cast("int")).alias("rule"))

    def _grow(self, known: DataFrame, new: DataFrame, within: DataFrame | None = None) -> list[DataFrame]:
        """``new`` and all that follows from it and what is known, or as much of it as is ``within``, in parts."""
        parts, n = [new], new.count()
        for _ in range(GUARD):
            if not n:
                return parts
            whole = known.select(*KEY).unionByName(together(parts).select(*KEY))
            found = self._once(whole, light(new.select(*KEY), n))
            if found is None:
                return parts
            found = found.join(whole, KEY, "left_anti")
            if within is not None:
                found = found.join(within, KEY, "left_semi")
            new = checkpointed(found)
            n = new.count()
            parts.append(new)
            if len(parts) > PARTS:
                parts = [checkpointed(together(parts))]
        raise RuntimeError("the rules did not settle")

    def tick(self) -> DataFrame:
        """Apply the log and publish the net changes of this tick."""
        self.time += 1
        self.written = 0
        if not self._log:
            empty = self.spark.createDataFrame([], FEED)
            self.feed.append(empty)
            return empty
        delta = checkpointed(consolidated(together(self._log)))
        self._log = []
        n = delta.count()
        new = self.known.empty
        if self.asserted.empty:
            touched = delta.select(*KEY, F.lit(0).alias("old"), "mult")
        else:
            was = self.asserted.lookup(delta, n).withColumnRenamed("mult", "old")
            touched = checkpointed(delta.join(was, KEY, "left").select(*KEY, F.coalesce("old", F.lit(0)).alias("old"), (F.coalesce("old", F.lit(0)) + F.col("mult")).alias("mult")))
        self.written += self.asserted.write(touched.withColumn("there", F.col("mult") != 0))
        gone, come = touched.where("old > 0 and mult <= 0").select(*KEY), touched.where("old <= 0 and mult > 0").select(*KEY)
        before = self.known.current()
        none = F.lit(None).cast("string").alias("rule")
        dead, back = self._shrunk(before, gone)
        left = before if dead is None else before.join(dead, KEY, "left_anti")
        held = left if back is None else left.unionByName(back)
        there = before if new else held.join(light(come, n), KEY, "left_semi")
        fresh = checkpointed((come if new else come.join(there, KEY, "left_anti")).select(*KEY, none))
        grown = together(self._grow(held, fresh))
        if back is not None:
            grown = grown.unionByName(back.join(grown.select(*KEY), KEY, "left_anti"))
        # facts that were derived and are asserted now lose their rule
        after = checkpointed(grown.unionByName(there.select(*KEY, none).join(grown.select(*KEY), KEY, "left_anti")).withColumn("there", F.lit(True)))
        changes = after
        if dead is not None:
            changes = after.unionByName(dead.join(after, KEY, "left_anti").select(*KEY, none, F.lit(False).alias("there")))
        changes = checkpointed(changes)
        if new:
            old = before
        else:
            # of the changes only what was logged or went can have been there
            asked, n = (come, come.count()) if dead is None else (come.unionByName(dead), come.count() + dead.count())
            asked, n = (changes.join(F.broadcast(asked), KEY, "left_semi"), n) if n <= FEW else (changes, changes.count())
            old = checkpointed(self.known.lookup(asked, n))
        self.written += self.known.write(changes)
        out = self._published(old, changes.where("there").drop("there"))
        self.feed.append(out)
        return out

    def _shrunk(self, before: DataFrame, gone: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        """What goes with the retracted facts, and what of it the others still give: over-delete, then derive again."""
        gone = checkpointed(gone)
        n = gone.count()
        if not n:
            return None, None
        now = present(self.asserted.current())
        known, parts, new = before.select(*KEY), [gone], gone
        for _ in range(GUARD):
            found = self._once(known, light(new, n))
            if found is None:
                break
            found = found.select(*KEY).join(known, KEY, "left_semi")
            new = checkpointed(found.join(together(parts), KEY, "left_anti").join(now, KEY, "left_anti"))
            n = new.count()
            if not n:
                break
            parts.append(new)
            if len(parts) > PARTS:
                parts = [checkpointed(together(parts))]
        dead = checkpointed(together(parts))
        left = before.join(dead, KEY, "left_anti")
        again = [derived_again(r, left.select(*KEY), dead).select(*KEY, "rule") for r in self.rules]
        if not again:
            return dead, None
        back = self._least(together(again)).join(dead, KEY, "left_semi")
        return dead, checkpointed(together(self._grow(left, checkpointed(back), within=dead)))

    def _published(self, before: DataFrame, after: DataFrame) -> DataFrame:
        def side(a: DataFrame, b: DataFrame, mult: int) -> DataFrame:
            kind = F.when(F.col("rule").isNull(), "asserted").otherwise("inferred")
            return a.join(b, KEY, "left_anti").select(*KEY, F.lit(mult).cast("long").alias("mult"), F.lit(self.time).cast("long").alias("time"), kind.alias("kind"), "rule")

        n = before.count()
        near = after.join(F.broadcast(before.select(*KEY)), KEY, "left_semi") if n <= FEW else after
        return checkpointed(side(before, near, -1).unionByName(side(after, light(before, n), 1)))

    def snapshot(self, time: int) -> DataFrame:
        """The facts as of a time: the feed up to it, or the facts of now without the feed since, whichever is shorter."""
        if 2 * time > self.time:
            later = self.feed[time:]
            if not later:
                return self.facts.select(*KEY)
            net = consolidated(together(later).select(*KEY, "mult"))
            return self.facts.select(*KEY).join(net.where("mult > 0"), KEY, "left_anti").unionByName(net.where("mult < 0").select(*KEY))
        parts = self.feed[:time]
        if not parts:
            return self.facts.limit(0).select(*KEY)
        return present(consolidated(together(parts).select(*KEY, "mult")))

    def weights(self) -> DataFrame:
        """How often each rule derives each fact in one step."""
        steps = [step(r, [self.facts.select(*KEY)] * len(r.body)).select(*KEY, "rule") for r in self.rules]
        return together(steps).groupBy(*KEY, "rule").agg(F.count(F.lit(1)).alias("weight"))

    def recomputed(self) -> DataFrame:
        """The facts from nothing: what a tick must agree with."""
        return fixpoint(present(self.base), self.rules).triples

    def validate(self) -> None:
        """The facts equal the recomputed ones and the feed's sum."""
        fed = present(consolidated(together(self.feed).select(*KEY, "mult")))
        own = checkpointed(self.facts.select(*KEY))
        for other in (self.recomputed(), fed):
            if not own.exceptAll(other).isEmpty() or not other.exceptAll(own).isEmpty():
                raise AssertionError("the circuit is out of step")


@dataclass
class ClosurePlan:
    """One transitive predicate kept by its closure in place of rules.

    ``retract`` tells what is withdrawn and what is promoted: asserted pairs that went and that the
    others still entail, which are inferred from then on.
    """

    predicate: str
    kept: Kept

    @staticmethod
    def over(triples: DataFrame, predicate: str) -> ClosurePlan:
        return ClosurePlan(predicate, Kept.of_base(_edges(triples, predicate)))

    def _facts(self, pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("src").alias("s"), F.lit(self.predicate).alias("p"), F.col("dst").alias("o"))

    def facts(self) -> DataFrame:
        """``s, p, o, asserted``."""
        own = self.kept.base.withColumn("asserted", F.lit(True))
        pairs = self.kept.closed.join(own, ["src", "dst"], "left")
        return pairs.select(F.col("src").alias("s"), F.lit(self.predicate).alias("p"), F.col("dst").alias("o"), F.coalesce("asserted", F.lit(False)).alias("asserted"))

    def insert(self, triples: DataFrame) -> DataFrame:
        """The facts that are new."""
        return self._facts(self.kept.insert(_edges(triples, self.predicate)))

    def retract(self, triples: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The facts withdrawn, and those promoted."""
        removed = checkpointed(_edges(triples, self.predicate).join(self.kept.base, ["src", "dst"], "left_semi"))
        withdrawn, survived = self.kept.delete(removed)
        return self._facts(withdrawn), self._facts(removed.join(survived, ["src", "dst"], "left_semi"))


def _edges(triples: DataFrame, predicate: str) -> DataFrame:
    return triples.where(F.col("p") == predicate).select(F.col("s").alias("src"), F.col("o").alias("dst"))


@dataclass
class Journal:
    """A circuit's changes and states in a shared folder, from which it is resumed after a restart.

    Each batch's changes are written before they are applied, under the batch's number; a state is written
    every ``every`` batches and replaces the changes up to it. A folder counts once it is whole.
    """

    spark: SparkSession
    path: str
    every: int = 16

    def _numbers(self, kind: str) -> list[int]:
        """The numbers of the folders of a kind that were written whole."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [f.getPath() for f in fs.listStatus(root)]
        return sorted(int(p.getName()) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")) or fs.exists(jvm.org.apache.hadoop.fs.Path(p, "whole/_SUCCESS")))

    def append(self, number: int, changes: DataFrame) -> DataFrame:
        """Write a batch's changes, and give them as they were written."""
        path = f"{self.path}/log/{number:012d}"
        changes.select(*KEY, F.col("mult").cast("long").alias("mult")).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def checkpoint(self, circuit: Circuit, number: int) -> None:
        path = f"{self.path}/state/{number:012d}"
        circuit.base.write.mode("overwrite").parquet(f"{path}/base")
        circuit.facts.write.mode("overwrite").parquet(f"{path}/facts")
        self.spark.createDataFrame([(circuit.time,)], "time long").write.mode("overwrite").parquet(f"{path}/whole")

    def resume(self, rules: list[Rule]) -> tuple[Circuit, int]:
        """The circuit as of the last batch that was written, and that batch's number (-1: none)."""
        states = self._numbers("state")
        circuit, last = Circuit(self.spark, rules), -1
        if states:
            last = states[-1]
            path = f"{self.path}/state/{last:012d}"
            # copies, for the folder goes with the next state while the circuit still reads them
            base, facts = checkpointed(self.spark.read.parquet(f"{path}/base")), checkpointed(self.spark.read.parquet(f"{path}/facts"))
            time = self.spark.read.parquet(f"{path}/whole").first()["time"]
            start = facts.select(*KEY, F.lit(1).cast("long").alias("mult"), F.lit(time).cast("long").alias("time"), F.when(F.col("rule").isNull(), "asserted").otherwise("inferred").alias("kind"), "rule")
            feed = [*[self.spark.createDataFrame([], FEED) for _ in range(time - 1)], start] if time else []
            circuit = Circuit(self.spark, rules, time, feed, Keyed(base, "mult", base.count()), Keyed(facts, "rule", facts.count()))
        for number in self._numbers("log"):
            if number > last:
                circuit.log(self.spark.read.parquet(f"{self.path}/log/{number:012d}"))
                circuit.tick()
                last = number
        return circuit, last

    def tidy(self) -> None:
        """Drop the changes and states that the last state replaces."""
        states = self._numbers("state")
        if states:
            fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
            old = [("state", n) for n in states[:-1]] + [("log", n) for n in self._numbers("log") if n <= states[-1]]
            for kind, n in old:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{n:012d}"), True)
