"""Quads: a DataFrame ``g, s, p, o`` of stored terms, the default graph's ``g`` null; scopes, scans, statistics, versions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .algebra import Dataset, Refused
from .mapping import connected, match
from .operators.closure import FEW, checkpointed
from .operators.joins import Relation
from .plans.values import Val
from .terms import RDF_TYPE, Term, Var

SCHEMA = "g string, s string, p string, o string"
#: Graphs under this prefix are read only by name and never written by updates.
RESERVED = "<urn:graphloom:"


class QuadGraph:
    """A source of patterns over quads and a dataset clause.

    Without a clause the default graph is the set union of all graphs that aren't
    reserved, or with ``strict`` the unnamed one alone.
    """

    def __init__(self, quads: DataFrame, dataset: Dataset | None = None, strict: bool = False):
        self.quads, self.dataset, self.strict = quads, dataset or Dataset(), strict
        self.spark: SparkSession = quads.sparkSession

    def named(self) -> DataFrame:
        """The quads of graphs that GRAPH ranges over."""
        q = self.quads.where(F.col("g").isNotNull())
        return q.where(F.col("g").isin(self.dataset.named)) if self.dataset.given else q.where(~F.col("g").startswith(RESERVED))

    def graphs(self) -> DataFrame:
        """The graphs that hold a quad."""
        return self.named().select("g").distinct()

    def scope(self, scope: tuple) -> DataFrame:
        """``s, p, o`` of a scope, and ``g`` if it is a variable's; sets of triples."""
        if scope[0] == "graph":
            if self.dataset.given and scope[1] not in self.dataset.named:
                return self.quads.limit(0).select("s", "p", "o")
            return self.quads.where(F.col("g") == scope[1]).select("s", "p", "o")
        if scope[0] == "var":
            return self.named().select("s", "p", "o", "g")
        if self.dataset.given:
            return self.quads.where(F.col("g").isin(self.dataset.default)).select("s", "p", "o").distinct()
        if self.strict:
            return self.quads.where(F.col("g").isNull()).select("s", "p", "o")
        return self.quads.where(F.col("g").isNull() | ~F.col("g").startswith(RESERVED)).select("s", "p", "o").distinct()

    def triples_of(self, resources: DataFrame) -> Relation:
        """The triples of the default scope whose subject is in column ``s``."""
        df = self.scope(("default",)).join(resources.select("s").distinct(), "s", "left_semi")
        return Relation(df.select("s", "p", "o"), {c: Val("term", F.col(c)) for c in "spo"})

    def predicate_counts(self, scope: tuple) -> DataFrame:
        """``p, n``: the triples of each predicate."""
        return self.scope(scope).groupBy("p").agg(F.count(F.lit(1)).alias("n"))

    def bgp(self, patterns: list[tuple], scope: tuple) -> Relation:
        df = self.scope(scope)
        r = Relation(df, {c: Val("term", F.col(c)) for c in df.columns})
        graph = (Var(scope[1]),) if scope[0] == "var" else ()
        return connected([match(r, (*t, *graph)) for t in patterns], self.spark)


def scan(quads: DataFrame, g: str | None = None, s: str | None = None, p: str | None = None, o: str | None = None, order: str = "spo", places: bool = False) -> DataFrame:
    """Quads by any of their terms, in any of the six orders; or with their ``place`` in it as a column, from 0."""
    if sorted(order) != sorted("spo"):
        raise Refused(f"no order {order}")
    for name, term in (("g", g), ("s", s), ("p", p), ("o", o)):
        if term is not None:
            quads = quads.where(F.col(name) == term)
    return numbered(quads, *order) if places else quads.orderBy(*order)


def top_predicates(quads: DataFrame, n: int) -> DataFrame:
    """The most frequent predicates."""
    return quads.groupBy("p").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p").limit(n)


def graph_sizes(quads: DataFrame) -> DataFrame:
    return quads.groupBy("g").agg(F.count(F.lit(1)).alias("n"))


def statistics(quads: DataFrame) -> DataFrame:
    """For each predicate its triples, distinct subjects and objects, and the highest number of objects of a subject."""
    degree = quads.groupBy("p", "s").agg(F.count(F.lit(1)).alias("d"))
    subjects = degree.groupBy("p").agg(F.sum("d").alias("triples"), F.count(F.lit(1)).alias("subjects"), F.max("d").alias("max_degree"))
    objects = quads.groupBy("p").agg(F.count_distinct("o").alias("objects"))
    return subjects.join(objects, "p").select("p", "triples", "subjects", "objects", "max_degree")


def characteristic_sets(quads: DataFrame, most: int = 1024) -> DataFrame:
    """Sets of predicates that subjects have together, the most frequent first; all beyond ``most`` sets are one last row, whose ``predicates`` is null."""
    sets = quads.groupBy("s").agg(F.array_sort(F.collect_set("p")).alias("predicates"), F.count(F.lit(1)).alias("n"))
    counts = checkpointed(sets.groupBy("predicates").agg(F.count(F.lit(1)).alias("subjects"), F.sum("n").alias("triples")))
    first = counts.orderBy(F.desc("subjects"), "predicates").limit(most)
    rest = counts.join(first.select("predicates"), "predicates", "left_anti").agg(F.sum("subjects").alias("subjects"), F.sum("triples").alias("triples")).where("subjects > 0")
    return first.unionByName(rest.select(F.lit(None).cast("array<string>").alias("predicates"), "subjects", "triples"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with their place in an order, from 0, as ``place``: by ranges, of which the driver gets the sizes alone."""
    parts = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("~part"), F.monotonically_increasing_id().alias("~row")))
    # an id is the partition in its upper bits and the row in its lower ones
    offsets, at = [], 0
    for part, n in sorted((r["~part"], r["count"]) for r in parts.groupBy("~part").count().collect()):
        offsets.append((part, at))
        at += n
    known = F.broadcast(rows.sparkSession.createDataFrame(offsets, "`~part` int, `~before` long"))
    return parts.join(known, "~part").select(*rows.columns, (F.col("~before") + F.col("~row").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


def dictionary(quads: DataFrame) -> DataFrame:
    """``id, term`` for each distinct term, ids from 1 in term order: no single task sorts all terms. ``n`` is how often it stands, ``g`` and ``p`` whether as a graph or predicate."""
    uses = quads.select(F.posexplode(F.array("g", "s", "p", "o")).alias("at", "term")).where("term is not null")
    terms = uses.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("at") == 0).alias("g"), F.bool_or(F.col("at") == 2).alias("p"))
    return numbered(terms, "term").select((F.col("place") + 1).alias("id"), "term", "n", "g", "p")


#: Uses from which a term is broadcast, and the share of all uses from which it is however large the input: so these are few.
HOT, HOT_SHARE = 1 << 16, 1e-4


def looked_up(rows: DataFrame, c: str, terms: DataFrame, by: str, to: str, hot: DataFrame) -> DataFrame:
    """Rows with the term or id in column ``c`` replaced, null if it is none: the hot ones by broadcast, and only the others by a shuffle, where each task gets its share."""
    few = F.broadcast(hot.select(F.col(by).alias(c), F.col(to).alias("~few")))
    spread = F.xxhash64(*rows.columns)
    none = F.concat(F.lit("~"), spread.cast("string")) if by == "term" else -F.abs(F.shiftright(spread, 1)) - 1
    own = rows.join(few, c, "left").withColumn("~key", F.when(F.col("~few").isNull() & F.col(c).isNotNull(), F.col(c)).otherwise(none)).drop(c)
    found = own.join(terms.select(F.col(by).alias("~key"), F.col(to).alias("~many")), "~key", "left")
    return found.select(*[F.coalesce("~few", "~many").alias(c) if name == c else F.col(name) for name in rows.columns])


def hot_terms(terms: DataFrame) -> DataFrame:
    """The entries of a dictionary that stand so often that they may not be a key of a shuffle."""
    uses = terms.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return terms.where(F.col("n") > max(HOT, int(HOT_SHARE * uses)))


def _translated(quads: DataFrame, terms: DataFrame, by: str, to: str) -> DataFrame:
    hot, out = hot_terms(terms), quads.select("g", "s", "p", "o")
    for c in "gpso":
        own = terms.where(c) if c in "gp" else None
        if own is not None and own.count() <= FEW:
            few = F.broadcast(own.select(F.col(by).alias(c), F.col(to).alias("~few")))
            out = out.join(few, c, "left").select(*[F.col("~few").alias(c) if name == c else F.col(name) for name in out.columns])
        else:
            out = looked_up(out, c, terms, by, to, hot)
    return out


def encode_ids(quads: DataFrame, terms: DataFrame) -> DataFrame:
    """Quads of ids; the default graph is 0."""
    out = _translated(quads, terms, "term", "id")
    return out.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in "gspo"])


def decode_ids(ids: DataFrame, terms: DataFrame) -> DataFrame:
    return _translated(ids, terms, "id", "term")


def reserved(graph: str | None) -> bool:
    return graph is not None and graph.startswith(RESERVED)


def has_type(quads: DataFrame, kind: Term) -> DataFrame:
    return quads.where((F.col("p") == RDF_TYPE) & (F.col("o") == kind.stored)).select("s").distinct()


#: Bytes of terms up to which a change is broadcast against the base, measured before each join.
SMALL = 16 << 20
#: Rows of the overlay, as a share of the base's, from which both are folded into a new base.
FOLD = 0.25
#: Bytes of terms that a task gets where more than ``SMALL`` of them are grouped.
SHARE = 16 << 20
_QUAD = ["g", "s", "p", "o"]
_BYTES = "octet_length(g) + octet_length(s) + octet_length(p) + octet_length(o)"


def _keyed(quads: DataFrame) -> DataFrame:
    """Quads with the default graph as the empty name, so that they join on equality."""
    return quads.select(F.coalesce("g", F.lit("")).alias("g"), "s", "p", "o")


def _named(quads: DataFrame) -> DataFrame:
    return quads.select(F.nullif(F.col("g"), F.lit("")).alias("g"), "s", "p", "o")


def dealt(quads: DataFrame, size: int) -> DataFrame:
    """Quads of so many bytes dealt out by their terms, so that there are more tasks and not larger ones where there are more bytes."""
    return quads.repartition(-(-size // SHARE), *_QUAD) if size > SMALL else quads


def _measured(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of terms."""
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.expr(_BYTES)), F.lit(0))).first()
    return row[0], row[1]


@dataclass
class Segment:
    """A base and the changes since, as events: ``g, s, p, o, mult, version`` with ``mult`` 1 or -1."""

    base: DataFrame
    since: int
    #: Rows and bytes of the base, once they were asked for.
    held: tuple[int, int] | None = None
    events: list[tuple[int, DataFrame]] = field(default_factory=list)
    size: int = 0
    bytes: int = 0

    def measured(self) -> tuple[int, int]:
        if self.held is None:
            self.held = _measured(self.base)
        return self.held

    def changed(self, version: int) -> DataFrame | None:
        """The events up to a version."""
        parts = [df.select(*_QUAD, "mult", "version") for v, df in self.events if v <= version]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def started(self, base: DataFrame) -> DataFrame:
        """Rows of the base as events before all others."""
        return base.select(*_QUAD, F.lit(1).alias("mult"), F.lit(-1).alias("version"))

    def visible(self, version: int) -> DataFrame:
        """The quads as of a version, keyed: the last event of each tells whether it is there."""
        events = self.changed(version)
        if events is None:
            return self.base
        last = F.max_by("mult", "version").alias("mult")
        if self.bytes > SMALL:
            whole = dealt(self.started(self.base).unionByName(events), self.measured()[1] + self.bytes)
            return whole.groupBy(*_QUAD).agg(last).where("mult > 0").select(*_QUAD)
        over = events.groupBy(*_QUAD).agg(last)
        kept = self.base.join(F.broadcast(over.select(*_QUAD)), _QUAD, "left_anti")
        return kept.unionByName(over.where("mult > 0").select(*_QUAD))


class Store:
    """The state of a dataset over time: a batch of changes is a version, and each version can be read.

    A change is stored as its own events beside the base, which is neither shuffled nor
    rewritten while changes are small: they are broadcast against it if their measured size
    allows. Once the events are more than ``FOLD`` of the base, both are folded into a new
    base; earlier versions are read from the old one until ``compact`` drops it. A
    pinned version is not dropped.
    """

    def __init__(self, quads: DataFrame, version: int = 0):
        self.version = version
        self.segments = [Segment(_keyed(quads), version)]
        self.pins: dict[int, int] = {}
        self._prepared = False

    @staticmethod
    def empty(spark: SparkSession) -> Store:
        return Store(spark.createDataFrame([], SCHEMA))

    @staticmethod
    def of(quads: DataFrame) -> Store:
        return Store(quads.select(*_QUAD).distinct())

    @property
    def quads(self) -> DataFrame:
        return self.at(self.version)

    def _segment(self, version: int) -> Segment:
        found = [s for s in self.segments if s.since <= version]
        if not found or version > self.version:
            raise Refused(f"no version {version}")
        return found[-1]

    def at(self, version: int) -> DataFrame:
        """The quads as of a version."""
        return _named(self._segment(version).visible(version))

    def prepare(self) -> None:
        """The base is read by every change and its pattern, so what made it is cut off once, before the first."""
        if not self._prepared:
            now = self.segments[-1]
            now.base, self._prepared = checkpointed(now.base), True

    def apply(self, deletions: DataFrame | None, additions: DataFrame | None) -> tuple[int, int]:
        """``S' = (S - D) + A``: deletions first; counts of real changes. Nothing real is no new version."""
        self.prepare()
        now = self.segments[-1]
        sides = [_keyed(df).select("*", F.lit(name == "in_a").alias("add")) for df, name in ((deletions, "in_d"), (additions, "in_a")) if df is not None]
        if not sides:
            return 0, 0
        asked = checkpointed(reduce(DataFrame.unionByName, sides))
        size, weight = _measured(asked)
        if not size:
            return 0, 0
        here, most = now.base, now.bytes + weight
        if weight <= SMALL:
            here, most = here.join(F.broadcast(asked.select(*_QUAD)), _QUAD, "left_semi"), most + weight
        else:
            most += now.measured()[1]
        state = now.started(here)
        if now.events:
            state = state.unionByName(now.changed(self.version))
        # one grouping of the base, the events and what is asked; a quad that is taken away and put in is put in
        rows = state.withColumn("add", F.lit(None).cast("boolean")).unionByName(asked.select(*_QUAD, F.lit(None).cast("int").alias("mult"), F.lit(None).cast("int").alias("version"), "add"))
        change = dealt(rows, most).groupBy(*_QUAD).agg(F.max("add").alias("add"), F.max_by("mult", "version").alias("mult")).where("add <> (coalesce(mult, -1) > 0)")
        events = checkpointed(change.select(*_QUAD, F.when(F.col("add"), 1).otherwise(-1).alias("mult"), F.lit(self.version + 1).alias("version")))
        row = events.agg(F.count_if(F.col("mult") < 0), F.count_if(F.col("mult") > 0), F.coalesce(F.sum(F.expr(_BYTES)), F.lit(0))).first()
        counts = (row[0], row[1])
        if any(counts):
            self.version += 1
            now.events.append((self.version, events))
            now.size += sum(counts)
            now.bytes += row[2]
            self._fold(now)
        return counts

    def _fold(self, now: Segment) -> None:
        if now.size < 1 << 16 and now.bytes <= SMALL:
            return
        if now.size > FOLD * now.measured()[0]:
            self.segments.append(Segment(checkpointed(now.visible(self.version)), self.version))

    def pin(self, version: int | None = None) -> int:
        """Hold a version for a reader until it is released."""
        version = self.version if version is None else version
        self._segment(version)
        self.pins[version] = self.pins.get(version, 0) + 1
        return version

    def release(self, version: int) -> None:
        self.pins[version] -= 1
        if not self.pins[version]:
            del self.pins[version]

    def compact(self, keep: int = 0) -> None:
        """Forget the versions before the last ``keep``, but none that is pinned: events up to there become the base."""
        first = min([max(self.segments[0].since, self.version - keep), *self.pins])
        own = self._segment(first)
        later = [(v, df) for v, df in own.events if v > first]
        if first > own.since:
            fresh = Segment(checkpointed(own.visible(first)), first)
            fresh.events = later
            if later:
                fresh.size, fresh.bytes = _measured(reduce(DataFrame.unionByName, [df for _, df in later]).select(*_QUAD))
            own = fresh
        self.segments = [own, *(s for s in self.segments if s.since > first)]
        self._prepared = True

    def changes(self) -> DataFrame:
        """The change feed: quads with ``mult`` 1 or -1 and the version."""
        out = self.segments[0].base.limit(0).select(*_QUAD, F.lit(1).alias("mult"), F.lit(0).alias("version"))
        for segment in self.segments:
            for _, df in segment.events:
                out = out.unionByName(df)
        return out.withColumn("g", F.nullif(F.col("g"), F.lit("")))

    def intervals(self) -> DataFrame:
        """Every quad that was there at a version that is kept, with the versions of which it is: ``begin <= version < end``.

        ``end`` is null while it is there.
        """
        first = self.segments[0]
        start = first.base.select(*_QUAD, F.lit(1).alias("mult"), F.lit(first.since).alias("version"))
        marks = reduce(DataFrame.unionByName, [start, *(df for s in self.segments for _, df in s.events)])
        steps = F.array_sort(F.collect_list(F.struct("version", "mult")))
        ends = F.expr("filter(transform(steps, (x, i) -> struct(x.mult as mult, x.version as begin, get(steps, i + 1).version as end)), y -> y.mult > 0)")
        out = marks.groupBy(*_QUAD).agg(steps.alias("steps")).select(*_QUAD, F.explode(ends).alias("x"))
        return out.select(F.nullif(F.col("g"), F.lit("")).alias("g"), "s", "p", "o", "x.begin", "x.end")


def visible(intervals: DataFrame, version: int) -> DataFrame:
    """The quads of a version among those with ``begin`` and ``end``."""
    return intervals.where((F.col("begin") <= version) & (F.col("end").isNull() | (F.col("end") > version))).select("g", "s", "p", "o")
