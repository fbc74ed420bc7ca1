"""A graph object in the shape of the common Python RDF interface."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .parser.rdf import parse, to_ntriples, to_turtle
from .parser.sparql import parse_query
from .sources.results import FORMATS, graph_lines, term_of
from .store import SCHEMA, Store
from .terms import Term, literal, parse_stored
from .terms import iri as URIRef  # noqa: N812
from .update import Updater

Triple = tuple[Term, Term, Term]


class Namespace(str):
    """``ns.name`` and ``ns["name"]`` are IRIs."""

    def __getattr__(self, name: str) -> Term:
        if name.startswith("__"):
            raise AttributeError(name)
        return URIRef(self + name)

    def __getitem__(self, name: str) -> Term:
        return URIRef(self + name)


def as_term(value: object) -> Term | None:
    return value if value is None or isinstance(value, Term) else literal(value)


class Result:
    """A query's result: ``type``, ``vars``, length, truth, and rows as tuples of terms (None where unbound)."""

    def __init__(self, type: str, answer: DataFrame | bool | str):  # noqa: A002
        self.type, self.answer = type, answer

    @property
    def frame(self) -> DataFrame:
        if not isinstance(self.answer, DataFrame):
            raise TypeError(f"{self.type} has no rows")
        return self.answer

    @property
    def vars(self) -> list[str]:
        return list(self.answer.columns) if isinstance(self.answer, DataFrame) else []

    def __len__(self) -> int:
        return self.answer.count() if isinstance(self.answer, DataFrame) else 1

    def __bool__(self) -> bool:
        return not self.answer.isEmpty() if isinstance(self.answer, DataFrame) else bool(self.answer)

    def __iter__(self) -> Iterator[object]:
        if not isinstance(self.answer, DataFrame):
            yield self.answer
            return
        for row in self.answer.toLocalIterator():
            yield tuple(term_of(cell) for cell in row)

    @property
    def bindings(self) -> Iterator[dict[str, Term]]:
        """Rows as dicts of what is bound."""
        for row in self:
            yield {n: t for n, t in zip(self.vars, row, strict=True) if t is not None}

    def serialize(self, format: str = "json") -> Iterator[str]:  # noqa: A002
        """Pieces of text in a result format, or N-Triples for graphs."""
        return graph_lines(self.frame) if format in ("nt", "ntriples") else FORMATS[format](self.frame)


class Graph:
    """A default graph on Spark: ``add``, ``remove``, patterns, queries, updates, parsing and serialising.

    Single additions wait and are written together before the next read.
    """

    def __init__(self, spark: SparkSession, store: Store | None = None):
        self.spark, self.store = spark, store or Store.empty(spark)
        self.prefixes: dict[str, str] = {}
        self._waiting: list[tuple] = []

    def bind(self, prefix: str, namespace: str) -> None:
        self.prefixes[prefix] = str(namespace)

    def namespaces(self) -> list[tuple[str, str]]:
        return sorted(self.prefixes.items())

    def add(self, triple: Triple) -> Graph:
        self._waiting.append((None, *(as_term(t).stored for t in triple)))
        return self

    def __iadd__(self, triples: object) -> Graph:
        for t in triples:
            self.add(t)
        return self

    def flush(self) -> None:
        if self._waiting:
            rows, self._waiting = self._waiting, []
            self.store.apply(None, self.spark.createDataFrame(rows, SCHEMA))

    def match(self, triple: tuple) -> DataFrame:
        self.flush()
        df = self.store.quads.where(F.col("g").isNull())
        for name, t in zip("spo", map(as_term, triple), strict=True):
            if t is not None:
                df = df.where(F.col(name) == t.stored)
        return df

    def remove(self, triple: tuple) -> Graph:
        self.store.apply(self.match(triple), None)
        return self

    def triples(self, triple: tuple = (None, None, None)) -> Iterator[Triple]:
        for row in self.match(triple).toLocalIterator():
            yield tuple(parse_stored(row[c]) for c in "spo")

    def __iter__(self) -> Iterator[Triple]:
        return self.triples()

    def __contains__(self, triple: tuple) -> bool:
        return not self.match(triple).isEmpty()

    def __len__(self) -> int:
        return self.match((None, None, None)).count()

    def _distinct(self, column: str, triple: tuple) -> Iterator[Term]:
        for row in self.match(triple).select(column).distinct().toLocalIterator():
            yield parse_stored(row[0])

    def subjects(self, predicate: Term | None = None, object: Term | None = None) -> Iterator[Term]:  # noqa: A002
        return self._distinct("s", (None, predicate, object))

    def predicates(self, subject: Term | None = None, object: Term | None = None) -> Iterator[Term]:  # noqa: A002
        return self._distinct("p", (subject, None, object))

    def objects(self, subject: Term | None = None, predicate: Term | None = None) -> Iterator[Term]:
        return self._distinct("o", (subject, predicate, None))

    def value(self, subject: Term | None = None, predicate: Term | None = None, object: Term | None = None, default: object = None) -> object:  # noqa: A002
        triple = (subject, predicate, object)
        column = "spo"[triple.index(None)]
        row = self.match(triple).orderBy(column).select(column).first()
        return parse_stored(row[0]) if row else default

    def parse(self, data: str, format: str = "turtle", base: str = "") -> Graph:  # noqa: A002
        for _, s, p, o in parse(data, format, base):
            self._waiting.append((None, s, p, o))
        return self

    def serialize(self, format: str = "turtle") -> str:  # noqa: A002
        rows = [(r["s"], r["p"], r["o"]) for r in self.match((None, None, None)).orderBy("s", "p", "o").toLocalIterator()]
        return to_turtle(rows, self.prefixes) if format in ("turtle", "ttl", "n3") else to_ntriples(rows)

    def query(self, text: str) -> DataFrame | bool | str:
        self.flush()
        return Engine(self.spark, self.store.quads, prefixes=self.prefixes).query(text)

    def result(self, text: str) -> Result:
        """The same with its type, variables, length and rows as terms."""
        self.flush()
        return Result(parse_query(text, prefixes=self.prefixes).form.upper(), Engine(self.spark, self.store.quads, prefixes=self.prefixes).query(text, terms=True))

    def update(self, text: str) -> Graph:
        self.flush()
        Updater(self.spark, self.store, self.prefixes).run(text)
        return self
