"""The SPARQL protocol over HTTP, counters, and the command line."""

from __future__ import annotations

import argparse
import threading
import time
import uuid
from collections import Counter
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .algebra import Refused
from .config import Config, load
from .engine import Engine
from .parser.rdf import Malformed
from .sources import results
from .sources.files import read_all
from .store import Store
from .update import Updater

#: Media types and the formats they stand for; the first is the default.
TYPES = {
    "application/sparql-results+xml": "xml",
    "application/sparql-results+json": "json",
    "text/csv": "csv",
    "text/tab-separated-values": "tsv",
    "application/json": "json",
    "application/xml": "xml",
}


class Metrics:
    """Counts and seconds by name, in the text format that scrapers read."""

    def __init__(self) -> None:
        self.counts: Counter[str] = Counter()
        self.seconds: Counter[str] = Counter()
        self.lock = threading.Lock()

    def record(self, name: str, seconds: float) -> None:
        with self.lock:
            self.counts[name] += 1
            self.seconds[name] += seconds

    def text(self) -> str:
        with self.lock:
            lines = [f'graphloom_requests_total{{kind="{n}"}} {c}' for n, c in sorted(self.counts.items())]
            return "\n".join(lines + [f'graphloom_request_seconds_sum{{kind="{n}"}} {s:.6f}' for n, s in sorted(self.seconds.items())]) + "\n"


def negotiate(accept: str) -> tuple[str, str]:
    """The media type and format for an Accept header, by quality and then order."""
    wanted = []
    for i, part in enumerate(accept.split(",")):
        name, *params = [p.strip() for p in part.split(";")]
        quality = next((float(p[2:]) for p in params if p.startswith("q=")), 1.0)
        wanted.append((-quality, i, name))
    for _, _, name in sorted(wanted):
        if name in TYPES:
            return name, TYPES[name]
    return next(iter(TYPES.items()))


class Service:
    """A store behind queries and updates; a query reads the version that it began with."""

    def __init__(self, spark: SparkSession, store: Store, config: Config | None = None):
        self.spark, self.store, self.config = spark, store, config or Config()
        self.metrics, self.writing = Metrics(), threading.Lock()

    def query(self, text: str, accept: str = "", strict: bool | None = None) -> tuple[str, str]:
        """Media type and body."""
        kind, parts = self.stream(text, accept, strict)
        return kind, "".join(parts)

    def stream(self, text: str, accept: str = "", strict: bool | None = None) -> tuple[str, Iterator[str]]:
        """Media type and pieces of the body, which is never held whole; rows are fetched as pieces are taken.

        The version that the query began with is pinned until its last piece.
        """
        strict = self.config.server.default_graph == "strict" if strict is None else strict
        group, limit = uuid.uuid4().hex, self.config.limits.query_timeout_s
        context = self.spark.sparkContext
        version = self.store.pin()
        timer = threading.Timer(limit, lambda: context.cancelJobsWithTag(group)) if limit else None
        context.addJobTag(group)

        def done() -> None:
            context.removeJobTag(group)
            self.store.release(version)
            if timer:
                timer.cancel()

        if timer:
            timer.start()
        try:
            kind, parts = self._answer(Engine(self.spark, self.store.at(version), strict).query(text, terms=True), accept)
            first = next(parts, "")  # faults of the plan or its first rows come before anything is sent
        except BaseException:
            done()
            raise

        def run() -> Iterator[str]:
            try:
                yield first
                yield from parts
            finally:
                done()

        return kind, run()

    def _answer(self, out: DataFrame | bool | str, accept: str) -> tuple[str, Iterator[str]]:
        kind, form = negotiate(accept)
        if isinstance(out, str):
            return "text/plain", iter([out])
        if isinstance(out, bool):
            return (kind, iter([results.ask_json(out)])) if form == "json" else (next(iter(TYPES)), iter([results.ask_xml(out)]))
        if self.config.limits.max_result_rows:
            out = out.limit(self.config.limits.max_result_rows)
        if out.columns == ["s", "p", "o"] and form not in ("json", "csv", "tsv") and "sparql-results" not in accept:
            return "application/n-triples", results.graph_lines(out)
        return kind, results.FORMATS[form](out)

    def gauges(self) -> str:
        """What the store holds, beside the counters of requests."""
        now = self.store.segments[-1]
        held = {"store_version": self.store.version, "store_segments": len(self.store.segments), "store_changes": now.size, "store_change_bytes": now.bytes, "store_pins": sum(self.store.pins.values())}
        return "".join(f"graphloom_{n} {v}\n" for n, v in held.items())

    def update(self, text: str) -> None:
        with self.writing:
            Updater(self.spark, self.store).run(text)


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args: object) -> None:
            pass

        def reply(self, status: int, kind: str = "text/plain", body: str = "") -> None:
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def pieces(self, kind: str, parts: Iterator[str]) -> None:
            """A body of unknown length: it ends where the connection does."""
            self.send_response(200)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.end_headers()
            self.close_connection = True
            for part in parts:
                self.wfile.write(part.encode())

        def body(self) -> tuple[str, dict[str, list[str]]]:
            data = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            form = self.headers.get("Content-Type", "").startswith("application/x-www-form-urlencoded")
            return ("", parse_qs(data)) if form else (data, {})

        def serve(self, path: str, text: str | None, params: dict[str, list[str]]) -> None:
            began = time.monotonic()
            kind = path.strip("/")
            try:
                if text is None:
                    self.reply(400, body=f"no {kind}")
                elif kind == "query":
                    graph = params.get("default_graph", [None])[0]
                    if graph not in (None, "union", "strict"):
                        self.reply(400, body="default_graph is union or strict")
                        return
                    media, parts = service.stream(text, self.headers.get("Accept", ""), None if graph is None else graph == "strict")
                    self.pieces(media, parts)
                else:
                    service.update(text)
                    self.reply(204)
            except (Refused, Malformed) as fault:
                service.metrics.record(f"{kind}_refused", 0)
                self.reply(400, body=str(fault))
            except Exception as fault:  # noqa: BLE001
                service.metrics.record(f"{kind}_failed", 0)
                self.reply(500, body=str(fault)[:1000])
            finally:
                service.metrics.record(kind, time.monotonic() - began)

        def do_GET(self) -> None:  # noqa: N802
            url = urlsplit(self.path)
            params = parse_qs(url.query)
            if url.path == "/metrics":
                self.reply(200, body=service.metrics.text() + service.gauges())
            elif url.path == "/query":
                self.serve("/query", params.get("query", [None])[0], params)
            else:
                self.reply(404)

        def do_POST(self) -> None:  # noqa: N802
            url = urlsplit(self.path)
            if url.path not in ("/query", "/update"):
                self.reply(404)
                return
            text, form = self.body()
            params = parse_qs(url.query) | form
            self.serve(url.path, text or params.get(url.path.strip("/"), [None])[0], params)

    return Handler


def materialised(spark: SparkSession, store: Store) -> Store:
    """The store with what follows from its default graph by OWL 2 RL."""
    from .reason.engine import materialise

    default = store.quads.where(F.col("g").isNull()).select("s", "p", "o")
    facts = materialise(default).triples.select(F.lit(None).cast("string").alias("g"), "s", "p", "o")
    store.apply(None, facts)
    return store


def main(argv: list[str] | None = None) -> None:
    """Load data, optionally infer, and serve; or answer one query and end."""
    parser = argparse.ArgumentParser(prog="graphloom")
    parser.add_argument("--data", action="append", default=[])
    parser.add_argument("--config")
    parser.add_argument("--bind")
    parser.add_argument("--materialize", action="store_true")
    parser.add_argument("--query", help="print the answer to a query and end")
    args = parser.parse_args(argv)
    flags: dict[str, object] = {}
    if args.data:
        flags["server.data"] = args.data
    if args.bind:
        flags["server.bind"] = args.bind
    if args.materialize:
        flags["server.materialise"] = True
    config = load(args.config, flags=flags)
    builder = SparkSession.builder.appName("graphloom")
    if config.spark.master:
        builder = builder.master(config.spark.master)
    if config.spark.shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", config.spark.shuffle_partitions)
    if config.spark.checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", config.spark.checkpoint_dir)
    spark = builder.getOrCreate()
    store = Store.of(read_all(spark, config.server.data))
    if config.server.materialise:
        store = materialised(spark, store)
    service = Service(spark, store, config)
    if args.query:
        print(service.query(args.query, "text/csv")[1], end="")
        return
    host, _, port = config.server.bind.rpartition(":")
    ThreadingHTTPServer((host, int(port)), handler(service)).serve_forever()


if __name__ == "__main__":
    main()
