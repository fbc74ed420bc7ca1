"""Turtle and TriG files, cut where statements end: a file is many tasks, and none holds it whole."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.closure import checkpointed
from ..parser.rdf import _TURTLE, Malformed, Turtle
from ..store import SCHEMA

_ARROW = pa.schema([("g", pa.string()), ("s", pa.string()), ("p", pa.string()), ("o", pa.string())])
#: Characters of a piece.
PIECE = 1 << 20
_PIECES = "name string, number long, start long, seq int, text string"
#: What a line can begin in: nothing, or one of the strings that span lines; and what is left of such a string.
_REST = {q: re.compile(rf"(?:(?:{q}|{q}{q})?(?:[^{q}\\]|\\.))*{q}{{3}}", re.S) for q in "\"'"}
_STATES = ("", *_REST)
_MAY_DIRECT = re.compile(r"@prefix|@base|\b(?:prefix|base)\b", re.I)


def _tokens(text: str, at: int, end: int) -> Iterator[tuple[str, str, int]]:
    """Kind, text and end of each token; long strings that don't end are told by their quotes alone."""
    while at < end:
        m = _TURTLE.match(text, at)
        if m and text.startswith(('"""', "'''"), at) and len(m[0]) < 6:
            m = None
        if not m:
            if text.startswith(('"""', "'''"), at):
                yield "open", text[at], at + 3
                return
            raise Malformed(f"unexpected {text[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup != "space":
            yield m.lastgroup, m[0], at


def outline(text: str, state: str, closing: str) -> tuple[str, int, int]:
    """The state at the end of a piece of whole lines that begins in a state, and where its first and last statement that ends with its line end; -1 if none does.

    ``closing`` is the mark that ends a statement for sure.
    """
    long = '"""' in text or "'''" in text
    if not long and state:
        return state, -1, -1
    stretches: list[tuple[int, int]] = []
    at = 0
    while at < len(text):
        if state:
            m = _REST[state].match(text, at)
            if not m:
                break
            at, state = m.end(), ""
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if long and ('"""' in text[at:end] or "'''" in text[at:end]):
            for kind, quote, after in _tokens(text, at, end):
                if kind == "open":
                    at, state = after, quote
                    break
                if after > end:
                    at = after
                    break
            else:
                stretches.append((at, end))
                at = end + 1
            continue
        stretches.append((at, end))
        at = end + 1

    def closed(at: int, end: int) -> bool:
        line = text[at:end].rstrip()
        if not line.endswith(closing) and "#" not in line:
            return False
        last = None
        try:
            for last in _tokens(line, 0, len(line)):
                pass
        except Malformed:
            return False
        return last is not None and last[:2] == ("mark", closing)

    first = next((end for at, end in stretches if closed(at, end)), -2) + 1
    last = next((end for at, end in reversed(stretches) if closed(at, end)), -2) + 1 if first >= 0 else -1
    return state, first, last


def directives(text: str) -> list[list[str]]:
    """The directives among whole statements: name with a colon, or nothing for the base, and the IRI's token."""
    if not _MAY_DIRECT.search(text):
        return []
    out, before, need = [], "", []
    for kind, token, _ in _tokens(text, 0, len(text)):
        if need:
            need.append(token)
            if len(need) == (3 if need[0].lower().endswith("prefix") else 2):
                out.append(need[1:] if len(need) == 3 else ["", need[1]])
                need = []
        elif kind == "at" and token in ("@prefix", "@base") and before != "string" or kind == "word" and token.upper() in ("PREFIX", "BASE"):
            need = [token]
        before = kind
    return out


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The files' lines in pieces, in order within a split; cut behind a line that looks like the end of a statement, if one comes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seq, rows, size = None, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, rows, size
            piece = {"name": key[0], "number": key[1], "start": key[2], "seq": seq, "text": "\n".join(rows) + "\n"}
            seq, rows, size = seq + 1, [], 0
            return pa.RecordBatch.from_pylist([piece], schema=schema)

        schema = pa.schema([("name", pa.string()), ("number", pa.int64()), ("start", pa.int64()), ("seq", pa.int32()), ("text", pa.string())])
        for batch in batches:
            n = batch.num_rows
            own = [tuple(batch.column(c)[i].as_py() for c in (1, 2, 3)) for i in (0, n - 1)] if n else []
            # a split's lines are beside each other, so equal ends are one split
            keys = [own[0]] * n if n and own[0] == own[1] else list(zip(*[batch.column(c).to_pylist() for c in (1, 2, 3)], strict=True))
            for line, its in zip(batch.column(0).to_pylist(), keys, strict=True):
                if its != key:
                    if rows:
                        yield flush()
                    key, seq = its, 0
                rows.append(line)
                size += len(line) + 1
                if size >= PIECE and (line.rstrip().endswith((".", "}")) or size >= 4 * PIECE):
                    yield flush()
        if rows:
            yield flush()

    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.input_file_name().alias("name"), F.expr("input_file_block_start()").alias("start"))
    return lines.select("value", "name", F.xxhash64("name").alias("number"), "start").mapInArrow(cut, _PIECES)


def read_documents(spark: SparkSession, path: str | list[str], form: str, base: str = "") -> DataFrame:
    """Turtle or TriG; each file's own IRI is its base and keeps its blank nodes apart.

    The lines are written in pieces once. Of each piece, the driver gets where whole statements
    begin and end, for each state that it can begin in, and its directives; so it knows what holds where. The
    statements that lie across pieces are put together by a shuffle, and all others are read where they lie.
    A statement is held whole, and so is a block of TriG with its graph.
    """
    graphs = form == "trig"
    closing = "}" if graphs else "."
    pieces = checkpointed(_pieces(spark, path))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text, found = row.pop("text"), []
                for state in _STATES:
                    try:
                        end, first, last = outline(text, state, closing)
                        own = directives(text[first:last]) if first >= 0 else []
                    except Malformed:
                        found.append(None)  # it can't begin in that state
                        continue
                    try:
                        head = directives(text[:first]) if first >= 0 else []
                    except Malformed:
                        head = []  # it begins within a statement
                    found.append([end, first, last, head, own, bool(text[last:].strip())])
                out.append(row | {"found": json.dumps(found)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("name", pa.string()), ("number", pa.int64()), ("start", pa.int64()), ("seq", pa.int32()), ("found", pa.string())]))

    seen = sorted(pieces.mapInArrow(look, "name string, number long, start long, seq int, found string").collect(), key=lambda r: (r["name"], r["start"], r["seq"]))
    # where each piece's statements begin and end, and to which run of text across pieces its ends belong
    places: dict[tuple, tuple[int, int, int, int]] = {}
    order: list[tuple] = []
    ragged: set[int] = set()
    state, run, file, whole = "", -1, None, True
    for r in seen:
        if r["name"] != file:
            file, state, run, whole = r["name"], "", run + 1, True
            order.append(("file", file))
            order.append(("run", run))
        known = json.loads(r["found"])[_STATES.index(state)]
        if known is None:
            raise Malformed(f"{file}: a string or a character that can't be read")
        state, first, last, head, own, more = known
        key = (r["name"], r["start"], r["seq"])
        if first < 0:
            ragged.add(run)
            places[key], whole = (-1, -1, run, run), False
            continue
        if whole:  # nothing is open before it
            first, own = 0, head + own
        else:
            ragged.add(run)
        if more:
            ragged.add(run + 1)
        whole = not more
        places[key] = (first, last, run, run + 1)
        run += 1
        order.append(("piece", key, own))
        order.append(("run", run))
    runs = None
    across: dict[int, list] = {}
    if ragged:

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    first, last, before, after = places[row["name"], row["start"], row["seq"]]
                    for own, text in ((before, row["text"][:first] if first >= 0 else row["text"]), (after, row["text"][last:] if first >= 0 else "")):
                        if own in ragged and text:
                            out.append({"run": own, "name": row["name"], "number": row["number"], "start": row["start"], "seq": row["seq"], "text": text})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("run", pa.int64()), ("name", pa.string()), ("number", pa.int64()), ("start", pa.int64()), ("seq", pa.int32()), ("text", pa.string())]))

        parts = pieces.mapInArrow(ends, "run long, name string, number long, start long, seq int, text string")
        joined = F.expr("array_join(transform(array_sort(collect_list(struct(start, seq, text))), x -> x.text), '')")
        runs = checkpointed(parts.groupBy("run", "name", "number").agg(joined.alias("text")))

        def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [{"run": r["run"], "found": json.dumps(directives(r["text"]))} for r in batch.to_pylist()]
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("run", pa.int64()), ("found", pa.string())]))

        across = {r["run"]: json.loads(r["found"]) for r in runs.where(F.col("text").rlike(f"(?i){_MAY_DIRECT.pattern}")).select("run", "name", "number", "text").mapInArrow(direct, "run long, found string").collect()}
    # what prefixes and base hold where
    holding: list[tuple[dict[str, str], str]] = []
    at: dict[object, int] = {}
    now = Turtle("")
    for step in order:
        if step[0] == "file":
            now = Turtle("", base or step[1])
            holding.append(({}, now.base))
            continue
        at[step[1]] = len(holding) - 1
        own = across.get(step[1], []) if step[0] == "run" else step[2]
        for name, token in own:
            if name:
                now.prefixes[name[:-1]] = now.resolve(token)
            else:
                now.base = now.resolve(token)
        if own and (now.prefixes, now.base) != holding[-1]:
            holding.append((dict(now.prefixes), now.base))

    def statements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if "run" in row:
                    text, mark, (prefixes, own) = row["text"], f"r{row['run']}.", holding[at[row["run"]]]
                else:
                    key = (row["name"], row["start"], row["seq"])
                    first, last, *_ = places[key]
                    if first < 0:
                        continue
                    text, mark, (prefixes, own) = row["text"][first:last], f"{row['start']}.{row['seq']}.", holding[at[key]]
                quads = Turtle(text, own, f"f{row['number'] & 0xFFFFFFFFFFFFFFFF:x}.", graphs, prefixes, mark).quads()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*quads, strict=True)] if quads else [pa.array([], pa.string())] * 4, schema=_ARROW)

    out = pieces.mapInArrow(statements, SCHEMA)
    return out if runs is None else out.unionByName(runs.mapInArrow(statements, SCHEMA))
