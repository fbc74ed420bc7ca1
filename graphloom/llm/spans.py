"""Spans in texts: the column they travel in and the digest of it."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: (kind, start, end, base): code points, end exclusive.
Span = tuple[str, int, int, bool]
SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def ordered(spans: Iterable[Span], kinds: tuple[str, ...]) -> list[Span]:
    """By start, then kind as listed, then end."""
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2]))


def as_dicts(spans: list[Span]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b, "base": base} for k, a, b, base in spans]


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_digest(spans: Column) -> Column:
    return F.sha2(joined(F.filter(spans, lambda s: s["base"])), 256)


def replaced(text: str, spans: Iterable[tuple[int, int, str]]) -> str:
    """The text with each span replaced; spans that overlap are replaced together, by the first's word."""
    out, at, merged = [], 0, []
    for start, end, word in sorted(spans):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, word])
    for start, end, word in merged:
        out += [text[at:start], word]
        at = end
    return "".join([*out, text[at:]])
