"""Secret scan with multipart credential linking.

Three kinds are reported wherever they stand: ``assign`` (a key word with a
value), ``access`` (an access identifier) and ``hex`` (a long run of hex
digits). Weaker parts of a credential, a user name (``id``), a random-looking
token (``key``) and a host or URL (``endpoint``), are common in clean text. An
interval join links parts whose scopes, the part and ``SCOPE`` code points on
either side, overlap; a weak part is reported only if a complementary part is in its
scope: a secret for an identifier or endpoint, an identifier for a weak
secret. A weak part that a base span covers whole is left out; one that overlaps
it in part is linked like any other.

Defined results: a null or empty text has no spans; a null ``doc_id`` stays
null; repeated rows give repeated results; overlapping kinds are all kept, as
the kinds are matched one by one. Texts are scanned whole and in one pass
without a shuffle, so a hot source or a lost executor costs a task.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, doc_text, map_arrow
from .spans import SPANS, SPANS_ARROW, Span, as_dicts, base_digest, counted, joined, ordered, replaced

#: Code points on either side of a part in which its complements are looked for.
SCOPE = 120
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
ROLE = {"assign": "secret", "hex": "secret", "key": "secret", "access": "identifier", "id": "identifier", "endpoint": "endpoint"}
#: Which roles complement a weak part of a role.
NEEDS = {"identifier": ("secret",), "secret": ("identifier",), "endpoint": ("secret",)}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 24 and more; shorter runs fail, so leaving them out changes no match.
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("passw", "secret", "token", "api")
WEAK_ID = re.compile(r"""(?:user(?:_?name)?|login|account|client_?id|access_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.I | re.A)
WEAK_ENDPOINT = re.compile(r"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp)://[A-Za-z0-9._~:@/?#%&=+-]+")
WEAK_KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_=-])")


def entropy(token: str) -> float:
    """Bits a character."""
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", *m.span(), True) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span(), True) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span(), True) for m in HEX.finditer(text)]
    return found


def weak_parts(text: str) -> list[Span]:
    """Candidates that count only beside a complement."""
    found = [("id", *m.span(1), False) for m in WEAK_ID.finditer(text)] if ":" in text or "=" in text else []
    if "://" in text:
        found += [("endpoint", *m.span(), False) for m in WEAK_ENDPOINT.finditer(text)]
    return found


def weak_keys(text: str) -> list[Span]:
    return [
        ("key", *m.span(), False)
        for m in WEAK_KEY.finditer(text)
        if re.search("[0-9]", t := m[0]) and re.search("[a-z]", t) and re.search("[A-Z]", t) and entropy(t) >= 3.5
    ]


def linked(parts: list[Span]) -> list[Span]:
    """The interval join within a text: weak parts whose scope overlaps that of a complement.

    Parts of a role are sorted by start, so the one that starts last before a
    scope's end and the running maximum of ends decide; no pair is listed.
    """
    by: dict[str, tuple[list[int], list[int]]] = {}
    for role in NEEDS:
        own = sorted((a, b) for k, a, b, _ in parts if ROLE[k] == role)
        reach, top = [], -1
        for _, b in own:
            reach.append(top := max(top, b))
        by[role] = ([a for a, _ in own], reach)
    out = []
    for kind, a, b, base in parts:
        if base:
            continue
        for role in NEEDS[ROLE[kind]]:
            starts, reach = by[role]
            i = bisect_right(starts, b + 2 * SCOPE)
            if i and reach[i - 1] >= a - 2 * SCOPE:
                out.append((kind, a, b, base))
                break
    return out


def uncovered(weak: list[Span], base: list[Span]) -> list[Span]:
    """Weak parts that no base span covers whole; those that overlap one in part stay."""
    taken = sorted((a, b) for _, a, b, _ in base)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    return [s for s in weak if not (i := bisect_right(starts, s[1])) or reach[i - 1] < s[2]]


def scan(text: str) -> list[Span]:
    """Every span that is reported in a text."""
    base = base_spans(text)
    weak = weak_parts(text)
    if base or weak:
        weak += weak_keys(text)
    if weak:
        base += linked(base + uncovered(weak, base))
    return ordered(base, KINDS)


def secret_spans(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` of every document."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of(doc_id=(pa.int64(), batch.column(0)), spans=(SPANS_ARROW, [as_dicts(scan(t)) for t in batch.column(1).to_pylist()]))

    return map_arrow(doc_text(docs), step, f"doc_id long, spans {SPANS}")


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of every document."""
    s = F.col("spans")
    return secret_spans(docs).select(
        "doc_id",
        *[counted(s, k).alias(f"n_{k}") for k in KINDS[:3]],
        base_digest(s).alias("base_sha256"),
        joined(s).alias("spans"),
        F.size(F.filter(s, lambda x: ~x["base"])).cast("long").alias("n_linked"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by ``[SECRET]``; ``n_chars`` follows where it is a column.

    Every other column stays as it is. A null text stays null.
    """
    clean = F.pandas_udf(lambda texts: texts.map(_clean, na_action="ignore"), "string")
    out = docs.withColumn("text", clean(F.col("text")))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _clean(text: str) -> str:
    spans = scan(text)
    return replaced(text, [(a, b, "[SECRET]") for _, a, b, _ in spans]) if spans else text
