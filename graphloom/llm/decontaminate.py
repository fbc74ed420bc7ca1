"""Benchmark decontamination by size-partitioned MinHash containment search.

An item's shingles are its ``SHINGLE``-word sequences (a shorter item's only
shingle is all its words), and a document holds an item if at least ``THRESHOLD`` of the
item's distinct shingles are among the document's. Items are partitioned by
size in powers of two. A partition's signature is each item's smallest shingle hashes,
``floor((1 - THRESHOLD) * largest size) + 1`` of them: a document that holds an item
lacks fewer shingles than that, so it has one of the signature whichever
hashes those are, and no item is missed however long the document is. Documents
are probed against all signatures in one scan, and candidates are verified by
their words.

The benchmark is broadcast in blocks whose text is about ``BLOCK_BYTES`` long, measured before;
documents are scanned once a block and never shuffled.

Words are runs of letters and digits after Unicode case folding, so that a
copy in capitals is found in any language (characters beyond ASCII count as
letters). Defined results: null texts and texts without
words, on either side, match nothing; repeated items and documents give
repeated rows; a null id stays null; an empty table gives no rows; a very long
text is searched in pieces, with the same result; other columns are dropped by
``find_leaks``, whatever their names. An item of fewer than ``SHINGLE`` words is found wherever its
words stand together, but ``drop_leaks`` drops a document for it only if the document has no
other words: such an item is a phrase that clean documents have too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEPARATOR, batch_of, doc_text, joined_text, mix64, span_hashes, text_chunks, word_spans

SHINGLE, THRESHOLD = 5, 0.8
BLOCK_BYTES = 16 << 20
#: Characters from which a text is searched in pieces.
LONG = 1 << 20
_BREAK, _WORD = re.compile(r"[\x00-/:-@\[-`{-\x7f]"), re.compile(r"[^\x00-/:-@\[-`{-\x7f]+")
_STEP = np.uint64(0xD1342543DE82EF95)
LEAKS = "doc_id long, item_id long, n_item long, n_shared long, containment double"


def shingle_hashes(word_hash: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the sequences of ``n`` words that lie within a document, and the number of each one's first word."""
    count = len(word_hash) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        h = word_hash[:count].copy()
        for k in range(1, n):
            h = h * _STEP + word_hash[k : k + count]
    at = np.flatnonzero(doc[:count] == doc[n - 1 :])
    return mix64(h[at]), at


def text_pieces(text: str) -> Iterator[str]:
    """A text in pieces of about ``LONG`` characters that end between words; each begins with the last ``SHINGLE - 1`` words of the one before."""
    a, done, last = 0, 0, []
    while True:
        edge = _BREAK.search(text, done + LONG)
        end = edge.start() if edge else len(text)
        yield text[a:end]
        if end == len(text):
            return
        last = [*last, *(m.start() for m in _WORD.finditer(text, done, end))][1 - SHINGLE :]
        a, done = last[0] if last else end, end


class Words:
    """Words of joined texts and their hashes."""

    def __init__(self, texts: list[str]):
        self.raw, offsets = joined_text([t.casefold() for t in texts])
        self.starts, self.stops, self.doc = word_spans(self.raw, offsets, SEPARATOR) if len(self.raw) else (np.empty(0, dtype=np.int64),) * 3
        self.hashes = span_hashes(self.raw, self.starts, self.stops)

    def shingles(self, lo: int, hi: int, n: int) -> set[tuple[bytes, ...]]:
        """Shingles, as words, of the words from ``lo`` to ``hi``."""
        words = [self.raw[a:b].tobytes() for a, b in zip(self.starts[lo:hi].tolist(), self.stops[lo:hi].tolist(), strict=True)]
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


class Index:
    """Signatures of the items, by size partition and shingle length."""

    def __init__(self, items: list[tuple[int | None, str | None]], threshold: float = THRESHOLD, shingle: int = SHINGLE):
        self.ids, self.texts = [i for i, _ in items], [t or "" for _, t in items]
        self.threshold = threshold
        self.sets: list[set[tuple[bytes, ...]]] = []
        self.lengths: list[int] = []
        self.hashes: list[np.ndarray] = []
        probes: dict[int, list[tuple[int, int]]] = {}
        for number, (_, text) in enumerate(items):
            words = Words([text or ""])
            n = min(shingle, len(words.starts))
            h = np.unique(shingle_hashes(words.hashes, words.doc, n)[0]) if n else np.empty(0, dtype=np.uint64)
            self.sets.append(words.shingles(0, len(words.starts), n) if n else set())
            self.lengths.append(n)
            self.hashes.append(h)
            if n:
                largest = (1 << len(h).bit_length()) - 1
                probes.setdefault(n, []).extend((int(x), number) for x in h[: int((1 - threshold) * largest + 1e-9) + 1])
        self.probes = {}
        for n, found in probes.items():
            found.sort()
            keys = np.array([k for k, _ in found], dtype=np.uint64)
            seen = np.zeros(1 << 20, dtype=bool)
            seen[keys >> np.uint64(44)] = True
            self.probes[n] = (keys, np.array([i for _, i in found], dtype=np.int64), seen)

    def candidates(self, words: Words) -> set[tuple[int, int]]:
        """(text, item) that share a signature hash."""
        pairs: set[tuple[int, int]] = set()
        for n, (keys, numbers, seen) in self.probes.items():
            h, at = shingle_hashes(words.hashes, words.doc, n)
            some = np.flatnonzero(seen[h >> np.uint64(44)])
            first = np.searchsorted(keys, h[some], side="left")
            last = np.searchsorted(keys, h[some], side="right")
            for k, a, b in zip(words.doc[at[some[last > first]]].tolist(), first[last > first].tolist(), last[last > first].tolist(), strict=True):
                pairs.update((k, i) for i in numbers[a:b].tolist())
        return pairs

    def leaks_of_long(self, text: str) -> list[tuple[int, int, int]]:
        """The same for one long text, piece by piece: memory follows the piece, and not the text."""
        found = sorted({i for piece in text_pieces(text) for _, i in self.candidates(Words([piece]))})
        hits: dict[int, set] = {i: set() for i in found}
        for piece in text_pieces(text) if found else ():
            words = Words([piece])
            for n in {self.lengths[i] for i in found}:
                own = words.shingles(0, len(words.starts), n)
                for i in found:
                    if self.lengths[i] == n:
                        hits[i] |= self.sets[i] & own
        return [(i, len(self.sets[i]), len(h)) for i, h in hits.items() if len(h) >= self.threshold * len(self.sets[i]) - 1e-9]

    def leaks(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, item, the item's shingles, shared shingles) of every pair over the threshold."""
        out = []
        for lo, hi in text_chunks(texts):
            if hi - lo == 1 and len(texts[lo]) > LONG:
                out += [(lo, *found) for found in self.leaks_of_long(texts[lo])]
                continue
            words = Words(texts[lo:hi])
            edges = np.searchsorted(words.doc, np.arange(hi - lo + 1))
            pairs = self.candidates(words)
            sets: dict[tuple[int, int], set] = {}
            for k, i in sorted(pairs):
                n = self.lengths[i]
                if (k, n) not in sets:
                    sets = {key: v for key, v in sets.items() if key[0] == k} | {(k, n): words.shingles(edges[k], edges[k + 1], n)}
                shared = len(self.sets[i] & sets[k, n])
                if shared >= self.threshold * len(self.sets[i]) - 1e-9:
                    out.append((lo + k, i, len(self.sets[i]), shared))
        return out


def _words(text: str) -> list[str]:
    return _WORD.findall(text.casefold())


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items, a bounded block at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // BLOCK_BYTES + 1
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        yield [tuple(r) for r in items.where(of == b).collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    rows, context = doc_text(docs), docs.sparkSession.sparkContext

    def searched(items: list) -> DataFrame:
        shared = context.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = index.leaks(batch.column(1).to_pylist())
                yield batch_of(
                    doc_id=(pa.int64(), [ids[k] for k, _, _, _ in found]),
                    item_id=(pa.int64(), [index.ids[i] for _, i, _, _ in found]),
                    n_item=(pa.int64(), [n for _, _, n, _ in found]),
                    n_shared=(pa.int64(), [s for _, _, _, s in found]),
                    containment=(pa.float64(), [s / n for _, _, n, s in found]),
                )

        return rows.mapInArrow(run, LEAKS)

    return reduce(DataFrame.unionByName, map(searched, item_blocks(benchmark)))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    context = docs.sparkSession.sparkContext
    for items in item_blocks(benchmark):
        shared = context.broadcast(items)
        built: list[Index] = []

        def clean(texts, shared=shared, built=built):  # noqa: ANN001, ANN202
            if not built:
                built.append(Index(shared.value))
            own = texts.tolist()
            held = {k for k, i, _, _ in built[0].leaks(own) if built[0].lengths[i] >= SHINGLE or _words(own[k]) == _words(built[0].texts[i])}
            return texts.index.to_series().map(lambda k, first=texts.index[0]: k - first not in held)

        docs = docs.where(F.pandas_udf(clean, "boolean")(F.coalesce(F.col("text"), F.lit(""))))
    return docs
