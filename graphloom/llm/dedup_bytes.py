"""Removal of repeated byte strings, decided by suffix arrays.

Every byte covered by a ``WINDOW``-byte string that also starts in a document with a
smaller id is removed. ``repeats`` brings strings that may be equal together, by anchors.
The contexts of an anchor, each distinct one once a block, are the strings of one text; its suffixes are
sorted by the linear grouping construction, and neighbours in the suffix array with
``WINDOW`` equal bytes are one string. As all contexts of an anchor hold it, it is one
symbol there, and so are each few bytes behind it.

Many anchors have few contexts, and those texts are sorted in step (``suffix_arrays``),
``BATCH`` symbols at a time; a text longer than ``LONG`` is sorted by itself.

Defined results: null and empty texts, and texts shorter than ``WINDOW``, lose nothing;
ids that repeat don't remove each other (ties); a null id comes after all others;
strings never cross documents, and overlapping repeats are removed together; no
documents give no rows; other columns are dropped, whatever their names; a very long text is cut,
compared part by part and put together again, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from .common import _BYTE, joined_text
from .repeats import Parts, Shape, least_ranks, remove_repeats
from .suffixes import spread, suffix_array, suffix_arrays

WINDOW, GRAM = 50, 24
#: Symbols that are sorted in step; symbols of a text that is sorted by itself.
BATCH, LONG = 1 << 17, 1 << 15
#: Symbol of the anchor; bytes are one more than they are, 0 ends a string, and ``PACK`` bytes behind the anchor are one symbol above.
ANCHOR, PACK = 257, 5


def settle(parts: Parts, none: int) -> np.ndarray:
    """Each window's least rank, by suffix arrays."""
    out = np.full(int(parts.windows.sum()), none, dtype=np.int64)
    first = np.cumsum(parts.windows) - parts.windows
    raw = np.frombuffer(b"".join(parts.data), dtype=np.uint8)
    begin = np.cumsum(parts.windows + WINDOW - 1) - (parts.windows + WINDOW - 1)
    for whole in (False, True):
        chosen = np.flatnonzero(parts.whole == whole)
        if not len(chosen):
            continue
        if whole:
            keys = [parts.gram[chosen]]
        else:  # the anchors themselves, in words of eight bytes
            at = begin[chosen] + parts.lead[chosen]
            keys = list(np.ascontiguousarray(raw[at[:, None] + np.arange(GRAM)]).view("<u8").T)
        order = np.lexsort(keys)
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
        text = np.cumsum(new) - 1
        each = np.full(len(order), 1 + WINDOW // PACK) if whole else parts.lead[chosen[order]] + 2 + (WINDOW - GRAM) // PACK
        size = np.bincount(text, each).astype(np.int64)
        by_size = np.argsort(size, kind="stable")  # texts of about one size take about as many steps
        turn = np.empty(len(size), dtype=np.int64)
        turn[by_size] = np.arange(len(size))
        again = np.argsort(turn[text], kind="stable")
        chosen, text = chosen[order][again], turn[text][again]
        total = np.cumsum(size[by_size])
        lone = np.flatnonzero(size[by_size] > LONG)
        edges = np.unique(np.concatenate([np.searchsorted(total, np.arange(BATCH, total[-1], BATCH)), lone, [0, len(size)]]))
        rows = np.searchsorted(text, edges)
        for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            _settle_texts(parts, raw, begin, first, chosen[lo:hi], text[lo:hi], whole, none, out)
    return out


def _settle_texts(parts: Parts, raw: np.ndarray, begin: np.ndarray, first: np.ndarray, own: np.ndarray, text: np.ndarray, whole: bool, none: int, out: np.ndarray) -> None:
    """Sort the suffixes of texts, each of the strings with one number, and write their windows' least ranks.

    Windows begin before the anchor or with it, so what follows it has the same alignment in all
    strings, and ``PACK`` bytes of it are one symbol: packed symbols are in the order of their bytes.
    """
    windows = parts.windows[own]
    left = np.zeros(len(own), dtype=np.int64) if whole else parts.lead[own]
    tail = begin[own] + left + (0 if whole else GRAM)
    packs = -(-(begin[own] + windows + WINDOW - 1 - tail) // PACK)
    length = left + (not whole) + packs
    opens = np.ones(len(own), dtype=np.int64)  # a 0 before each string, and one after each text
    opens[1:] += text[1:] != text[:-1]
    start = np.cumsum(opens) + np.cumsum(length) - length
    symbols = np.zeros(int(start[-1] + length[-1]) + 1, dtype=np.int64)
    inside = spread(left)
    symbols[np.repeat(start, left) + inside] = raw[np.repeat(begin[own], left) + inside].astype(np.int64) + 1
    if not whole:
        symbols[start + left] = ANCHOR
    inside = spread(packs)
    at, end = np.repeat(tail, packs) + PACK * inside, np.repeat(begin[own] + windows + WINDOW - 1, packs)
    packed = np.zeros(len(at), dtype=np.int64)
    for _ in range(PACK):
        packed = packed * ANCHOR + np.where(at < end, raw[np.minimum(at, len(raw) - 1)].astype(np.int64) + 1, 0)
        at += 1
    symbols[np.repeat(start + left + (not whole), packs) + inside] = packed + ANCHOR
    fresh = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    edges = np.append(start[fresh] - 1, len(symbols))
    if len(edges) == 2 and len(symbols) > LONG:
        order = np.array(suffix_array([*(symbols + 1).tolist(), 0]), dtype=np.int64)[1:]
    else:
        order = suffix_arrays(symbols, edges)
    number = np.full(len(symbols), -1, dtype=np.int64)
    number[np.repeat(start, windows) + spread(windows)] = np.arange(int(windows.sum()))
    order = number[order]
    order = order[order >= 0]
    part = np.repeat(own, windows)[order]
    inside = spread(windows)[order]
    rows = np.lib.stride_tricks.sliding_window_view(raw, WINDOW)[begin[part] + inside].view(f"V{WINDOW}").ravel()
    new = np.ones(len(order), dtype=bool)
    new[1:] = rows[1:] != rows[:-1]
    out[first[part] + inside] = least_ranks(parts.rank[part], parts.several[part], np.flatnonzero(new), none)


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, None, np.ndarray]:
    raw, offsets = joined_text(texts)
    return _BYTE[raw], raw, None, offsets


def _parts(raw: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """Parts end between characters, and take a window's bytes from either side."""

    def edge(at: int, step: int) -> int:
        while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += step
        return min(max(at, 0), len(raw))

    edges = [edge(at, 1) for at in range(0, len(raw), repeats.PART)] + [len(raw)]
    for a, b in zip(edges, edges[1:], strict=False):
        lo, hi = edge(a - WINDOW, -1), edge(b + WINDOW, 1)
        yield lo, a - lo, b - a, raw[lo:hi].tobytes()


def _keep(raw: bytes, gone: np.ndarray) -> bytes:
    return np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes() if len(gone) else raw


SHAPE = Shape(WINDOW, GRAM, False, _tokens, lambda raw: _BYTE[raw], lambda raw: np.arange(len(raw) + 1), settle, _parts, _keep, b"")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts and the bytes that stay of every document."""
    return remove_repeats(docs, SHAPE, False).toDF("doc_id", "n_bytes", "n_removed", "n_spans", "kept")


def repeats_digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, SHAPE, True).toDF("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
