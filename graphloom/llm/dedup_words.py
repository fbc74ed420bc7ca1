"""Removal of repeated word sequences, decided by partitioned suffix trees.

Every word covered by a window of ``WINDOW`` words that also starts earlier, in a
document with a smaller id or before it in its own, is removed. ``repeats`` brings windows that
may be equal together, by anchors, each distinct context once a block. The suffixes of a bucket's contexts
are split by prefixes of variable length into groups of at
most ``GROUP``; each group's subtree is built down to ``WINDOW`` words, and its nodes at that
depth are the repeats. Hashes of words route; the trees compare the words themselves, by numbers
that a dictionary of the bucket's distinct words gives them.

Defined results: null, empty and blank texts have no words; shorter texts than ``WINDOW``
words lose nothing; rows that share an id are read as one document's, so that the
place in each counts (equal places tie and both stay); a null id comes after all others; no
documents give no rows; other columns are dropped, whatever their names; a very long text is cut,
compared part by part and put together again, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from .common import SPACE, span_hashes
from .repeats import Parts, Shape, least_ranks, remove_repeats
from .suffixes import deep_nodes, prefix_groups, spread

WINDOW, GRAM, GROUP = 20, 8, 1 << 15
#: The blank, and bytes that are looked through at once for one.
_BLANK, _LOOK = 0x20, 1 << 12


def settle(parts: Parts, none: int) -> np.ndarray:
    """Each window's least rank, by the subtrees of prefix groups."""
    out = np.full(int(parts.windows.sum()), none, dtype=np.int64)
    split = b"".join(parts.data).split()
    known = dict(zip(dict.fromkeys(split), count(), strict=False))
    words = np.fromiter(map(known.__getitem__, split), dtype=np.int64, count=len(split))
    sizes = parts.windows + WINDOW - 1
    begin = np.cumsum(sizes) - sizes
    starts = np.repeat(begin, parts.windows) + spread(parts.windows)
    number = np.zeros(len(words), dtype=np.int64)
    number[starts] = np.arange(len(out))
    owner = np.repeat(np.arange(len(sizes)), parts.windows)
    for own in prefix_groups(words, starts, WINDOW, GROUP):
        order, node = deep_nodes(words, own, WINDOW)
        mine = number[own[order]]
        of = owner[mine]
        out[mine] = least_ranks(parts.rank[of], parts.several[of], np.flatnonzero(np.append(True, node[1:] != node[:-1])), none)
    return out


def _cuts(raw: np.ndarray) -> np.ndarray:
    """Where words that end with a blank each begin, and beyond the last."""
    return np.append(0, np.flatnonzero(raw == _BLANK) + 1)


def _values(raw: np.ndarray) -> np.ndarray:
    cuts = _cuts(raw)
    return span_hashes(raw, cuts[:-1], cuts[1:] - 1)


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    raw = np.frombuffer(b"".join([b" ".join(words) + b" " for words in split if words]), dtype=np.uint8)
    return _values(raw), raw, _cuts(raw), np.cumsum([0, *map(len, split)])


def _parts(raw: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """Parts end between words, and take a window's words from either side."""

    def edge(at: int) -> int:
        while at < len(raw):
            blank = np.flatnonzero(SPACE[raw[at : at + _LOOK]])
            if len(blank):
                return at + int(blank[0])
            at += _LOOK
        return len(raw)

    a, base, tail = 0, 0, []
    while a < len(raw):
        b = edge(min(a + repeats.PART, len(raw)))
        words = raw[a:b].tobytes().split()
        ahead, end = [], b
        while len(ahead) < WINDOW and end < len(raw):  # the last of these may be cut, and is not taken
            end = edge(min(end + _LOOK, len(raw)))
            ahead = raw[b:end].tobytes().split()
        yield base - len(tail), len(tail), len(words), b" ".join([*tail, *words, *ahead[: WINDOW - 1]])
        base += len(words)
        tail = [*tail, *words][-(WINDOW - 1) :]
        a = b


def _keep(raw: bytes, gone: np.ndarray) -> bytes:
    words = raw.split()
    return b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()] if len(gone) else words)


SHAPE = Shape(WINDOW, GRAM, True, _tokens, _values, _cuts, settle, _parts, _keep, b" ")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts and the words that stay, one blank apart, of every document."""
    return remove_repeats(docs, SHAPE, False).drop("spans").toDF("doc_id", "n_words", "n_removed", "kept")


def repeats_digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, SHAPE, True).drop("spans").toDF("doc_id", "n_words", "n_removed", "kept_sha256")
