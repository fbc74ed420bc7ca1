"""Windows that repeat across documents: routing, exchange and cover.

Both repeat removers ask of every window of ``window`` tokens whether the same
tokens also start elsewhere, earlier. To compare all windows all would
have to be shuffled. Instead each window is represented by its anchor, the
``gram``-token piece inside it with the least hash: equal windows have equal
anchors at the same place. Consecutive windows with one anchor are a run. Anchors only
route: whether two windows are equal is decided by ``settle``, which is the
operator's own suffix structure, and without its answer nothing is removed.

The texts are dealt into blocks of about ``BLOCK`` bytes by a hash of the id, in one
shuffle that three steps read, over as many partitions as there are blocks:

1. A block sends the hashes of its distinct anchors, packed in as few bytes
   as keep chance repeats rare; a bucket answers with two bits for each hash: whether
   another block has it, and whether it is hot. Most of a corpus ends here.
2. A block sends the contexts of its runs with a repeated anchor, each distinct
   context once with its least place in the block and whether it has several there, so
   copies and hot passages are combined before the shuffle. A bucket drops windows whose
   hash occurs once and that no block has twice, settles the others, and answers with the
   least place of each window that repeats.
3. A block applies the answers to its texts.

An anchor is hot if it may have more than about ``HOT`` contexts. Its windows are routed
one by one, each by its own hash, so a hot anchor is spread over all buckets, and one
key holds a row a block at most.

A text longer than ``PART`` is cut into parts that overlap by a window on either side, which are
compared like texts of their own, each at its place; what stays of them is put together
at the end. So a long text is held whole only where it is read and where it is written.

Packed rows make the exchange a few bytes a run. An id's place is ``(doc_id, position)``;
null ids come last and tie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, doc_text, mix64, sha_hex, text_chunks
from .suffixes import spread

#: Bytes of text in a block; buckets for each block; window starts, and bytes of contexts, that are looked at together: work arrays of these stay in a core's cache.
BLOCK, BUCKETS, SEGMENT, SLICE = 8 << 20, 2, 1 << 15, 1 << 15
#: Bytes of a text from which it is cut, and of each part without what it shares with its neighbours.
PART = 4 << 20
#: Shuffle partitions at most; there is one for each block up to here, and beyond each holds several blocks, one after another.
PARTITIONS = 1 << 15
#: Blocks that hold an anchor, and runs beyond ``FEW`` a block, from which it is hot.
HOT, FEW = 1 << 12, 8
NO_ID = np.iinfo(np.int64).max
_STEP = 0xD1342543DE82EF95
_PLACE = np.uint64((1 << 24) - 1)


@dataclass
class Parts:
    """Pieces of contexts, all of whose windows may repeat."""

    #: The bytes of each.
    data: list[bytes]
    #: Windows, rank of the place, whether the rank's block has several places, anchor hash, tokens before the anchor.
    windows: np.ndarray
    rank: np.ndarray
    several: np.ndarray
    gram: np.ndarray
    lead: np.ndarray
    #: Whether the anchor is the whole window.
    whole: np.ndarray


#: Each window's least rank if it repeats, and else the number given.
Settle = Callable[[Parts, int], np.ndarray]


@dataclass(frozen=True)
class Shape:
    """What is compared: tokens, in windows; ``within`` if an earlier place in the same document counts."""

    window: int
    gram: int
    within: bool
    #: Token hashes, the tokens' bytes, where each begins there and beyond the last (``None``: a token is a byte), and each text's first token.
    tokens: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]]
    #: Token hashes of tokens' bytes.
    values: Callable[[np.ndarray], np.ndarray]
    #: Where each token begins in tokens' bytes, and beyond the last.
    cuts: Callable[[np.ndarray], np.ndarray]
    settle: Settle
    #: A long text's parts: tokens before the part's first, tokens shared with the part before, own tokens, and the text.
    parts: Callable[[np.ndarray], Iterator[tuple[int, int, int, bytes]]]
    #: What stays of tokens' bytes, and what stands between parts of it.
    keep: Callable[[bytes, np.ndarray], bytes]
    glue: bytes


def gram_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive tokens, by doubling."""
    count = len(values) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    done, out, size, power = 0, None, 1, values
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                tail = power[done : done + count]
                out = tail.copy() if out is None else out * np.uint64(pow(_STEP, size, 1 << 64)) + tail
                done += size
            if size * 2 > n:
                break
            power = power[:-size] * np.uint64(pow(_STEP, size, 1 << 64)) + power[size:]
            size *= 2
    return mix64(out)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


@dataclass
class Runs:
    """Runs of windows with one anchor, in token positions."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    gram: np.ndarray
    doc: np.ndarray


def find_runs(values: np.ndarray, offsets: np.ndarray, shape: Shape) -> Runs:
    """The runs of joined documents; windows don't cross from one to the next."""
    w, parts = shape.window, []
    whole = np.ones(len(values), dtype=bool)
    for a, b in zip(np.maximum(offsets[:-1], offsets[1:] - w + 1).tolist(), offsets[1:].tolist(), strict=True):
        whole[a:b] = False
    for lo in range(0, len(values) - w + 1, SEGMENT):
        hi = min(lo + SEGMENT, len(values) - w + 1)
        gram = gram_hashes(values[lo : hi + w - 1], shape.gram)
        least = sliding_least((gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64), w - shape.gram + 1)
        start = np.flatnonzero(whole[lo:hi])
        if not len(start):
            continue
        at = (least[start] & _PLACE).astype(np.int64)
        new = np.ones(len(start), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(start)) - 1
        # anchors are least hashes, so they are mixed again before they choose buckets
        parts.append((start[begin] + lo, start[end] + lo, at[begin] + lo, mix64(gram[at[begin]])))
    if not parts:
        none = np.empty(0, dtype=np.int64)
        return Runs(none, none, none, none.astype(np.uint64), none)
    first, last, anchor, gram = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Runs(first, last, anchor, gram, np.searchsorted(offsets, first, side="right") - 1)


class Block:
    """A block's documents in order, and their runs."""

    def __init__(self, table: pa.Table, shape: Shape):
        ids = table.column("doc_id").to_pylist()
        texts = table.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids, self.texts, self.shape = [ids[i] for i in order], [texts[i] for i in order], shape
        #: Of each row: the text's number and its part (-1: all of it), tokens before its first, tokens that are its neighbour's, and own ones (-1: all).
        self.row = {c: table.column(c).to_numpy()[order] if order else np.empty(0, dtype=np.int64) for c in ("number", "part", "base", "skip", "own")}
        self.key = np.array([NO_ID if i is None else i for i in self.ids], dtype=np.int64)
        stored, cuts, offsets, runs, base, size = [], [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)], [], 0, 0
        for lo, hi in text_chunks(self.texts):
            values, tokens, edges, offs = shape.tokens(self.texts[lo:hi])
            found = find_runs(values, offs, shape)
            runs.append((found.first + base, found.last + base, found.anchor + base, found.gram, found.doc + lo))
            stored.append(tokens)
            offsets.append(offs[1:] + base)
            if edges is not None:
                cuts.append(edges[1:] + size)
            base += len(values)
            size += len(tokens)
        self.stored = np.concatenate(stored) if stored else np.empty(0, dtype=np.uint8)
        self.cuts = np.concatenate(cuts) if len(cuts) > 1 else None
        self.offsets = np.concatenate(offsets)
        none = np.empty(0, dtype=np.int64)
        self.runs = Runs(*(np.concatenate(x) for x in zip(*runs, strict=True))) if runs else Runs(none, none, none, none.astype(np.uint64), none)
        self.whole = np.zeros(len(self.runs.first), dtype=bool)
        self.grams, self.of, self.times = np.unique(self.runs.gram, return_inverse=True, return_counts=True)

    def edges(self, buckets: int) -> np.ndarray:
        """Where each bucket's share of the sorted anchors begins."""
        edges = np.searchsorted(self.grams, bucket_starts(buckets))
        edges[-1] = len(self.grams)
        return edges

    def positions(self) -> np.ndarray:
        """Where each run's anchor stands in its document."""
        return self.runs.anchor - self.offsets[self.runs.doc] + self.row["base"][self.runs.doc]

    def bytes_of(self, tokens: np.ndarray) -> np.ndarray:
        return tokens if self.cuts is None else self.cuts[tokens]

    def shared_here(self) -> np.ndarray:
        """Of each anchor, whether the block alone repeats it."""
        if not len(self.grams):
            return np.empty(0, dtype=bool)
        if self.shape.within:
            return self.times > 1
        order = np.argsort(self.of, kind="stable")
        begin = np.cumsum(self.times) - self.times
        key = self.key[self.runs.doc[order]]
        return np.minimum.reduceat(key, begin) != np.maximum.reduceat(key, begin)

    def route(self, shared: np.ndarray, hot: np.ndarray) -> None:
        """Keep the runs with a shared anchor, and make those with a hot one runs of one window each."""
        keep = np.flatnonzero(shared[self.of] & ~hot[self.of])
        cut = np.flatnonzero(shared[self.of] & hot[self.of])
        old, w = self.runs, self.shape.window
        count = old.last[cut] - old.first[cut] + 1
        start = np.repeat(old.first[cut], count) + spread(count)
        raw = self.stored.tobytes()
        lows, highs = self.bytes_of(old.first[cut]).tolist(), self.bytes_of(old.last[cut] + w).tolist()
        own = window_hashes([raw[a:b] for a, b in zip(lows, highs, strict=True)], count, self.shape)
        joined = lambda a, b: np.concatenate([a[keep], b])
        self.runs = Runs(joined(old.first, start), joined(old.last, start), joined(old.anchor, start), joined(old.gram, mix64(own)), joined(old.doc, np.repeat(old.doc[cut], count)))
        self.whole = np.arange(len(self.runs.first)) >= len(keep)

    def contexts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """The context of each run, and each context's least run, number of places and bytes."""
        runs, raw = self.runs, self.stored.tobytes()
        lows, highs = self.bytes_of(runs.first).tolist(), self.bytes_of(runs.last + self.shape.window).tolist()
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(lows, highs, strict=True)], dtype=np.int64)
        place = np.lexsort((self.positions(), self.key[runs.doc]))[::-1]
        lead = np.zeros(len(number), dtype=np.int64)
        lead[which[place]] = place  # of equal contexts the last one written is the least
        return which, lead, np.bincount(which, minlength=len(number)), list(number)


def bucket_starts(buckets: int) -> np.ndarray:
    """The least anchor hash of each bucket, and beyond the last."""
    return np.array([(b << 64) // buckets if b < buckets else (1 << 64) - 1 for b in range(buckets + 1)], dtype=np.uint64)


def pack(arrays: list[np.ndarray], tail: bytes = b"") -> bytes:
    """Arrays of one length and a tail of bytes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(arrays[0]).to_bytes(8, "little"), *(a.tobytes() for a in arrays), tail]))


def unpack(data: bytes, kinds: list[str]) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for k in kinds:
        out.append(np.frombuffer(raw, dtype=k, count=n, offset=at))
        at += n * np.dtype(k).itemsize
    return out, raw[at:]


#: Anchor, place of the first window before it, number of windows, least document and anchor position, and marks.
_ASK = ["<u8", "<u4", "<u4", "<i8", "<i8", "u1"]
#: Marks of a context: it has several places in the block; its anchor is the whole window.
_SEVERAL, _WHOLE = 1, 2
_PART = "block int, bucket int, data binary"


def _rows(block: list[int], bucket: list[int], data: list[bytes]) -> pa.Table:
    return pa.table({"block": pa.array(block, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "data": pa.array(data, pa.binary())})


def send_anchors(block: Block, number: int, buckets: int, width: int) -> pa.Table:
    """For each bucket: how many anchors have more than ``FEW`` runs, the hashes, and the place and runs of those that have."""
    edges = block.edges(buckets)
    packed = block.grams.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width]
    many = block.times > FEW
    full, data = np.flatnonzero(edges[1:] > edges[:-1]).tolist(), []
    for b in full:
        lo, hi = edges[b], edges[b + 1]
        at = np.flatnonzero(many[lo:hi])
        times = np.minimum(block.times[lo:hi][at], (1 << 32) - 1)
        data.append(np.uint32(len(at)).tobytes() + packed[lo:hi].tobytes() + at.astype("<u4").tobytes() + times.astype("<u4").tobytes())
    return _rows([number] * len(full), full, data)


def answer_anchors(table: pa.Table, width: int) -> pa.Table:
    """For each block's hashes, a bit where another block has the hash and then a bit where it is hot."""
    hashes, sizes, more = [], [], []
    for data in table.column("data").to_pylist():
        many = int.from_bytes(data[:4], "little")
        n = (len(data) - 4 - 8 * many) // width
        own = np.zeros((n, 8), dtype=np.uint8)
        own[:, :width] = np.frombuffer(data, dtype=np.uint8, count=n * width, offset=4).reshape(-1, width)
        at, times = np.frombuffer(data, dtype="<u4", offset=4 + n * width).reshape(2, -1)
        weight = np.ones(n, dtype=np.int64)
        weight[at] += times
        hashes.append(own.view(">u8").ravel().astype(np.uint64))
        sizes.append(n)
        more.append(weight)
    order = np.argsort(joined := np.concatenate(hashes), kind="stable")
    ranked = joined[order]
    begin = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    blocks = np.diff(np.append(begin, len(ranked)))
    weights = np.add.reduceat(np.concatenate(more)[order], begin)
    bits = []
    for truth in (blocks > 1, weights > HOT):
        own = np.zeros(len(joined), dtype=bool)
        own[order] = np.repeat(truth, blocks)
        bits.append(np.split(own, np.cumsum(sizes)[:-1]))
    told = [np.packbits(a).tobytes() + np.packbits(b).tobytes() for a, b in zip(*bits, strict=True)]
    return table.select(["block", "bucket"]).append_column("data", pa.array(told, pa.binary()))


def routed(block: Block, answers: pa.Table, buckets: int) -> Block:
    """The block with those runs only whose anchor another place has."""
    shared, edges = block.shared_here(), block.edges(buckets)
    hot = np.zeros(len(shared), dtype=bool)
    for b, data in zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True):
        lo, hi = edges[b], edges[b + 1]
        both = np.unpackbits(np.frombuffer(data, dtype=np.uint8).reshape(2, -1), axis=1, count=hi - lo).astype(bool)
        shared[lo:hi] |= both[0]
        hot[lo:hi] = both[1]
    block.route(shared, hot)
    return block


def send_contexts(block: Block, number: int, buckets: int) -> pa.Table:
    _, lead, times, contexts = block.contexts()
    runs = block.runs
    gram = runs.gram[lead]
    bucket = np.searchsorted(bucket_starts(buckets)[1:-1], gram, side="right")
    doc = runs.doc[lead]
    place = block.positions()[lead] if block.shape.within else np.zeros(len(lead))
    marks = _SEVERAL * (times > 1) + _WHOLE * block.whole[lead]
    ask = [gram, runs.anchor[lead] - runs.first[lead], runs.last[lead] - runs.first[lead] + 1, block.key[doc], place, marks]
    out: tuple[list, list, list] = ([], [], [])
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        own = order[cut[b] : cut[b + 1]]
        out[0].append(number)
        out[1].append(b)
        out[2].append(pack([a[own].astype(k) for a, k in zip(ask, _ASK, strict=True)], b"".join([contexts[i] for i in own.tolist()])))
    return _rows(*out)


def window_hashes(texts: list[bytes], counts: np.ndarray, shape: Shape) -> np.ndarray:
    """The hash of each window of contexts that have so many windows each, ``SLICE`` bytes at a time."""
    out, lo, held = [np.empty(0, dtype=np.uint64)], 0, 0
    for hi, text in enumerate(texts, 1):
        held += len(text)
        if held >= SLICE or hi == len(texts):
            own = counts[lo:hi]
            values = shape.values(np.frombuffer(b"".join(texts[lo:hi]), dtype=np.uint8))
            begin = np.cumsum(own + shape.window - 1) - (own + shape.window - 1)
            out.append(gram_hashes(values, shape.window)[np.repeat(begin, own) + spread(own)])
            lo, held = hi, 0
    return np.concatenate(out)


def answer_contexts(table: pa.Table, shape: Shape) -> pa.Table:
    """The least place of each window that repeats, for the contexts of which a block has a later one."""
    blocks, buckets = table.column("block").to_pylist(), table.column("bucket").to_pylist()
    asked, contexts = [], []
    for data in table.column("data").to_pylist():
        arrays, tail = unpack(data, _ASK)
        asked.append(arrays)
        ends = np.cumsum(arrays[2].astype(np.int64) + shape.window - 1)
        ends = shape.cuts(np.frombuffer(tail, dtype=np.uint8))[ends].tolist()
        contexts += [tail[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    gram, lead, windows, doc, pos, marks = (np.concatenate([a[i] for a in asked]) for i in range(6))
    lead, windows = lead.astype(np.int64), windows.astype(np.int64)
    order = np.lexsort((pos, doc))
    step = np.ones(len(doc), dtype=bool)
    step[1:] = (doc[order][1:] != doc[order][:-1]) | (pos[order][1:] != pos[order][:-1])
    rank = np.zeros(len(doc), dtype=np.int64)
    rank[order] = np.cumsum(step) - 1
    # the place after all others stands for none
    rank_doc, rank_pos = np.append(doc[order][step], NO_ID), np.append(pos[order][step], NO_ID)
    none = len(rank_doc) - 1
    several, whole = marks & _SEVERAL > 0, marks & _WHOLE > 0
    best = repeated_windows(contexts, windows, rank, several, gram, lead, whole, shape, none)
    own = np.repeat(rank, windows)
    tell = (best < own) | (best == own) & np.repeat(several, windows)
    told = np.add.reduceat(tell, np.cumsum(windows) - windows, dtype=np.int64) > 0
    out: tuple[list, list, list] = ([], [], [])
    rows = np.cumsum([0, *(len(a[0]) for a in asked)])
    cells = np.append(0, np.cumsum(windows))[rows]
    for i in np.flatnonzero(np.add.reduceat(told, rows[:-1], dtype=np.int64)).tolist():
        mine = told[rows[i] : rows[i + 1]]
        keep = best[cells[i] : cells[i + 1]][np.repeat(mine, windows[rows[i] : rows[i + 1]])]
        out[0].append(blocks[i])
        out[1].append(buckets[i])
        out[2].append(pack([np.flatnonzero(mine).astype("<u4")], np.concatenate([rank_doc[keep], rank_pos[keep]]).astype("<i8").tobytes()))
    return _rows(*out)


def repeated_windows(contexts: list[bytes], windows: np.ndarray, rank: np.ndarray, several: np.ndarray, gram: np.ndarray, lead: np.ndarray, whole: np.ndarray, shape: Shape, none: int) -> np.ndarray:
    """The least rank of each window that repeats, and ``none`` for the others.

    Windows whose hash occurs once, in a context that has one place, can't repeat. What is
    left of the contexts goes to ``settle``.
    """
    w, out = shape.window, np.full(int(windows.sum()), none, dtype=np.int64)
    _, of, n = np.unique(window_hashes(contexts, windows, shape), return_inverse=True, return_counts=True)
    again = np.flatnonzero((n[of] > 1) | np.repeat(several, windows))
    if not len(again):
        return out
    owner = np.repeat(np.arange(len(contexts)), windows)[again]
    inside = spread(windows)[again]
    new = np.ones(len(again), dtype=bool)
    new[1:] = (again[1:] != again[:-1] + 1) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(again)))
    owner, inside = owner[begin], inside[begin]
    data = []
    for i, a, b in zip(owner.tolist(), inside.tolist(), (inside + count + w - 1).tolist(), strict=True):
        text = contexts[i]
        if b - a < windows[i] + w - 1:
            cuts = shape.cuts(np.frombuffer(text, dtype=np.uint8))
            text = text[cuts[a] : cuts[b]]
        data.append(text)
    out[again] = shape.settle(Parts(data, count, rank[owner], several[owner], gram[owner], lead[owner] - inside, whole[owner]), none)
    return out


def least_ranks(rank: np.ndarray, several: np.ndarray, begin: np.ndarray, none: int) -> np.ndarray:
    """The least rank of each run of equal windows if it has several places, and else ``none``; runs start at ``begin``."""
    size = np.diff(np.append(begin, len(rank)))
    known = (size > 1) | np.logical_or.reduceat(several, begin)
    return np.repeat(np.where(known, np.minimum.reduceat(rank, begin), none), size)


def covered(block: Block, answers: pa.Table, buckets: int) -> np.ndarray:
    """Of each token, whether a window that starts earlier elsewhere covers it."""
    which, lead, _, _ = block.contexts()
    runs, w = block.runs, block.shape.window
    cover = np.zeros(int(block.offsets[-1]) + 1, dtype=np.int32)
    if not len(which):
        return cover[:-1] > 0
    windows = runs.last[lead] - runs.first[lead] + 1
    place = np.cumsum(windows) - windows
    position = block.positions() if block.shape.within else np.zeros(len(runs.anchor), dtype=np.int64)
    best_doc, best_pos = (np.full(int(windows.sum()), NO_ID, dtype=np.int64) for _ in range(2))
    bucket = np.searchsorted(bucket_starts(buckets)[1:-1], runs.gram[lead], side="right")
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b, data in zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True):
        (rows,), tail = unpack(data, ["<u4"])
        own = order[cut[b] : cut[b + 1]][rows]
        at = np.repeat(place[own], windows[own]) + spread(windows[own])
        both = np.frombuffer(tail, dtype="<i8")
        best_doc[at], best_pos[at] = both[: len(at)], both[len(at) :]
    sizes = windows[which]
    at = np.repeat(place[which], sizes) + spread(sizes)
    doc, pos = np.repeat(block.key[runs.doc], sizes), np.repeat(position, sizes)
    repeat = best_doc[at] < doc
    if block.shape.within:
        repeat |= (best_doc[at] == doc) & (best_pos[at] < pos)
    start = (np.repeat(runs.first, sizes) + spread(sizes))[repeat]
    # a window is in one run, so no start stands twice
    cover[start] = 1
    cover[start + w] -= 1
    return np.cumsum(cover[:-1], dtype=np.int32) > 0


#: A text or a part of one: what was counted, whether its ends are removed, and what stays or, of a whole text, its digest.
_PIECE = "doc_id long, number long, part long, n long, removed long, spans long, opens boolean, closes boolean, kept binary, sha string"
_PIECES = pa.schema([("doc_id", pa.int64()), ("number", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("removed", pa.int64()), ("spans", pa.int64()), ("opens", pa.bool_()), ("closes", pa.bool_()), ("kept", pa.binary()), ("sha", pa.string())])
_TEXT = "doc_id long, text string, number long, part long, base long, skip long, own long"


def pieces(block: Block, cover: np.ndarray, digest: bool) -> pa.Table:
    """What is left of the block's texts and parts, each without what is its neighbours'."""
    shape, out = block.shape, {n: [] for n in _PIECES.names}
    raw, numbers, parts, skips, owns = block.stored.tobytes(), *(block.row[c].tolist() for c in ("number", "part", "skip", "own"))
    for i, (a, b) in enumerate(zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)):
        a += skips[i]
        b = b if owns[i] < 0 else a + owns[i]
        gone = cover[a:b]
        removed = int(np.count_nonzero(gone))
        lo, hi = (a, b) if block.cuts is None else (int(block.cuts[a]), int(block.cuts[b]))
        kept = shape.keep(raw[lo:hi], gone if removed else gone[:0])
        whole = parts[i] < 0
        row = (block.ids[i], numbers[i], parts[i], b - a, removed, int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if removed else 0)
        row += (bool(removed and gone[0]), bool(removed and gone[-1]), None if whole and digest else kept, sha_hex(kept) if whole and digest else None)
        for n, x in zip(_PIECES.names, row, strict=True):
            out[n].append(x)
    return pa.table(out, schema=_PIECES)


def joined_pieces(table: pa.Table, glue: bytes, digest: bool) -> pa.Table:
    """One text of its parts. A run of removed tokens that goes on in the next part is one."""
    rows = table.sort_by("part")
    spans, closed = 0, False
    for own, opens, closes in zip(*(rows.column(c).to_pylist() for c in ("spans", "opens", "closes")), strict=True):
        spans += own - (opens and closed)
        closed = closes
    total, parts, empty = hashlib.sha256(), [], True
    for cell in rows.column("kept"):
        data = cell.as_buffer()
        if data.size:
            for x in (data,) if empty else (glue, data):
                total.update(x) if digest else parts.append(bytes(x))
            empty = False
    first = rows.slice(0, 1)
    row = {"doc_id": first.column("doc_id").to_pylist(), "number": first.column("number").to_pylist(), "part": [-1], "n": [sum(rows.column("n").to_pylist())], "removed": [sum(rows.column("removed").to_pylist())]}
    row |= {"spans": [spans], "opens": [False], "closes": [False], "kept": [None if digest else b"".join(parts)], "sha": [total.hexdigest() if digest else None]}
    return pa.table(row, schema=_PIECES)


def cut_texts(rows: DataFrame, shape: Shape) -> DataFrame:
    """The parts of long texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i in range(batch.num_rows):
                raw = np.frombuffer(batch.column(1)[i].as_buffer(), dtype=np.uint8)
                for k, (base, skip, own, text) in enumerate(shape.parts(raw)):
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i]], pa.int64()), pa.array([text], pa.binary()).cast(pa.string()), *(pa.array([x], pa.int64()) for x in (number, k, base, skip, own))], names=[c.split()[0] for c in _TEXT.split(", ")])
                number += 1

    return rows.mapInArrow(run, _TEXT)


def remove_repeats(docs: DataFrame, shape: Shape, digest: bool) -> DataFrame:
    """``doc_id, n, removed, spans`` of every document, with what stays (``kept``) or its digest (``sha``)."""
    text = doc_text(docs)
    length = F.octet_length("text").cast("long")
    size, longest = text.agg(F.coalesce(F.sum(length), F.lit(0)), F.coalesce(F.max(length), F.lit(0))).first()
    blocks = int(size // BLOCK) + 1
    buckets = blocks * BUCKETS
    # enough bytes that among all anchors one in 2**12 at most has a chance twin
    width = min(8, (max(1, size // 10).bit_length() + 12 + 7) // 8)
    none = [F.lit(x).cast("long").alias(c) for c, x in (("number", 0), ("part", -1), ("base", 0), ("skip", 0), ("own", -1))]
    whole = text.select("doc_id", "text", *none)
    if longest > PART:
        whole = whole.where(length <= PART).unionByName(cut_texts(text.where(length > PART), shape))
    of = F.xxhash64(F.coalesce("doc_id", F.xxhash64("text")), "part")
    text = whole.select(F.pmod(of, F.lit(blocks)).cast("int").alias("block"), "*")

    def ask_anchors(key: tuple, rows: pa.Table) -> pa.Table:
        return send_anchors(Block(rows, shape), key[0].as_py(), buckets, width)

    def ask_contexts(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _rows([], [], [])
        return send_contexts(routed(Block(rows, shape), answers, buckets), key[0].as_py(), buckets)

    def apply(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _PIECES.empty_table()
        bucket = answers.column("bucket").to_numpy()  # bits for anchors came with buckets below zero
        anchors = answers.filter(pa.array(bucket < 0))
        anchors = anchors.set_column(anchors.schema.get_field_index("bucket"), "bucket", pa.array(-1 - bucket[bucket < 0], pa.int32()))
        block = routed(Block(rows, shape), anchors, buckets)
        return pieces(block, covered(block, answers.filter(pa.array(bucket >= 0)), buckets), digest)

    parts = min(blocks, PARTITIONS)
    by = lambda df, key: df.repartition(parts, key).groupBy(key)
    by_block = by(text, "block")
    bits = by(by_block.applyInArrow(ask_anchors, _PART), "bucket").applyInArrow(lambda rows: answer_anchors(rows, width), _PART)
    asked = by_block.cogroup(by(bits, "block")).applyInArrow(ask_contexts, _PART)
    answers = by(asked, "bucket").applyInArrow(lambda rows: answer_contexts(rows, shape), _PART)
    both = answers.unionByName(bits.select("block", (-1 - F.col("bucket")).cast("int").alias("bucket"), "data"))
    out = by_block.cogroup(by(both, "block")).applyInArrow(apply, _PIECE)
    if longest > PART:
        checkpoint_dir(docs.sparkSession)
        out = out.checkpoint()
        cut = out.where("part >= 0").groupBy("number").applyInArrow(lambda rows: joined_pieces(rows, shape.glue, digest), _PIECE)
        out = out.where("part < 0").unionByName(cut)
    return out.select("doc_id", "n", "removed", "spans", "sha" if digest else "kept")
