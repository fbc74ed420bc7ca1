"""Token ids of the public word-level byte-pair vocabulary, for many texts at once.

Ids equal those of the ``tokenizers`` library. Texts are cut at blanks, which no
token spans; each distinct piece is encoded once for a batch and a text's ids
are the concatenation of its pieces'. Pieces of Latin letters, digits and marks
are folded and split here (nearly all are a word and the marks behind it, which needs no search), and their runs are merged together in arrays: in
each step every run merges its lowest-ranked pair, the leftmost of equals, which
is what the library does run by run. Any other piece (combining marks, other
scripts, special tokens) goes to the library itself.
"""

from __future__ import annotations

import json
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

VOCABULARY = "word_bpe_49k.json"
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Latin text: composed, with no case that depends on its place.
PLAIN = regex.compile(r"[\t\x20-\x7e¡-ɏ]*")
#: Marks that are one run behind a word: no apostrophe, which may begin a run of its own, and no "<" of a special token.
MARKS = '!"#$%&()*+,-./:;=>?@[\\]^_`{|}~'
NONE = np.int64(1) << 40


def byte_alphabet() -> list[str]:
    """The public byte-level alphabet: a printable character for each byte."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = (chr(256 + n) for n in range(256))
    return [chr(b) if b in set(printable) else next(rest) for b in range(256)]


class PairTable:
    """Rank and product of a pair of symbols: two hash tables without collisions."""

    def __init__(self, pairs: np.ndarray):
        self.tables = []
        left = np.arange(len(pairs))
        multiplier, bits = 0x9E3779B97F4A7C15, 18
        while len(left):
            keys, ranks = np.zeros(1 << bits, dtype=np.int64) - 1, np.zeros(1 << bits, dtype=np.int64)
            slot = self._slot(pairs[left], multiplier, bits)
            _, first = np.unique(slot, return_index=True)
            keys[slot[first]], ranks[slot[first]] = pairs[left][first], left[first]
            self.tables.append((multiplier, bits, keys, ranks))
            left = np.delete(left, first)
            multiplier = multiplier * 0xD1342543DE82EF95 % (1 << 64) | 1

    @staticmethod
    def _slot(pairs: np.ndarray, multiplier: int, bits: int) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(multiplier) >> np.uint64(64 - bits)).astype(np.int64)

    def rank(self, pairs: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` for those that don't merge."""
        out = np.full(len(pairs), NONE)
        for multiplier, bits, keys, ranks in self.tables:
            slot = self._slot(pairs, multiplier, bits)
            hit = keys[slot] == pairs
            out[hit] = ranks[slot[hit]]
        return out


class WordBPE:
    """The vocabulary at ``path``, by default the public one."""

    #: Distinct pieces kept from batch to batch.
    KEEP = 800_000

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        self.path = path or public_tokenizers.path(VOCABULARY)
        self.library = Tokenizer.from_file(self.path)
        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.end = model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        alphabet = byte_alphabet()
        self.first = np.array([vocab[c] for c in alphabet], dtype=np.int64)
        self.last = np.array([vocab[c + self.end] for c in alphabet], dtype=np.int64)
        self.size = max(vocab.values()) + 1
        self.width = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.table = PairTable(np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64))
        self.product = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.known: dict[str, bytes] = {"": b""}

    def merge(self, runs: list[bytes]) -> list[bytes]:
        """Ids of each run of bytes, packed in ``width``."""
        if not runs:
            return []
        sizes = np.array([len(r) for r in runs], dtype=np.int64)
        symbols = self.first[np.frombuffer(b"".join(runs), dtype=np.uint8)]
        begin = np.cumsum(sizes) - sizes
        tail = np.frombuffer(b"".join([r[-1:] for r in runs]), dtype=np.uint8)
        symbols[begin + sizes - 1] = self.last[tail]
        out: list[bytes] = [b""] * len(runs)
        which = np.arange(len(runs))
        rank = np.full(len(symbols), NONE)
        inner = np.ones(len(symbols), dtype=bool)
        inner[begin + sizes - 1] = False
        at = np.flatnonzero(inner)
        rank[at] = self.table.rank(symbols[at] * self.size + symbols[at + 1])
        while len(which):
            place = np.arange(len(symbols))
            best = np.minimum.reduceat(rank << 20 | place - np.repeat(begin, sizes), begin)
            done = best >= NONE << 20
            if done.any():
                packed = symbols.astype(self.width).tobytes()
                w = np.dtype(self.width).itemsize
                for k, a, n in zip(which[done].tolist(), (begin[done] * w).tolist(), (sizes[done] * w).tolist(), strict=True):
                    out[k] = packed[a : a + n]
                live = np.repeat(~done, sizes)
                symbols, rank = symbols[live], rank[live]
                which, sizes, best = which[~done], sizes[~done], best[~done]
                if not len(which):
                    break
                begin = np.cumsum(sizes) - sizes
            at = begin + (best & (1 << 20) - 1)
            symbols[at] = self.product[best >> 20]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols, rank = symbols[keep], rank[keep]
            at -= np.arange(len(at))
            sizes = sizes - 1
            begin = np.cumsum(sizes) - sizes
            final = begin + sizes - 1
            has = at < final
            rank[at] = NONE
            rank[at[has]] = self.table.rank(symbols[at[has]] * self.size + symbols[at[has] + 1])
            has = at > begin
            rank[at[has] - 1] = self.table.rank(symbols[at[has] - 1] * self.size + symbols[at[has]])
        return out

    def learn(self, pieces: list[str]) -> None:
        """Encode distinct pieces that aren't known."""
        words, split, other, runs = [], [], [], {}
        for p in pieces:
            lower = p.lower()
            word = lower.rstrip(MARKS)
            if word.isalpha() and len(p) < 1 << 17 and (p.isascii() or PLAIN.fullmatch(p)):
                marks = lower[len(word) :]
                words.append((p, word, marks))
                runs[word] = runs[marks] = b""
            elif PLAIN.fullmatch(p) and "<|" not in p:
                parts = SPLIT.findall(lower)
                split.append((p, parts))
                for q in parts:
                    runs[q] = b""
            else:
                other.append(p)
        short = [r for r in runs if 0 < len(r) < 1 << 17]
        for r, ids in zip(short, self.merge([r.encode() for r in short]), strict=True):
            runs[r] = ids
        known = self.known
        for p, word, marks in words:
            known[p] = runs[word] + runs[marks]
        for p, parts in split:
            if all(len(q) < 1 << 17 for q in parts):
                known[p] = runs[parts[0]] if len(parts) == 1 else b"".join([runs[q] for q in parts])
            else:
                other.append(p)
        for p in other:
            known[p] = np.array(self.library.encode(p, add_special_tokens=False).ids, dtype=self.width).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian in ``width``."""
        if len(self.known) > self.KEEP:  # those met first are the frequent ones; the empty piece is the first
            self.known = dict(islice(self.known.items(), self.KEEP // 2))
        split = pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts], type=pa.string()), " ")
        found = split.values.dictionary_encode()
        pieces = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, pieces))
        self.learn([p for p, own in zip(pieces, ids, strict=True) if own is None])
        ids = [self.known[p] if own is None else own for p, own in zip(pieces, ids, strict=True)]
        # each distinct piece's ids once, one after another, and from there to the places of its occurrences
        w = np.dtype(self.width).itemsize
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // w
        which = found.indices.to_numpy()
        lengths = sizes[which]
        ends = np.append(0, np.cumsum(lengths))
        begin = (np.cumsum(sizes) - sizes)[which] - ends[:-1]
        place = np.repeat(begin, lengths)
        place += np.arange(len(place))
        packed = np.frombuffer(b"".join(ids), dtype=self.width)[place].tobytes()
        cuts = (ends[split.offsets.to_numpy()] * w).tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
