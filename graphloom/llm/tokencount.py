"""Token counts by dynamic programming shared along a trie.

A text's pre-tokens are its words, each with the word mark of the vocabulary
in front. The distinct pre-tokens of a chunk of documents are inserted in a trie. A walk
computes each node's forward score once, from those of the nodes above it, whatever
number of pre-tokens goes through it, and where a pre-token ends its number of tokens
is stored. A document's count is the sum over its words.

The vocabulary is a public one. Its pieces come by rank and the model is a
unigram one over them, with Zipf's law for the score: ``-log(rank + 1)``, counted
over the pieces of text. A character that no piece covers is its UTF-8 bytes, one
token each, at a score of ``UNKNOWN`` below the lowest. Of equal scores the one with
fewer tokens counts.

Defined results: null, empty and blank texts have 0; a null ``doc_id`` stays;
repeated rows repeat, and have equal counts; no documents give no rows; very long texts are counted whole, a chunk of texts
at a time and a longer text alone; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, doc_text, text_chunks

VOCABULARY = "piece_bpe_32k.model"
MARK, UNKNOWN = "▁", 10.0
#: Characters of text whose distinct words are held together.
CHUNK = 1 << 23


def piece_scores(path: str) -> dict[str, float]:
    """Score of each piece of text; controls, bytes and unknowns are no pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {p: -math.log(rank + 1) for rank, p in enumerate(pieces)}


class Trie:
    """Pre-tokens by their characters; a node has its children and, if a pre-token ends there, its count."""

    def __init__(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.counts: dict[int, int] = {}

    def insert(self, token: str) -> int:
        """The node where the token ends."""
        node, children = 0, self.children
        for char in token:
            below = children[node].get(char)
            if below is None:
                below = children[node][char] = len(children)
                children.append({})
            node = below
        self.counts[node] = 0
        return node

    def count(self, scores: dict[str, float], ends: dict[str, float | None], unknown: float) -> None:
        """Forward scores of every node, and the counts of those where a pre-token ends."""
        get, counts, children = ends.get, self.counts, self.children
        best, fewest = [0.0], [0]  # of the prefixes on the path
        stack = [(node, char) for char, node in children[0].items()]
        while stack:
            node, token = stack.pop()
            i = len(token)
            del best[i:], fewest[i:]
            top, n = best[i - 1] + unknown, fewest[i - 1] + len(token[-1].encode("utf-8", "surrogatepass"))
            for j in range(i - 1, -1, -1):
                s = get(token[j:], 1.0)
                if s is None:
                    continue
                if s == 1.0:
                    break
                s += best[j]
                if s >= top:
                    n = min(n, fewest[j] + 1) if s == top else fewest[j] + 1
                    top = s
            best.append(top)
            fewest.append(n)
            if node in counts:
                counts[node] = n
            stack += [(below, token + char) for char, below in children[node].items()]


def count_tokens(words: Iterable[str], scores: dict[str, float]) -> dict[str, int]:
    """Tokens of each distinct pre-token."""
    # what pieces end in, so that the search stops where no longer piece can match
    ends: dict[str, float | None] = dict.fromkeys(p[i:] for p in scores for i in range(1, len(p)))
    ends.update(scores)
    trie = Trie()
    nodes = {word: trie.insert(MARK + word) for word in words}
    trie.count(scores, ends, min(scores.values(), default=0.0) - UNKNOWN)
    return {word: trie.counts[node] for word, node in nodes.items()}


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every document; ``vocabulary`` is a model file's path, by default the public one."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = piece_scores(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            words, tokens = [], []
            for lo, hi in text_chunks(texts, CHUNK):
                split = [t.split() for t in texts[lo:hi]]
                found = count_tokens(set().union(*split), scores)
                words += map(len, split)
                tokens += [sum(map(found.__getitem__, s)) for s in split]
            yield batch_of(doc_id=(pa.int64(), batch.column(0)), n_words=(pa.int64(), words), n_tokens=(pa.int64(), tokens))

    return doc_text(docs).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
