"""Packing by concatenate and cut.

All documents' ids, each document's followed by ``END``, are one stream that is cut
every ``WINDOW`` ids. The stream is never brought together: the first pass encodes
the documents and checkpoints the ids, which fixes rows to partitions and their
order, and writes beside each document its partition and the tokens before it there;
the second adds up each partition's tokens, and prefix sums of
those totals (one number a partition, the only thing that the driver sees) give
each partition its offset in the stream. With those three every row is cut by itself, so
the pieces are the same however rows are dealt to tasks afterwards (``coalesce``,
``union``, a lost executor). Only the stream's last sequence may be short.

Defined results: a null or empty text is ``END`` alone; a null ``doc_id`` stays null;
repeated rows are packed again each time, equal or not (ties are packed in the order of
the partition); no documents give no pieces; a very long text is encoded alone, as one row,
and cut into as many pieces as it needs; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, checkpoint_dir, doc_text, text_chunks
from .wordbpe import WordBPE

WINDOW, END = 2048, 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_MODELS: dict[str | None, WordBPE] = {}


def model(path: str | None) -> WordBPE:
    """One vocabulary a worker."""
    if path not in _MODELS:
        _MODELS[path] = WordBPE(path)
    return _MODELS[path]


def encoded(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, tokens, ids, wide, part, before``: ids with ``END``, packed in two bytes each, or in four
    where the vocabulary needs them, the partition and its tokens before the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(vocabulary)
        end = np.array([END], dtype=bpe.width).tobytes()
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), []
            for lo, hi in text_chunks(texts, 1 << 21):
                ids += [x + end for x in bpe.encode(texts[lo:hi])]
            tokens = np.array([len(x) // len(end) for x in ids], dtype=np.int64)
            ends = before + np.cumsum(tokens)
            yield batch_of(
                doc_id=(pa.int64(), batch.column(0)),
                tokens=(pa.int64(), tokens),
                ids=(pa.binary(), ids),
                wide=(pa.bool_(), [len(end) > 2] * len(ids)),
                part=(pa.int32(), [part] * len(ids)),
                before=(pa.int64(), ends - tokens),
            )
            before = int(ends[-1]) if len(ends) else before

    return doc_text(docs).mapInArrow(run, "doc_id long, tokens long, ids binary, wide boolean, part int, before long")


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of documents in sequences of ``window`` ids."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    ids = encoded(docs, vocabulary).checkpoint()
    totals = dict(ids.groupBy("part").agg(F.sum("tokens")).collect())
    parts = sorted(totals)
    offsets = dict(zip(parts, accumulate([0, *(totals[p] for p in parts)]), strict=False))
    return cut(ids, offsets, window)


def cut(ids: DataFrame, offsets: dict[int, int], window: int = WINDOW) -> DataFrame:
    """The pieces of encoded rows, given each partition's offset; a partition without one is an error."""
    shared = ids.sparkSession.sparkContext.broadcast(offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, tokens, packed, wide, part, before in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                at = shared.value[part] + before
                stored = np.frombuffer(packed, dtype="<u4" if wide else "<u2").astype("<u4").tobytes()
                start = 0
                while start < tokens:
                    sequence, offset = divmod(at, window)
                    length = min(tokens - start, window - offset)
                    rows.append((doc, start, length, zlib.crc32(stored[4 * start : 4 * (start + length)]), tokens, sequence, offset))
                    start += length
                    at += length
            names = [p.split()[0] for p in PIECES.split(", ")]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield batch_of(**{n: (pa.int64(), list(c)) for n, c in zip(names, columns, strict=True)})

    return ids.mapInArrow(run, PIECES)
