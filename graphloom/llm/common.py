"""Helpers shared by the corpus operators."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the bytes that end a word, 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: What separates terms: ASCII other than letters and digits. Other bytes belong to letters.
SEPARATOR = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
#: Lower case of ASCII letters.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the corpus, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone; a null text is the empty text.

    Every other column is dropped here, so that columns of any name may come
    with the input.
    """
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def checkpoint_dir(spark: SparkSession) -> None:
    """Make sure that ``checkpoint()`` has a folder.

    The cluster's own ``spark.checkpoint.dir`` is used as it is; a temporary
    one is made only where none is set and the driver runs all tasks (tests, local
    runs). On a cluster a folder of the driver's own would lose data, so that is refused.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster checkpoints need a shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loom-ckpt-"))


def map_arrow(df: DataFrame, step: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(run, schema)


def batch_of(**columns: tuple[pa.DataType, object]) -> pa.RecordBatch:
    """A record batch from ``name=(type, values)``; numpy arrays pass without a copy."""
    arrays = [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, type=t) for t, v in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def sha_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def joined_text(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and the offsets of each."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    return np.frombuffer(b"".join(raw), dtype=np.uint8), offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix, on each value."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POW = np.empty(0, dtype=np.uint64)
_INV = np.empty(0, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            base = np.full(size, _ODD, dtype=np.uint64)
            base[0] = 1
            _POW = np.multiply.accumulate(base)
            base[1:] = np.uint64(pow(int(_ODD), -1, 1 << 64))
            _INV = np.multiply.accumulate(base)
    return _POW[:n], _INV[:n]


def word_spans(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words of joined texts.

    A word is a run of bytes outside ``space``; it also ends where its
    document ends.
    """
    word = ~space[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    begins[edges] = word[edges]
    ends[edges - 1] = word[edges - 1]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes have equal hashes anywhere."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    power, inverse = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[raw] * power[:-1], out=sums[1:])
        value = (sums[stops] - sums[starts]) * inverse[starts]
        return mix64(value ^ ((stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def text_chunks(texts: list[str], size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` characters, so that work arrays stay in cache."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
