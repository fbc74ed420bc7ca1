"""Language identification by compression with per-language dictionaries.

Each language's training texts, in lower case and without digits and marks,
are a raw-content zstandard dictionary. A text, folded likewise, is cut into
pieces, each piece is compressed once with each dictionary, and the language
of the smallest total wins. ``score`` is the
share of bytes by which the runner-up is longer; a text whose margin is under
``MARGIN`` is rejected (column ``rejected``), and so is one without letters,
whose language is ``und``.

Training reads ``text`` and ``lang`` of labelled rows that are not held out,
and is bounded: about ``DOCS`` documents of a language, drawn by a hash of the
document's id, and ``DICT_BYTES`` bytes of them. Prediction uses nothing but
the text, and all of it.

Defined results: null and empty texts and texts without letters are ``und`` with
score 0; ties go to the language whose name sorts first; with no labelled row
at all every text is ``und``; repeated rows are predicted alike; an empty table gives no rows; a very long text is
compressed whole, piece by piece; other columns are dropped by ``identify`` and kept by ``keep_identified``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, doc_text

#: Documents drawn and bytes kept for each language's dictionary; bytes of a piece; compression level.
DOCS, DICT_BYTES, PIECE, LEVEL = 400, 64 << 10, 1 << 11, 3
#: Matches of three bytes and the optimal parser: words of a language share short pieces, which the faster parsers don't look for.
MIN_MATCH = 3
#: Relative margins under this are rejected.
MARGIN = 0.002
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


#: ASCII bytes other than letters are blanks.
FOLD = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def folded(text: str) -> bytes:
    """Lower case, ASCII letters and all other characters alone, words one blank apart."""
    return b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(FOLD).split()) + b" "


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, docs_each: int = DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """A dictionary's content for each language.

    Two small jobs: labelled documents are counted by language, and then drawn
    at such a rate that about ``docs_each`` of each come to the driver.
    """
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("dictionary")), F.lit(1 << 30)) / (1 << 30)
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, docs_each / n)]), F.col("lang"))
    # no document gives more than a dictionary, however long it is: the driver gets at most four bytes a character of that
    rows = labelled.where(draw < rate).select("lang", draw.alias("draw"), F.left("text", F.lit(2 * dict_bytes)).alias("text")).collect()
    texts: dict[str, list[str]] = {k: [] for k in sorted(counts)}
    for row in sorted(rows, key=lambda r: (r["draw"], r["text"])):
        texts[row["lang"]].append(row["text"])
    # a training document gives twice its share of the dictionary at most, so that a long one doesn't fill it
    share = {k: 2 * max(256, dict_bytes // max(1, len(v))) for k, v in texts.items()}
    return {k: b"".join(folded(t)[: share[k]] for t in v)[-dict_bytes:] for k, v in texts.items() if v}


class Classifier:
    """Compressors with one language's dictionary each."""

    def __init__(self, contents: dict[str, bytes]):
        self.langs = sorted(contents)
        self.compressors = []
        for k in self.langs:
            params = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, source_size=PIECE, dict_size=len(contents[k]), min_match=MIN_MATCH, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            known = zstandard.ZstdCompressionDict(contents[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=params)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=known, compression_params=params))

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected."""
        if not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        raw = folded(text)
        pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in self.compressors]
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        best = sizes[order[0]]
        score = (sizes[order[1]] - best) / sizes[order[1]] if len(sizes) > 1 else 1.0
        return self.langs[order[0]], score, score < MARGIN


def predict(docs: DataFrame, contents: dict[str, bytes]) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every document; ``contents`` is bounded by ``DICT_BYTES`` a language."""
    shared = docs.sparkSession.sparkContext.broadcast(contents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value)
        for batch in batches:
            found = [model.predict(t) for t in batch.column(2).to_pylist()]
            yield batch_of(
                doc_id=(pa.int64(), batch.column(0)),
                held_out=(pa.bool_(), batch.column(1)),
                lang_pred=(pa.string(), [f[0] for f in found]),
                score=(pa.float64(), [f[1] for f in found]),
                rejected=(pa.bool_(), [f[2] for f in found]),
            )

    rows = doc_text(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Train on the labelled rows of ``docs`` and predict all of it."""
    return predict(docs, train(docs))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    models: list[Classifier] = []

    def keep(texts):  # noqa: ANN001, ANN202
        if not models:
            models.append(Classifier(shared.value))
        return texts.map(lambda t: not models[0].predict(t)[2])

    return docs.where(F.pandas_udf(keep, "boolean")(F.coalesce(F.col("text"), F.lit(""))))
