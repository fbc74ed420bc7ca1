"""Every operator and stage on null, empty and repeated rows, and beside columns whose names it uses itself."""

import hashlib
import random
import re
import time

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, dedup_bytes, dedup_words, langid, matroska, packing, pii, repeats, secrets, simhash, tokencount

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SCHEMA_NAMES = ["doc_id", "text", "lang", "source", "n_chars"]
CLASHES = ["spans", "fp", "row", "id", "component_id", "near", "row_key", "bucket", "item_id", "held_out", "start", "n_bytes", "u", "node", "root", "least", "sequence_id", "a.b"]
ONE_ROW_EACH = {
    "pii": pii.pii_digest,
    "sanitise": pii.sanitise,
    "language": langid.identify,
    "bytes": dedup_bytes.repeats_digest,
    "words": dedup_words.repeats_digest,
    "simhash": simhash.near_duplicates,
    "media": matroska.media_digest,
    "secrets": secrets.secret_digest,
    "counts": tokencount.token_counts,
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    long = " ".join(f"word{i % 977}" for i in range(30000))
    rows = [(1, "the quick brown fox", "en", "a", 19), (2, "le renard brun et rapide", "fr", "a", 24), (3, long, "en", None, None), (4, long + " end", None, "a", 1)]
    odd = [(None, None, None, None, None), (None, "no id", None, None, None), (None, "no id", None, None, None), (5, None, "en", "a", 0), (6, "", "zz", "a", 0), (7, "\x00 \x1f", None, "a", 3), (1, "the quick brown fox", "en", "a", 19)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit(None).cast("string"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "quick brown", 9), (None, None, 9), (2, "", 9)], "item_id long, text string, doc_id int").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_one_row_for_each_document(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = ONE_ROW_EACH[name](docs)
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)
    assert ids(got) == ids(docs)
    assert ONE_ROW_EACH[name](docs.limit(0)).count() == 0


def test_leaks_and_pieces(spark, folder):
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()] == [(1, 1), (1, 1)]
    pieces = packing.pack(docs)
    assert pieces.where("length < 1").count() == 0
    assert pieces.where("start = 0").count() == docs.count()


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = stage(spark, docs, folder)
    assert got.columns == docs.columns
    assert got.count() <= docs.count()
    assert stage(spark, docs.limit(0), folder).count() == 0


def brute(docs):
    """What each operator gives for odd rows, by the slow functions of the other tests; ids of None count as beyond all."""
    from test_repeats import slow_bytes, slow_words
    from test_simhash import slow_classes, slow_fingerprint
    from test_spans_operators import slow_pii, slow_secrets

    beyond = 1 << 62
    rows = [(beyond if r.doc_id is None else r.doc_id, r.text) for r in docs.collect()]
    named = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    components = slow_classes(fps)
    return {
        "bytes": slow_bytes(rows),
        "words": slow_words(rows),
        "simhash": sorted((i, f"{f:016x}", components[i, f]) for i, f in fps),
        "pii": sorted((i, sha(named(slow_pii(t or "")))) for i, t in rows),
        "secrets": sorted((i, sha(named(slow_secrets(t or "")))) for i, t in rows),
        "media": sorted((i, len((t or "").encode()), hashlib.sha256(matroska.payload_of(t or "")).hexdigest()) for i, t in rows),
        "counts": sorted((i, len(re.findall(r"\S+", t or "", re.UNICODE))) for i, t in rows),
    }


COLUMNS = {
    "bytes": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "words": ["doc_id", "n_words", "n_removed", "kept_sha256"], "simhash": ["doc_id", "fingerprint", "component_id"],
    "pii": ["doc_id", "base_sha256"], "secrets": ["doc_id", "base_sha256"], "media": ["doc_id", "n_bytes", "payload_sha256"], "counts": ["doc_id", "n_words"],
}


@pytest.fixture(scope="module")
def odd(spark, folder):
    """The odd rows, and a text of 2.5 million characters beside a near copy of its middle."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    r = random.Random(1)
    long = " ".join("".join(r.choices("abcdefg", k=r.randint(2, 9))) for _ in range(400_000))
    more = [(50, long + " mail jo@x.example token=abcdef1 1.2.3.4", "en", "a", 0), (51, long[900_000:900_400] + " end", "en", "a", 0)]
    return docs.select(*SCHEMA_NAMES).unionByName(spark.createDataFrame(more, SCHEMA)).persist()


def test_values_on_odd_and_very_long_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(repeats, "PART", 1 << 19)
    want = brute(odd)
    for name, columns in COLUMNS.items():
        found = ONE_ROW_EACH[name](odd).select(*columns)
        got = sorted(tuple((1 << 62) if c == "doc_id" and x is None or c == "component_id" and x is None else x for c, x in zip(columns, row, strict=True)) for row in found.collect())
        assert got == want[name], name


def test_a_long_text_scans_in_seconds():
    lines = "\n".join(f"user: alice{i} token=abcdef{i} 10.0.0.{i % 256} see https://x.example/{i}" for i in range(30_000))
    began = time.monotonic()
    assert len(secrets.scan(lines)) >= 60_000 and len(pii.base_spans(lines)) >= 30_000
    assert time.monotonic() - began < 30


def test_no_checkpoint_folder_of_the_drivers_own_on_a_cluster():
    from types import SimpleNamespace

    from graphloom.llm.common import checkpoint_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default)))
