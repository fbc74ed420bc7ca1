"""Language, media, packing, token counts and the pipeline."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, langid, matroska, packing, secrets, simhash, tokencount, wordbpe

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").persist()


def test_language_on_held_out_documents(spark, docs):
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    assert sum(r.rejected for r in rows) / len(rows) < 0.02
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark, docs):
    odd = spark.createDataFrame([(1, None, "en", "x"), (2, "", None, "x"), (3, "123 !?", "en", "x"), (None, "the thing that is in the and", None, None)], "doc_id long, text string, lang string, score string")
    model = langid.train(docs)
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in langid.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", True) and got[None][0] == "en"
    assert {r.lang_pred for r in langid.predict(odd, {}).collect()} == {"und"}
    kept = langid.keep_identified(docs.where("doc_id < 50").withColumn("extra", F.lit(1)))
    assert kept.columns == [*docs.columns, "extra"] and kept.count() >= 48
    # neither the label nor the id is an input of a prediction
    moved = docs.where("doc_id < 20").select((F.col("doc_id") + 4000).alias("doc_id"), "text", F.lit("xx").alias("lang"))
    a = sorted((r.doc_id - 4000, r.lang_pred, r.score) for r in langid.predict(moved, model).collect())
    assert a == sorted((r.doc_id, r.lang_pred, r.score) for r in langid.predict(docs.where("doc_id < 20"), model).collect())


def test_matroska_round_trips():
    r = random.Random(3)
    for n in [0, 1, 63, 64, 65, 1024, 8192, 8193, 65536, 200_001]:
        payload = matroska.payload_of("é" * (n // 2) + "x" * (n % 2))
        assert len(payload) % 64 == 0 and len(payload) >= max(64, n)
        data = matroska.encode(payload)
        media = matroska.parse(data)
        assert not media.error and matroska.read_back(data, media) == payload
        assert {place for _, _, place in media.cues} == set(media.clusters)
        assert media.tracks == [{"number": 1, "type": 2, "codec": "A_PCM/INT/LIT", "channels": 1, "bits": 8}]
    for mode in ("xiph", "ebml", "fixed", "none"):
        for _ in range(30):
            k = 1 if mode == "none" else r.randint(1, 9)
            size = r.randint(0, 700)
            frames = [bytes(r.randbytes(size if mode == "fixed" else r.randint(0, 20_000))) for _ in range(k)]
            data = matroska.lace(frames, mode)
            sizes, at = matroska.frame_sizes(data, 0, len(data), mode)
            assert sizes == [len(f) for f in frames] and data[at:] == b"".join(frames)


def test_matroska_of_others():
    block = matroska.block(matroska.SIMPLE_BLOCK, 300, -5, [b"abc"], "none")
    cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + matroska.unsigned(matroska.CLUSTER_TIMESTAMP, 100) + block
    cues = matroska.element(matroska.CUES, b"")
    data = matroska.element(matroska.EBML, b"") + matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster + cluster + cues
    media = matroska.parse(data)
    assert not media.error and [(p[0], p[1], p[5]) for p in media.packets] == [(300, 95, 3)] * 2 and len(media.clusters) == 2
    broken = matroska.parse(data[:-20])
    assert broken.error and len(broken.packets) >= 1
    assert matroska.parse(None).packets == [] and matroska.parse(b"\x00junk").error


def test_media_digest(spark):
    docs = spark.createDataFrame([(1, "abc", 1), (2, None, 2), (3, "abc", 3), (3, "abc", 3), (None, "x" * 70_000, 4)], "doc_id long, text string, media int")
    rows = matroska.media_digest(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 5 and by[1].feature == by[3].feature and by[1].media_sha256 == by[3].media_sha256
    want = b"abc" + bytes(61)
    assert (by[1].n_bytes, by[1].payload_bytes, by[1].payload_sha256, by[1].tail_crc32) == (3, 64, hashlib.sha256(want).hexdigest(), zlib.crc32(want))
    assert by[2].n_bytes == 0 and by[2].payload_bytes == 64
    packets = matroska.packet_table(matroska.media_table(docs))
    assert packets.where("doc_id is null").agg(F.sum("byte_length")).first()[0] == by[None].payload_bytes
    assert matroska.media_digest(docs.limit(0)).count() == 0


def test_ids_equal_the_library(docs):
    bpe = wordbpe.WordBPE()
    texts = [r.text for r in docs.where("doc_id < 150").collect()]
    r = random.Random(2)
    texts += ["".join(r.choices("aAbBeEßÉİΣς'stm 1½²́\n\t\x1c\x85　中🙂<|>", k=40)) for _ in range(300)]
    texts += ["", " ", "<|endoftext|>x <|startoftext|>", "don't WE'LL'S", "a" * 3000, "ÀÁ" * 200]
    for width, ids in zip(texts, bpe.encode(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u2").tolist() == bpe.library.encode(width, add_special_tokens=False).ids, width


def test_words_need_no_search_and_the_first_pieces_stay(monkeypatch):
    searched, split = set(), wordbpe.SPLIT

    class Search:
        def findall(self, text):
            searched.add(text)
            return split.findall(text)

    monkeypatch.setattr(wordbpe, "SPLIT", Search())
    bpe = wordbpe.WordBPE()
    bpe.KEEP = 40
    texts = ["The first, Élan!** STRASSE's straße; don't stop'. (x) a<|b İx. Ⱥ?", *(f"the {chr(97 + i % 26) * (2 + i // 26)}.. Word{chr(97 + i % 26) * (2 + i // 26)}" for i in range(80))]
    for text in texts:
        assert np.frombuffer(bpe.encode([text])[0], dtype="<u2").tolist() == bpe.library.encode(text, add_special_tokens=False).ids, text
    assert searched == {"strasse's", "don't", "stop'.", "(x)", "i̇x."}
    assert len(bpe.known) <= 43 and {"", "The", "first,"} <= bpe.known.keys()


def test_packing_against_brute_force(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = spark.createDataFrame([(5000, None), (5001, ""), (None, "one two"), (5002, "same"), (5002, "same")], "doc_id long, text string")
    some = docs.where("doc_id < 120").select("doc_id", "text").unionByName(odd).repartition(5).persist()
    some.count()
    pieces = packing.pack(some).collect()
    ids = sorted((r.doc_id is None, r.doc_id or 0, [*library.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in some.collect())
    assert sum(p.length for p in pieces) == sum(len(i) for _, _, i in ids)
    known = {}
    for none, doc, own in ids:
        known[None if none else doc] = own
    seen = {}
    for p in pieces:
        own = known[p.doc_id]
        assert p.doc_tokens == len(own)
        cut = own[p.start : p.start + p.length]
        assert len(cut) == p.length and zlib.crc32(struct.pack(f"<{p.length}I", *cut)) == p.ids_crc32
        seen.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for k, parts in seen.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or k == max(seen)
    assert sorted(seen) == list(range(len(seen)))
    assert packing.pack(some.limit(0)).count() == 0


def test_pieces_do_not_depend_on_later_partitions(spark, docs):
    some = docs.where("doc_id < 90").select("doc_id", "text").repartition(4)
    kept = lambda df: sorted(tuple(r) for r in df.collect())
    pieces = packing.pack(some)
    whole = kept(pieces)
    places = sorted((r[5], r[6], r[2]) for r in whole)
    assert all(a[0] * 2048 + a[1] + a[2] == b[0] * 2048 + b[1] for a, b in zip(places, places[1:]))
    assert kept(pieces.coalesce(1)) == kept(pieces.coalesce(3)) == kept(pieces.repartition(7)) == whole
    assert kept(pieces.unionByName(pieces).coalesce(2)) == sorted(whole * 2)
    twice = packing.pack(some).unionByName(packing.pack(some))
    assert twice.count() == 2 * len(whole)
    with pytest.raises(Exception, match="KeyError"):
        packing.cut(packing.encoded(some), {99: 0}).count()


def test_token_counts_against_brute_force(spark):
    scores = tokencount.piece_scores(public_tokenizers.path("piece_bpe_32k.model"))
    low = min(scores.values()) - tokencount.UNKNOWN
    r = random.Random(4)
    words = {"", "the", "thethe", "naïve", "中文", "🙂🙂", "a" * 50, *("".join(r.choices("abcdethinogé🙂", k=r.randint(1, 9))) for _ in range(400))}
    got = tokencount.count_tokens(words, scores)
    for w in words:
        token = "▁" + w
        best = {0: (0.0, 0)}
        for i in range(1, len(token) + 1):
            ways = [(-(best[i - 1][0] + low), best[i - 1][1] + len(token[i - 1].encode()))]
            ways += [(-(best[j][0] + scores[token[j:i]]), best[j][1] + 1) for j in range(i) if token[j:i] in scores]
            s, n = min(ways)
            best[i] = (-s, n)
        assert got[w] == best[len(token)][1], w
    docs = spark.createDataFrame([(1, "the the\nnaïve", 0), (2, None, 0), (3, " ", 0), (None, "x", 0), (None, "x", 0)], "doc_id long, text string, n_tokens int")
    rows = sorted(((x.doc_id, x.n_words, x.n_tokens) for x in tokencount.token_counts(docs).collect()), key=str)
    assert rows == sorted([(1, 3, 2 * got["the"] + got["naïve"]), (2, 0, 0), (3, 0, 0)] + [(None, 1, tokencount.count_tokens({"x"}, scores)["x"])] * 2, key=str)
    assert tokencount.token_counts(docs.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "packing"]
    now, ids = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = stage(spark, now, SF)
        if name != "packing":
            assert now.columns == docs.columns
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = {r.doc_id for r in now.select("doc_id").distinct().collect()}
        if name == "language_id":
            model = langid.train(before)
            bad = {r.doc_id for r in langid.predict(before, model).where("rejected").collect()}
            assert ids[name] == {r.doc_id for r in before.collect()} - bad
        elif name == "simhash_near_dedup":
            assert ids[name] == {r.component_id for r in simhash.near_duplicates(before).collect()} and now.count() == len(ids[name])
        elif name == "benchmark_decontamination":
            leaks = {r.doc_id for r in decontaminate.find_leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert leaks and ids[name] == {r.doc_id for r in before.collect()} - leaks
        elif name == "secret_scans":
            assert ids[name] == {r.doc_id for r in before.collect()}
            assert not [r for r in now.collect() if any(s[3] for s in secrets.scan(r.text))]
    assert ids["packing"] == ids["secret_scans"]
