import hashlib
import random
import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import dedup_bytes, dedup_words, repeats


def slow_bytes(rows, w=50):
    """rows: (id, text), ids without nulls."""
    least = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        for s in range(len(raw) - w + 1):
            k = raw[s : s + w]
            least[k] = min(i, least.get(k, i))
    out = []
    for i, raw in raws:
        gone = [False] * len(raw)
        for s in range(len(raw) - w + 1):
            if least[raw[s : s + w]] < i:
                gone[s : s + w] = [True] * w
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = len(re.findall("1+", "".join("01"[g] for g in gone)))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def slow_words(rows, w=20):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, words in split:
        for s in range(len(words) - w + 1):
            k = tuple(words[s : s + w])
            least[k] = min((i, s), least.get(k, (i, s)))
    out = []
    for i, words in split:
        gone = [False] * len(words)
        for s in range(len(words) - w + 1):
            if least[tuple(words[s : s + w])] < (i, s):
                gone[s : s + w] = [True] * w
        kept = " ".join(x for x, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def made(seed, n=60):
    """Documents full of shared passages, edited copies, repeated lines and self-repeats over a small alphabet."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abé", k=r.randint(1, 4)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(r.choice((5, 12, 25, 40))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            kind = r.random()
            if kind < 0.4:
                p = r.choice(passages).split(" ")
                lo = r.randint(0, len(p) // 3)
                parts.append(" ".join(p[lo : r.randint(lo, len(p))]))
            elif kind < 0.6 and out:
                old = r.choice(out).split(" ")
                if len(old) > 2:
                    old[r.randrange(len(old))] = word()
                parts.append(" ".join(old))
            elif kind < 0.7:
                parts.append(" ".join([word()] * 70))
            else:
                parts.append(text(r.randint(0, 30)))
        out.append(r.choice((" ", "\n", " \t")).join(parts))
    return list(enumerate(out)) + [(n, ""), (n + 1, None), (n + 2, "short")]


@pytest.mark.parametrize(("block", "hot", "few", "part"), [(8 << 20, 1 << 12, 8, 4 << 20), (700, 1 << 12, 8, 4 << 20), (700, 2, 1, 90), (8 << 20, 3, 0, 4 << 20), (8 << 20, 1 << 12, 8, 150)])
def test_bytes_and_words_against_brute_force(spark, monkeypatch, block, hot, few, part):
    """Also with anchors that count as hot after a few blocks or runs, and with texts that are cut."""
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr(repeats, "PART", part)
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "FEW", few)
    for seed in (1, 2):
        rows = made(seed)
        docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, block string, bucket int")
        assert sorted(map(tuple, dedup_bytes.repeats_digest(docs).collect())) == slow_bytes(rows)
        assert sorted(map(tuple, dedup_words.repeats_digest(docs).collect())) == slow_words(rows)


@pytest.mark.parametrize("module", [dedup_bytes, dedup_words])
def test_the_suffix_structure_decides(spark, monkeypatch, module):
    """Without its answer nothing is removed, not even from exact copies."""
    rows = made(3) + [(100 + i, "one and the same text " * 9) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    count = lambda: module.repeats_digest(docs).agg(F.sum("n_removed")).first()[0]
    assert count() > 0
    monkeypatch.setattr(module, "SHAPE", replace(module.SHAPE, settle=lambda parts, none: np.full(int(parts.windows.sum()), none)))
    assert count() == 0


def test_long_texts_of_one_anchor(monkeypatch):
    """Strings of one anchor that are sorted in step and by themselves give the same ranks as a dictionary of windows."""
    r = random.Random(4)
    anchor = bytes(r.choices(b"xyz", k=24))
    data, lead = [], []
    for _ in range(60):
        left, right = r.choice((b"ab" * 13, b"aabb" * 6))[-r.randint(3, 26) :], r.choice((b"ba" * 13, b"abb" * 8))[: r.randint(10, 26)]
        text = (left + anchor + right)[: 26 + 24 + 26]
        if len(text) >= 50 and len(left) + 24 <= 50:
            data.append(text)
            lead.append(len(left))
    windows = np.array([max(1, min(len(t) - 49, a + 1)) for t, a in zip(data, lead)])
    data = [t[: n + 49] for t, n in zip(data, windows.tolist())]
    rank = np.array([r.randrange(20) for _ in data])
    several = np.array([r.random() < 0.1 for _ in data])
    places = {}
    for t, n, k, s in zip(data, windows.tolist(), rank.tolist(), several.tolist()):
        for i in range(n):
            places.setdefault(t[i : i + 50], []).append((k, s))
    want = [min(p)[0] if len(p := places[t[i : i + 50]]) > 1 or p[0][1] else 99 for t, n in zip(data, windows.tolist()) for i in range(n)]
    assert len(set(want)) > 5
    for long in (1 << 15, 40):
        monkeypatch.setattr(dedup_bytes, "LONG", long)
        parts = repeats.Parts(data, windows, rank, several, np.zeros(len(data), dtype=np.uint64), np.array(lead), np.zeros(len(data), dtype=bool))
        assert dedup_bytes.settle(parts, 99).tolist() == want


def test_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(4)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, dedup_bytes.repeats_digest(docs).collect())) == slow_bytes(rows)
    assert sorted(map(tuple, dedup_words.repeats_digest(docs).collect())) == slow_words(rows)


def test_odd_rows(spark):
    t = " ".join(f"word{i}" for i in range(25))
    docs = spark.createDataFrame([(None, t), (None, t), (7, t), (7, t)], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.n_removed) for r in dedup_bytes.repeats_digest(docs).collect()))
    assert got == [(False, 0), (False, 0), (True, len(t)), (True, len(t))]
    got = sorted(((r.doc_id is None, r.n_removed) for r in dedup_words.repeats_digest(docs).collect()))
    assert got == [(False, 0), (False, 0), (True, 25), (True, 25)]
    none = docs.where(F.lit(False))
    assert dedup_bytes.repeats_digest(none).count() == dedup_words.repeats_digest(none).count() == 0
    kept = {r.doc_id: r.kept for r in dedup_words.without_repeats(docs.where("doc_id = 7")).collect()}
    assert kept == {7: bytearray(t.encode())}


def test_long_texts_are_cut_and_joined(spark, monkeypatch):
    """What stays of texts that are cut, of words longer than a part, and of blanks alone."""
    monkeypatch.setattr(repeats, "PART", 64)
    r = random.Random(7)
    words = ["".join(r.choices("aé🙂", k=r.choice((1, 3, 9, 200)))) for _ in range(60)]
    rows = [(1, " ".join(words)), (2, "x" * 70 + " \n\t " + " ".join(words[10:50]) + "  "), (3, " " * 300), (2, "é" * 100), (5, " ".join(words[5:40] + words[5:40]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for module, slow, got in ((dedup_bytes, slow_bytes, ("n_bytes", "n_removed", "n_spans")), (dedup_words, slow_words, ("n_words", "n_removed"))):
        digest = sorted(map(tuple, module.repeats_digest(docs).collect()))
        assert digest == slow(rows)
        plain = sorted((x.doc_id, *(x[c] for c in got), hashlib.sha256(bytes(x.kept)).hexdigest()) for x in module.without_repeats(docs).collect())
        assert plain == digest


def test_hashes_are_made_in_pieces_that_stay_in_cache(monkeypatch):
    sizes = []
    made = repeats.gram_hashes
    monkeypatch.setattr(repeats, "gram_hashes", lambda values, n: sizes.append(len(values)) or made(values, n))
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(97, 123, n))) for n in (300_000, 49, 60_000, 0, 50)]
    values, _, _, offsets = dedup_bytes.SHAPE.tokens(texts)
    runs = repeats.find_runs(values, offsets, dedup_bytes.SHAPE)
    windows = [np.arange(max(0, len(t) - 49)) + at for t, at in zip(texts, offsets.tolist())]
    assert np.concatenate([np.arange(a, b + 1) for a, b in zip(runs.first, runs.last)]).tolist() == np.concatenate(windows).tolist()
    assert ((runs.first <= runs.anchor) & (runs.anchor <= runs.first + 26)).all() and set(runs.doc.tolist()) == {0, 2, 4}
    contexts = [t.encode() for t in texts[2:3] * 4]
    repeats.window_hashes(contexts, np.array([len(t) - 49 for t in contexts]), dedup_bytes.SHAPE)
    assert max(sizes) <= 1 << 16
