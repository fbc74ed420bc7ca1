import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import simhash


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(pairs):
    """Component of each (id, fingerprint) by comparing all pairs."""
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(b)] = find(a)
    least = {}
    for d, f in pairs:
        least[find(f)] = min(d, least.get(find(f), d))
    return {(d, f): least[find(f)] for d, f in pairs}


def test_fingerprints_match_brute_force():
    texts = ["", None, "One", "one TWO", "a b c", "a b c a b c a b c", "É À\x0bx y z Z z", " \t\n", *(" ".join(random.Random(i).choices("abcdefg", k=i)) for i in range(1, 80))]
    assert [int(f) for f in simhash.fingerprints([t or "" for t in texts])] == [slow_fingerprint(t) for t in texts]


def test_links_of_every_kind(spark):
    r = random.Random(3)
    fps = set()
    for _ in range(120):
        f = r.getrandbits(64)
        fps.add(f)
        for bits in (1, 2, 3, 4):
            g = f
            for b in r.sample(range(64), bits):
                g ^= 1 << b
            fps.add(g)
        quarter = 16 * r.randrange(4)
        for bits in (3, 4):
            g = f
            for b in r.sample(range(quarter, quarter + 16), bits):
                g ^= 1 << b
            fps.add(g)
    for _ in range(300):  # a crowd about one centre
        g = 0x0123456789ABCDEF
        for b in r.sample(range(64), 3):
            g ^= 1 << b
        fps.add(g)
    fps = sorted(fps)
    table = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    for count in (len(fps), 200_000):  # one bucket and many
        found = simhash.components(simhash.ball_links(table, count))
        roots = {int(np.int64(n).view(np.uint64)): int(r) for n, r in found.collect()}
        truth = slow_classes([(i, f) for i, f in enumerate(fps)])
        mine = {}
        for i, f in enumerate(fps):
            mine.setdefault(roots.get(f, ("alone", f)), set()).add(i)
        theirs = {}
        for (i, _), c in truth.items():
            theirs.setdefault(c, set()).add(i)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_classes_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    pairs = [(r["doc_id"], slow_fingerprint(r["text"])) for r in docs.collect()]
    truth = slow_classes(pairs)
    assert rows == {d: (f, truth[d, f]) for d, f in pairs}


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(5, "x y z w", "a"), (3, "x y z w", "b"), (3, "x y z w", "b"), (None, "x y z w", "c"), (9, None, "d"), (8, "", "e"), (None, "q r s t u v", "f")], "doc_id long, text string, fp string"
    )
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (9, 8), (8, 8), (None, None)], key=str)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["fp"] for r in kept.collect()) == ["b", "e", "f"]
    assert simhash.near_duplicates(docs.where(F.lit(False))).count() == 0
