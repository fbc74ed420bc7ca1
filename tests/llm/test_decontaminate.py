import re

from graphloom.llm import decontaminate
from graphloom.llm import decontaminate as d


def slow(docs, items):
    def shingles(text, n):
        words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").casefold())
        n = n or min(5, len(words))
        return n, {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()

    out = []
    for doc, text in docs:
        for item, other in items:
            n, mine = shingles(other, 0)
            if mine and len(mine & shingles(text, n)[1]) >= 0.8 * len(mine):
                out.append((doc, item, len(mine), len(mine & shingles(text, n)[1])))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    truth = slow([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert truth
    for size in (d.BLOCK_BYTES, 3000):  # one block and several
        monkeypatch.setattr(d, "BLOCK_BYTES", size)
        got = d.find_leaks(docs, bench)
        assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == truth
        left = {r.doc_id for r in d.drop_leaks(docs, bench).collect()}
        assert left == {r.doc_id for r in docs.collect()} - {t[0] for t in truth}


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    docs = [(1, f"{long} Alpha, beta gamma-delta EPSILON zeta eta {long}"), (2, None), (3, ""), (4, "alpha beta"), (4, "alpha beta"), (None, "alpha beta gamma delta epsilon zeta")]
    items = [(1, "alpha beta gamma delta epsilon zeta"), (2, "alpha  BETA"), (3, None), (4, " . "), (None, "zeta eta w0 w1 w2 w3 w4"), (5, "unseen words that no document has at all")]
    frame = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r)[:4] for r in d.find_leaks(frame, bench).collect()), key=str) == slow(docs, items)
    assert d.find_leaks(frame.limit(0), bench).count() == 0
    assert d.find_leaks(frame, bench.limit(0)).count() == 0
    assert sorted(r.doc_id for r in d.drop_leaks(frame, bench).collect()) == [2, 3]
    assert d.drop_leaks(frame, bench).columns == frame.columns


def test_copies_in_capitals(spark):
    item = "über die straße ging ñandú él sólo où était l'élève"
    frame = spark.createDataFrame([(1, f"Vorher. {item.upper()}!! Nachher."), (2, item), (3, "über die straße ging niemand")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in d.find_leaks(frame, bench).collect()) == [1, 2]
    assert [r.doc_id for r in d.drop_leaks(frame, bench).collect()] == [3]


def test_long_texts_in_pieces(monkeypatch):
    """A text that is searched in pieces gives what it gives whole, wherever the cuts fall."""
    import random

    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 9)))
    items = [" ".join(word() for _ in range(n)) for n in (1, 3, 5, 6, 12, 40)]
    texts = []
    for _ in range(6):
        parts = []
        for _ in range(30):
            parts.append(r.choice(items) if r.random() < 0.2 else " ".join(word() for _ in range(r.randint(1, 30))))
        texts.append(r.choice((" ", "\n", ", ")).join(parts) + "z" * r.choice((0, 500)))
    index = decontaminate.Index(list(enumerate(items)))
    want = index.leaks(texts)
    assert len(want) > 10
    for long in (1, 20, 90, 700):
        monkeypatch.setattr(decontaminate, "LONG", long)
        assert sorted(index.leaks(texts)) == sorted(want)


def test_short_items_condemn_only_whole_documents(spark):
    bench = spark.createDataFrame([(1, "yes indeed"), (2, "one two three four five six")], "item_id long, text string")
    rows = [(1, "Yes, indeed!"), (2, "he said yes indeed and left"), (3, "x one two three four five six y"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.find_leaks(docs, bench).collect()) == [1, 2, 3]
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()) == [2, 4]
