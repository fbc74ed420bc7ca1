"""Personal data: patterns, and terms that give an entity away.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Each
value found is a protected entity. How much a term reveals of an entity is
estimated from the corpus: with document frequencies over all documents,
``disclosure = PMI(entity, term) / IC(entity)``, which is 1 where the term occurs only
with the entity and about 0 where they are independent. Both counts are of whole
documents: every term of a document that holds an entity occurs with it, however
far apart they stand. Terms are generalised from ``GENERALISE`` on and removed from
``REMOVE`` on, wherever they occur in the corpus outside an entity, also in documents
that do not name it. They need ``SUPPORT`` different contexts: the ``CONTEXT`` words
around the entity, one for each document with both, or those in which the term
itself stands. Copies of a document repeat one context and are no evidence.

The texts are scanned four times and never shuffled: for base spans and entities
(checkpointed), for term frequencies (counted per task before they are shuffled),
for the terms of the documents whose entities have contexts enough (checkpointed),
and for the places of revealing terms. Which entities and terms the last two look for
goes out as a bit map of fixed size; joins with the exact tables drop what
only shares a bit, so no table is collected.

Defined results: a null or empty text has no spans; a null ``doc_id`` stays null;
repeated rows have equal spans; entities in every document have no information
and reveal nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SEPARATOR, batch_of, checkpoint_dir, doc_text, joined_text, map_arrow, span_hashes, text_chunks, word_spans
from .spans import SPANS, SPANS_ARROW, Span, base_digest, counted, joined, replaced

KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
#: Words on either side of an entity, distinct contexts, and the shares of an entity's information from which a term is generalised or removed.
CONTEXT, SUPPORT, GENERALISE, REMOVE = 6, 2, 0.6, 0.85
#: Shortest term in UTF-8 bytes.
SHORTEST = 3
#: Leading bits of a hash that index a bit map.
MAP_BITS = 22

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can only start where a run of digits does, so the runs are possessive.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

TERM = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")


def emails(text: str) -> list[Span]:
    """Found from each ``@`` outwards: the local part cannot hold one, so this is the leftmost match."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end(), True))
            end = m.end()
        at = text.find("@", max(end, at + 1))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, by start and then kind."""
    out = emails(text)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span(), True))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = re.sub("[^0-9]", "", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span(), True))
        if "+" in text:
            out += [("phone", *m.span(), True) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def folded_term(word: str) -> bytes:
    return word.encode("utf-8", "surrogatepass").lower()


def term_hash(terms: list[bytes]) -> np.ndarray:
    """Hashes that equal those of the same terms within a text."""
    sizes = np.cumsum([0, *map(len, terms)])
    return span_hashes(np.frombuffer(b"".join(terms), dtype=np.uint8), sizes[:-1], sizes[1:]).view(np.int64)


def words_outside(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """The words of a text that overlap no span."""
    taken = [(a, b) for _, a, b, _ in spans]
    words = [m.span() for m in TERM.finditer(text)]
    return [w for w in words if not any(a < w[1] and w[0] < b for a, b in taken)] if len(taken) < 50 else _outside(words, taken)


def entity_hash(text: str, span: Span) -> int:
    return xxhash.xxh64_intdigest(f"{span[0]}:{text[span[1] : span[2]]}", 7) - (1 << 63)


def around(text: str, spans: list[Span]) -> list[tuple[int, int, list[bytes]]]:
    """Entity, context and the words by it, for each span."""
    words = words_outside(text, spans)
    starts = np.array([w[0] for w in words], dtype=np.int64)
    out = []
    for span in spans:
        i = int(np.searchsorted(starts, span[1]))
        near = [folded_term(text[x:y]) for x, y in words[max(0, i - CONTEXT) : i + CONTEXT]]
        out.append((entity_hash(text, span), xxhash.xxh64_intdigest(b" ".join(near), 7) - (1 << 63), near))
    return out


def _outside(words: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Words that overlap no span, where there are many spans."""
    spans = np.array(sorted(taken), dtype=np.int64)
    reach = np.maximum.accumulate(spans[:, 1])
    before = np.searchsorted(spans[:, 0], [w[1] for w in words], side="left") - 1
    return [w for w, k in zip(words, before.tolist(), strict=True) if k < 0 or reach[k] <= w[0]]


ENTITIES = "array<struct<entity: bigint, context: bigint>>"
ENTITIES_ARROW = pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64())]))
NEAR = "array<struct<entity: bigint, context: bigint, term: bigint>>"
NEAR_ARROW = pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64()), ("term", pa.int64())]))
HITS = "array<struct<term: bigint, start: int, end: int>>"
HITS_ARROW = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))


def keyed(docs: DataFrame) -> DataFrame:
    return doc_text(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")


def base_table(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, spans, entities``: base spans of each text, its entities and their contexts."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, entities = [], []
        for text in batch.column(2).to_pylist():
            found = base_spans(text)
            spans.append([{"kind": k, "start": a, "end": b, "base": True} for k, a, b, _ in found])
            entities.append([{"entity": e, "context": c} for e, c in sorted({x[:2] for x in around(text, found)})] if found else [])
        return batch_of(doc_id=(pa.int64(), batch.column(0)), row_key=(pa.int64(), batch.column(1)), spans=(SPANS_ARROW, spans), entities=(ENTITIES_ARROW, entities))

    return map_arrow(keyed(docs), step, f"doc_id long, row_key long, spans {SPANS}, entities {ENTITIES}")


def bit_map(hashes: DataFrame) -> bytes:
    """Packed bits, set at the leading bits of each hash of the one column; as large for any number of them."""
    bits = np.zeros(1 << MAP_BITS, dtype=bool)
    places = hashes.select(F.shiftrightunsigned(F.col(hashes.columns[0]), 64 - MAP_BITS).cast("int").alias("place")).distinct()
    bits[places.toArrow().column(0).to_numpy()] = True
    return np.packbits(bits).tobytes()


def mapped(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes have their bit set."""
    place = hashes.view(np.uint64) >> np.uint64(64 - MAP_BITS)
    return (np.frombuffer(bits, dtype=np.uint8)[place >> np.uint64(3)] >> (7 - (place & np.uint64(7))).astype(np.uint8)) & 1 > 0


def company(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``row_key, held, terms, near`` of the documents that hold a wanted entity: one context for each
    entity of the document, all its distinct terms outside entities, and those by each entity."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(wanted))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, held, terms, near = [], [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            spans = base_spans(text)
            if not spans or not mapped(bits.value, np.array([entity_hash(text, s) for s in spans], dtype=np.int64)).any():
                continue
            sites = around(text, spans)
            known = mapped(bits.value, np.array([e for e, _, _ in sites], dtype=np.int64)).tolist()
            words = sorted({t for x, y in words_outside(text, spans) if len(t := folded_term(text[x:y])) >= SHORTEST})
            code = dict(zip(words, term_hash(words).tolist() if words else [], strict=True))
            least: dict[int, int] = {}
            beside = set()
            for (e, c, ts), k in zip(sites, known, strict=True):
                if k:
                    least[e] = min(c, least.get(e, c))
                    beside.update((e, c, code[t]) for t in ts if t in code)
            keys.append(key)
            held.append([{"entity": e, "context": c} for e, c in least.items()])
            terms.append(list(code.values()))
            near.append([{"entity": e, "context": c, "term": t} for e, c, t in beside])
        return batch_of(row_key=(pa.int64(), keys), held=(ENTITIES_ARROW, held), terms=(pa.list_(pa.int64()), terms), near=(NEAR_ARROW, near))

    return map_arrow(keyed(docs).select("row_key", "text"), step, f"row_key long, held {ENTITIES}, terms array<bigint>, near {NEAR}")


def places(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``row_key, term, start, end``: where the wanted terms stand outside entities, in any document."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(wanted))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, hits = [], []
        texts = batch.column(1).to_pylist()
        for lo, hi in text_chunks(texts):
            raw, offsets = joined_text(texts[lo:hi])
            if not len(raw):
                continue
            points = np.zeros(len(raw) + 1, dtype=np.int64)
            np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
            raw = LOWER[raw]
            starts, stops, doc = word_spans(raw, offsets, SEPARATOR)
            long = stops - starts >= SHORTEST
            starts, stops, doc = starts[long], stops[long], doc[long]
            h = span_hashes(raw, starts, stops)
            hit = mapped(bits.value, h) if len(h) else np.zeros(0, dtype=bool)
            h, doc, starts, stops = h[hit].view(np.int64), doc[hit], starts[hit], stops[hit]
            words = np.stack([points[starts] - points[offsets[doc]], points[stops] - points[offsets[doc]]], axis=1).tolist()
            which, first = np.unique(doc, return_index=True)
            for d, i, j in zip(which.tolist(), first.tolist(), np.append(first, len(doc))[1:].tolist(), strict=True):
                found = [(a, b) for _, a, b, _ in base_spans(texts[lo + d])]
                own = [tuple(w) for w in words[i:j]]
                free = set(_outside(own, found)) if found else set(own)
                keys.append(batch.column(0)[lo + d].as_py())
                hits.append([{"term": t, "start": w[0], "end": w[1]} for t, w in zip(h[i:j].tolist(), own, strict=True) if w in free])
        return batch_of(row_key=(pa.int64(), keys), hits=(HITS_ARROW, hits))

    return map_arrow(keyed(docs).select("row_key", "text"), step, f"row_key long, hits {HITS}").select("row_key", F.inline("hits"))


def term_frequencies(docs: DataFrame) -> DataFrame:
    """``term, n_docs``: in how many documents each term occurs; added up in each task before the shuffle."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in text_chunks(texts):
                raw, offsets = joined_text(texts[lo:hi])
                if not len(raw):
                    continue
                raw = LOWER[raw]
                starts, stops, doc = word_spans(raw, offsets, SEPARATOR)
                long = stops - starts >= SHORTEST
                h, doc = span_hashes(raw, starts[long], stops[long]), doc[long]
                if not len(h):
                    continue
                order = np.argsort(h, kind="stable")
                h, doc = h[order], doc[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = h[1:] != h[:-1]
                first = new.copy()
                first[1:] |= doc[1:] != doc[:-1]
                at = np.flatnonzero(new)
                parts.append((h[at], np.add.reduceat(first, at, dtype=np.int64)))
                held += len(at)
                if held > 2_000_000:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held > 1_000_000:
                        yield batch_of(term=(pa.int64(), parts[0][0].view(np.int64)), n=(pa.int64(), parts[0][1]))
                        parts, held = [], 0
        if parts:
            keys, n = merged(parts)
            yield batch_of(term=(pa.int64(), keys.view(np.int64)), n=(pa.int64(), n))

    counts = doc_text(docs).select("text").mapInArrow(run, "term long, n long")
    return counts.groupBy("term").agg(F.sum("n").alias("n_docs"))


def entity_counts(base: DataFrame) -> DataFrame:
    """``entity, n_entity`` of the entities that have contexts enough for any term."""
    found = base.where(F.size("entities") > 0).select("row_key", F.inline("entities"))
    counts = found.groupBy("entity").agg(F.count_distinct("row_key").alias("n_entity"), F.count_distinct("context").alias("contexts"))
    return counts.where(F.col("contexts") >= SUPPORT).drop("contexts")


def disclosures(company: DataFrame, entities: DataFrame, frequencies: DataFrame, total: int) -> DataFrame:
    """``entity, term, disclosure`` of the pairs with support."""
    held = company.select("row_key", "terms", F.inline("held")).select("row_key", "entity", "context", F.explode("terms").alias("term"))
    pairs = held.groupBy("entity", "term").agg(F.count_distinct("context").alias("apart"), F.count_distinct("row_key").alias("n_both"))
    beside = company.select(F.inline("near")).groupBy("entity", "term").agg(F.count_distinct("context").alias("beside"))
    pairs = pairs.join(beside, ["entity", "term"], "left").where((F.col("apart") >= SUPPORT) | (F.col("beside") >= SUPPORT))
    information = F.log(F.lit(float(total)) / F.col("n_entity"))
    pmi = F.log(F.col("n_both") * F.lit(float(total)) / (F.col("n_entity") * F.col("n_docs")))
    return pairs.join(entities, "entity").join(frequencies, "term").where(information > 0).select("entity", "term", (pmi / information).alias("disclosure"))


def pii_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, spans``: base spans and those of terms that disclose an entity."""
    checkpoint_dir(docs.sparkSession)
    base = base_table(docs).checkpoint()
    entities = entity_counts(base).checkpoint()
    shared = company(docs, entities.select("entity")).checkpoint()
    told = disclosures(shared, entities, term_frequencies(docs), base.count()).where(F.col("disclosure") >= GENERALISE)
    kind = F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise")
    told = told.groupBy("term").agg(F.max(kind).alias("kind")).checkpoint()
    added = (
        places(docs, told.select("term"))
        .join(told, "term")
        .groupBy("row_key")
        .agg(F.array_sort(F.collect_set(F.struct("start", "end", "kind"))).alias("added"))
    )
    extra = F.transform(F.coalesce("added", F.array()), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(False).alias("base")))
    rank = {k: i for i, k in enumerate(KINDS)}
    by_start = lambda s: F.struct(s["start"], F.element_at(F.create_map(*[F.lit(x) for kv in rank.items() for x in kv]), s["kind"]).alias("rank"), s["end"], s)
    whole = F.transform(F.array_sort(F.transform(F.concat("spans", extra), lambda s: F.struct(s["start"].alias("a"), by_start(s)["rank"].alias("r"), s["end"].alias("b"), s.alias("s")))), lambda x: x["s"])
    return base.join(added, "row_key", "left").select("doc_id", "row_key", whole.alias("spans"))


def pii_digest(docs: DataFrame) -> DataFrame:
    s = F.col("spans")
    return pii_spans(docs).select(
        "doc_id",
        *[counted(s, k).alias(f"n_{k}") for k in KINDS[:4]],
        base_digest(s).alias("base_sha256"),
        joined(s).alias("spans"),
        (counted(s, "generalise") + counted(s, "remove")).alias("n_terms"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with entities as ``[EMAIL]`` and the like, revealing terms as ``[TERM]`` or left out."""
    names = {"generalise": "[TERM]", "remove": ""}

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [
            replaced(t, [(s["start"], s["end"], names.get(s["kind"], f"[{s['kind'].upper()}]")) for s in spans or []]) if spans else t
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        ]
        return batch_of(doc_id=(pa.int64(), batch.column(0)), text=(pa.string(), texts))

    found = pii_spans(docs).select("row_key", "spans").where(F.size("spans") > 0).dropDuplicates(["row_key"])
    rows = doc_text(docs).withColumn("row_key", F.xxhash64("doc_id", "text")).join(found, "row_key", "left")
    return map_arrow(rows.select("doc_id", "text", "spans"), step, "doc_id long, text string")
