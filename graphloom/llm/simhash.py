"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints of 64 bits link at ``RADIUS`` = 3 or fewer differing bits. Half of that
is one bit on either side and one bit over. So the odd bit is taken away by
erasing a quarter of the fingerprint: with each of the four quarters erased in
turn, a fingerprint emits all variants within one bit of what is left, 4 * 49
of them. Of two fingerprints that differ in three bits, erase the quarter of
one of them: two differ still, and each side meets the other half way. (Balls
of radius 1 and 2 on the whole fingerprint need 2081 variants in place of
196.)

Distinct fingerprints only are hashed, so exact copies and fingerprints shared by thousands
are one. Variants travel packed, a block for each task and bucket. A bucket's
collisions are linked without listing pairs. Fingerprints that meet at a variant
differ in at most two bits outside the erased quarter. So those with equal
quarters all link, and hang on one of them; those whose quarters differ in one
bit all link too, and their centres are linked. Last, where nothing differs
outside, quarters that differ in three bits link. Every link is verified.

Defined results: texts without words have fingerprint zero, which links like
any other; a null text is empty; a null ``doc_id`` never is the least of a
component unless it has no other; repeated rows repeat (ties of an id are one node); no documents give
no rows; a very long text is read whole by one task, its shingles at about 30 bytes of memory a byte; other columns
are dropped by ``near_duplicates`` and kept by ``keep_first``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, checkpoint_dir, doc_text, map_arrow, mix64, text_chunks
from .components import components

SHINGLE, SEED, RADIUS, QUARTERS, WIDTH = 3, 42, 3, 4, 16
#: Variants in a bucket, about.
BUCKET = 1 << 20
#: Ids, counted before, up to which they are broadcast (16 MB).
SOME = 1 << 20


def fingerprints(texts: list[str]) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for lo, hi in text_chunks(texts):
        hashes, sizes = [], []
        for text in texts[lo:hi]:
            words = text.encode("utf-8", "surrogatepass").lower().split()
            if len(words) <= SHINGLE:
                hashes += [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
                sizes.append(bool(words))
                continue
            whole = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
            begins = np.zeros(len(words), dtype=np.int64)
            begins[1:] = ends[:-1] + 1
            n = len(words) - SHINGLE + 1
            hashes += map(xxhash.xxh64_intdigest, map(whole.__getitem__, map(slice, begins[:n].tolist(), ends[SHINGLE - 1 :].tolist())), repeat(SEED))
            sizes.append(n)
        counts = np.array(sizes, dtype=np.int64)
        full = np.flatnonzero(counts)
        if not len(full):
            continue
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        begin = (np.cumsum(counts) - counts)[full]
        ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
        out[lo + full] = np.packbits(ones * 2 > counts[full, None], axis=1).view(">u8").ravel()
    return out


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` of every document, the fingerprint as a signed long."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of(doc_id=(pa.int64(), batch.column(0)), fp=(pa.int64(), fingerprints(batch.column(1).to_pylist()).view(np.int64)))

    return map_arrow(doc_text(docs), step, "doc_id long, fp long")


def flips(quarter: int) -> np.ndarray:
    """No bit, and each bit outside a quarter."""
    return np.array([0, *(1 << b for b in range(64) if b // WIDTH != quarter)], dtype=np.uint64)


def erased(fp: np.ndarray, quarter: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints without a quarter, and the quarter."""
    shift = np.uint64(WIDTH * quarter)
    mask = np.uint64((1 << WIDTH) - 1) << shift
    return fp & ~mask, (fp & mask) >> shift


def bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def bucket_links(fp: np.ndarray, flip: np.ndarray, quarter: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, as pairs of fingerprints, among the variants of one bucket; ``flip`` numbers each one's flipped bit."""
    nothing = (np.empty(0, dtype=np.uint64),) * 2
    rest, part = erased(fp, quarter)
    variant = rest ^ flips(quarter)[flip]
    order = np.argsort(variant, kind="stable")
    variant, fp, part, flip = variant[order], fp[order], part[order], flip[order]
    same = variant[1:] == variant[:-1]
    kept = np.zeros(len(fp), dtype=bool)
    kept[1:] |= same
    kept[:-1] |= same
    if not kept.any():
        return nothing
    variant, fp, part, flip = variant[kept], fp[kept], part[kept], flip[kept]
    group = np.zeros(len(fp), dtype=np.int64)
    group[1:] = np.cumsum(variant[1:] != variant[:-1])
    code = group << WIDTH | part.astype(np.int64)
    order = np.lexsort((fp, code))
    code, fp, flip = code[order], fp[order], flip[order]
    first = np.ones(len(code), dtype=bool)
    first[1:] = code[1:] != code[:-1]
    centre = np.flatnonzero(first)[np.cumsum(first) - 1]
    left, right = [fp[centre]], [fp]

    def meet(codes: np.ndarray, values: np.ndarray, masks: list[int]) -> None:
        for m in masks:
            place = np.searchsorted(codes, codes ^ m)
            place[place == len(codes)] = 0
            hit = codes[place] == codes ^ m
            left.append(values[hit])
            right.append(values[place[hit]])

    meet(code[first], fp[first], [1 << b for b in range(WIDTH)])
    bare = flip == 0
    codes, values = code[bare], fp[bare]
    crowd = np.zeros(len(codes), dtype=bool)
    next_to = codes[1:] >> WIDTH == codes[:-1] >> WIDTH
    crowd[1:] |= next_to
    crowd[:-1] |= next_to
    if crowd.any():
        meet(codes[crowd], values[crowd], [sum(1 << b for b in c) for c in combinations(range(WIDTH), RADIUS)])
    a, b = np.concatenate(left), np.concatenate(right)
    linked = (a < b) & (bit_count(a ^ b) <= RADIUS)
    pairs = np.unique(np.stack([a[linked], b[linked]]), axis=1)
    return pairs[0], pairs[1]


def ball_links(distinct: DataFrame, count: int) -> DataFrame:
    """Links ``a, b`` between the fingerprints in column ``fp`` that differ in ``RADIUS`` bits or fewer, enough of them for the components to be whole."""
    each = max(1, -(-count * (64 - WIDTH + 1) // BUCKET))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            buckets, blocks = [], []
            for quarter in range(QUARTERS):
                flip = flips(quarter)
                rest, _ = erased(fp, quarter)
                bucket = (mix64((rest[:, None] ^ flip).ravel()) % np.uint64(each)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(each + 1))
                owner, which = fp[order // len(flip)], (order % len(flip)).astype(np.uint8)
                for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                    lo, hi = edges[b], edges[b + 1]
                    buckets.append(quarter * each + b)
                    blocks.append(owner[lo:hi].tobytes() + which[lo:hi].tobytes())
            yield batch_of(bucket=(pa.int32(), buckets), block=(pa.binary(), blocks))

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        fp = np.concatenate([np.frombuffer(b, dtype=np.uint64, count=len(b) // 9) for b in blocks])
        flip = np.concatenate([np.frombuffer(b, dtype=np.uint8, offset=len(b) // 9 * 8) for b in blocks])
        a, b = bucket_links(fp, flip, key[0].as_py() // each)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return distinct.select("fp").mapInArrow(emit, "bucket int, block binary").groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` of every document."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    table = fingerprint_table(docs).checkpoint()
    distinct = table.groupBy("fp").agg(F.min("doc_id").alias("least")).checkpoint()
    links = ball_links(distinct, distinct.count())
    roots = components(links)
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classed = named.join(least, "root").select("fp", "component_id")
    return table.join(classed, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, the fingerprint in hex and the component of every document."""
    return classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the least ``doc_id``, with all its columns.

    Rows that share an id are one document, of which one row stays; rows
    without an id are one document for each text and come after all others.

    The ids that go and those of several rows are told apart first, without texts. If they are
    few enough to be broadcast, which their count tells, texts are not shuffled but for rows that share an id.
    """
    instead = F.lit(1 << 62) + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 61))
    own = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), instead).alias("id"))
    classed = classes(own.select(F.col("id").alias("doc_id"), "row.text"))
    told = classed.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count(F.lit(1)).alias("n"))
    told = told.where("n > 1 or not stays").select("id", "stays").checkpoint()
    some = told.count() <= SOME
    few = F.broadcast(told) if some else told
    plain = own.join(few, "id", "left_anti")
    several = own.join(few.where("stays"), "id", "left_semi").groupBy("id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return plain.select("row.*").unionByName(several.select("row.*"))
