"""The registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, dedup_bytes, dedup_words, langid, matroska, packing, pii, secrets, simhash, tokencount
from .common import load


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(load(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(load(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes.repeats_digest(load(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words.repeats_digest(load(spark, sf_dir, "documents"))


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digest(load(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(load(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_pii, op2_language_id, op3_suffix_array_dedup, op4_simhash, op5_substring_dedup,
        op6_matroska, op7_decontamination, op8_packing, op9_secret_scan, op10_token_counts,
    )
    return {f.__name__: f for f in found}


#: The words of a text as the word operators see them, and its shingles, in DuckDB.
_WINDOWS = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM words WHERE len(w) >= 20
), windows AS (
  SELECT doc_id, s, md5(array_to_string(w[s : s + 19], ' ')) AS k FROM starts
), marked AS (
  SELECT doc_id, s, (doc_id, s) > min((doc_id, s)) OVER (PARTITION BY k) AS again FROM windows
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM marked WHERE again
), lost AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(coalesce(gone, []), i)), lambda i: w[i]), ' ')) AS kept_sha256
FROM words LEFT JOIN lost USING (doc_id)
"""

_LEAKS = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[^\x00-/:-@\[-`{-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[^\x00-/:-@\[-`{-\x7F]+') AS w FROM benchmark
), item_shingles AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS n, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT n FROM item_shingles
), doc_shingles AS (
  SELECT DISTINCT doc_id, n, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)
), sizes AS (
  SELECT item_id, count(*) AS n_item FROM item_shingles GROUP BY item_id
)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*)::DOUBLE / n_item AS containment
FROM doc_shingles JOIN item_shingles USING (n, k) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item - 1e-9
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_substring_dedup": _WINDOWS, "op7_decontamination": _LEAKS}
