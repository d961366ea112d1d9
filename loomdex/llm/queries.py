"""The queries opN_<name> on the data folder's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.sources import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdex.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdex.llm.substring_dedup import dedup_substrings

    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdex.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents")).drop("spans")


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdex.llm.token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdex.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdex.llm.ann import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdex.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdex.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdex.llm.sentencepiece_codec import round_trip

    return round_trip(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_xxhash64"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdex.llm.exact_dedup import duplicate_groups

    found = duplicate_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d)),
first AS (SELECT k, min(doc_id) AS m FROM g GROUP BY k),
gone AS (
  SELECT doc_id, list(DISTINCT i + j) AS gone FROM (SELECT doc_id, i, unnest(range(0, 13)) AS j FROM g JOIN first USING (k) WHERE m < doc_id)
  GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

OP10_SQL = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW same AS (PARTITION BY t)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash_near_dedup, op2_substring_dedup, op3_license_scan, op4_token_count, op5_source_mixing, op6_nearest_neighbours, op7_toxicity, op8_quality, op9_sentencepiece, op10_exact_dedup)
}

ORACLE_SQL: dict[str, str] = {"op2_substring_dedup": OP2_SQL, "op10_exact_dedup": OP10_SQL}
