"""Queries of this subpackage's operators, by name, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, licenses, linededup, mixing, pii, quality, simhash, topk
from .common import batches_of, cut, table

RANK_FILE = "byte_bpe_50k.tiktoken"
#: Whole texts in an Arrow batch of the encoding.
BATCH_ROWS = 500


def tokenizer(ranks_path: str | None = None) -> tuple[dict[bytes, int], str]:
    """The ranks and the pattern of the public byte-level vocabulary; ``ranks_path`` or SONDERA_RANKS names another file."""
    import public_tokenizers

    path = ranks_path or os.environ.get("SONDERA_RANKS") or public_tokenizers.path(RANK_FILE)
    return bpe.read_ranks(path), public_tokenizers.PATTERN


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("__chunks_cut").cast("long").alias("chunks_cut"), F.col("__lines_cut").cast("long").alias("lines_cut"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0, 10)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = tokenizer()
    with batches_of(spark, BATCH_ROWS):  # the digests are small, so they are made here, where the batches are
        return cut(bpe.digests(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern), ranks))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.pii_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op7_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.ann_search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, 20)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return out.select("doc_id", "source", *[F.col(f"__{c}").alias(c) for c in ("block", "slot", "release", "deadline", "place")])


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"), table(spark, sf_dir, "labels"))
    scores = [F.col(f"__{c}").alias(c) for c in ("quality", "text_score", "page_score")]
    return out.select("doc_id", *scores, (F.col("__quality") >= quality.THRESHOLD).alias("keep"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (op1_line_dedup, op2_exact_top_k, op3_byte_bpe, op4_license_scan, op5_pii, op6_language_id, op7_simhash_near_duplicates, op8_ann_search, op9_source_mixing, op10_quality_classifier)
    return {f.__name__: f for f in (*operators, pipeline)}


def oracle_sql() -> dict[str, str]:
    top_k = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
    return {"op2_exact_top_k": top_k, "op4_license_scan": licenses.oracle(), "op9_source_mixing": mixing.oracle()}
