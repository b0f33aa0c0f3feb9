"""The corpus pipeline: quality, line dedup, near-dedup, mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.llm import bpe, linededup, mixing, neardup, quality
from sondera.llm.common import cut, give_back, shared_folder, table
from sondera.llm.queries import tokenizer


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def lean(stage: Stage) -> Stage:
    """``stage`` with what earlier ones left in the driver's memory given back before it begins, and what its own steps left before its rows are asked for."""

    @functools.wraps(stage)
    def run_it(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        out = stage(spark, docs, sf_dir)
        give_back(spark)
        return out

    return run_it


@lean
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of good quality reaches the threshold."""
    scored = quality.quality(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col("__quality") >= quality.THRESHOLD).select(*docs.columns)


@lean
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated chunks of lines; those of which nothing is left go, as all they held is elsewhere."""
    out = linededup.line_dedup(docs).where((F.col("__chunks_cut") == 0) | F.col("text").rlike(r"\S"))
    n_chars = F.when(F.col("__chunks_cut") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)


@lean
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each class of near-duplicates; documents without doc_id stay."""
    classes = neardup.near_duplicate_classes(docs.select("doc_id", "text"))
    gone = classes.where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@lean
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: files and the rows in them follow it."""
    return mixing.mixed_order(spark, docs)


@lean
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place in the mixture, its ids, how many, and the digests of the ids and of the bytes they decode to.

    The documents have no column for their place, so it is derived again from the same rows, and the output is in that order.
    """
    ranks, pattern = tokenizer()
    placed = mixing.mix(docs.select("doc_id", "text", "source")).select("doc_id", "text", F.col("__slot").alias("slot"), F.col("__place").alias("place"))
    placed = cut(placed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place"))
    encoded = bpe.encode(placed, ranks, pattern, keep=("doc_id", "slot", "place"), sampled=docs)  # keeps the rows' order
    return bpe.digests(encoded.withColumn("place", F.col("place").cast("int")), ranks, keep_ids=True, keep=("slot", "place"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", source_mixing),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: The classifier, the rolling hashes and the fingerprints are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written to the shared folder and read again; rows in the mixture's order."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs.orderBy("slot", "place")  # the reader packs files by size
