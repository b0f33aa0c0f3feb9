"""Typed scans and sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(c: Column) -> Column:
    """NaN is a value in Spark; here it means unknown."""
    return F.when(~F.isnan(c), c)


def typed_scan(spark: SparkSession, path: str, columns: Iterable[str] | None = None, text: Iterable[str] = (), numeric: Iterable[str] = ()) -> DataFrame:
    """A column-pruned Parquet scan: decimals become doubles, NULL texts empty, numbers that cannot be read NULL."""
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    text, numeric = set(text), set(numeric)
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in numeric:
            c = nan_to_null(c.try_cast("double"))
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif f.name in text:
            c = F.coalesce(c.cast("string"), F.lit(""))
        out.append(c.alias(f.name))
    return df.select(*out)


def scan_ids(df: DataFrame, key: str, ids: DataFrame | list) -> DataFrame:
    """The rows whose ``key`` is listed: a pushed-down IN for a short list, a semi-join for a table."""
    return df.where(F.col(key).isin(ids)) if isinstance(ids, list) else df.join(ids.select(key).distinct(), key, "left_semi")


def save_candidates(lists: DataFrame, path: str, source: str, part: str) -> None:
    """Candidate lists ``(query_id, item_id, score, rank)`` in a table partitioned by part and source; one pair is replaced at a time."""
    out = lists.select("query_id", "item_id", F.col("score").cast("float"), F.col("rank").cast("int"), F.lit(part).alias("part"), F.lit(source).alias("source"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "source").parquet(path)


def load_candidates(spark: SparkSession, path: str, part: str, source: str | None = None) -> DataFrame:
    """Only the folders of ``part`` (and ``source``) are read."""
    df = spark.read.parquet(path).where(F.col("part") == part)
    return df.where(F.col("source") == source) if source else df


def save_class_probabilities(probabilities: DataFrame, path: str, part: str) -> None:
    """``(query_id, microcat, p)`` in a table partitioned by part; a part is replaced as a whole."""
    out = probabilities.select("query_id", "microcat", F.col("p").cast("float"), F.lit(part).alias("part"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def load_class_probabilities(spark: SparkSession, path: str, part: str) -> DataFrame:
    """``(query_id, microcat, p)`` of one part; only its folder is read."""
    return spark.read.parquet(path).where(F.col("part") == part).select("query_id", "microcat", "p")


def save_model(model: PipelineModel, path: str) -> None:
    """A fitted classifier or ranker; an older one at ``path`` is replaced."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_answer(answers: DataFrame, path: str) -> None:
    """``(query_id, answer)`` as CSV with a header."""
    answers.select("query_id", "answer").write.mode("overwrite").option("header", True).csv(path)


def read_answer(spark: SparkSession, path: str) -> DataFrame:
    """An answer file with every value a string and nothing taken for missing."""
    return spark.read.schema("query_id string, answer string").option("header", True).option("emptyValue", "").option("nullValue", "\u0000").csv(path)


def append_metrics(rows: DataFrame, path: str, key: list[str]) -> None:
    """Add the rows whose ``key`` is not there yet, so that a sweep can be taken up again."""
    spark = rows.sparkSession
    try:
        rows = rows.join(spark.read.parquet(path).select(*key), key, "left_anti")
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("append").parquet(path)


def update_cache(wanted: DataFrame, path: str, key: str, compute) -> DataFrame:  # noqa: ANN001
    """Rows of a keyed cache for ``wanted``; those not yet in it are computed and appended first."""
    spark = wanted.sparkSession
    try:
        known = spark.read.parquet(path)
        missing = wanted.join(known.select(key), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        missing = wanted
    compute(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(wanted.select(key).distinct(), key, "left_semi")


def cached_embeddings(texts: DataFrame, path: str, model: str, prefix: str, max_length: int, encode) -> DataFrame:  # noqa: ANN001
    """``(text, vector)`` of every different ``text`` that is not null; ``encode`` is called for those that are not yet in the cache.

    A vector belongs to a model, a prefix and a length as well as to its text, so changed settings never read another's vectors.
    ``encode`` takes ``(digest, text)``, whose text has the prefix before it, and gives ``(digest, vector)``.
    """
    digest = F.sha2(F.to_json(F.struct(F.lit(model), F.lit(prefix), F.lit(max_length), F.col("text"))), 256)
    wanted = texts.where("text is not null").select("text").distinct().withColumn("digest", digest)
    prefixed = wanted.select("digest", F.concat(F.lit(prefix), "text").alias("text"))
    vectors = update_cache(prefixed, path, "digest", encode)
    return wanted.join(vectors.select("digest", "vector"), "digest").select("text", "vector")
