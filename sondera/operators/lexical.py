"""Fielded BM25 and character n-gram cosine as joins on terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

K1, B = 1.2, 0.75
FIELD_WEIGHTS = {"title": 1.0, "params": 0.5, "descr": 1.0}
DESC_WORDS = 300


def field_terms(items: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """``(item_id, field, term, tf, len)``: how often each term is in each field. A field's terms are an array column."""
    stacked = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), terms.alias("terms")) for name, terms in fields.items()])).alias("x")
    one = items.select("item_id", stacked).select("item_id", "x.field", "x.terms")
    flat = one.select("item_id", "field", F.size("terms").alias("len"), F.explode("terms").alias("term"))
    return flat.groupBy("item_id", "field", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def item_fields() -> dict[str, Column]:
    return {"title": T.lemma_tokens("title"), "params": T.lemma_tokens("params"), "descr": T.lemma_tokens("descr", DESC_WORDS)}


def postings(items: DataFrame, fields: dict[str, Column] | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """``(field, term, item_id, w)``: BM25 weight of each term in each field; the average length counts empty fields too."""
    fields = fields or item_fields()
    tf = field_terms(items, fields)
    lengths = items.select(*[F.size(terms).alias(name) for name, terms in fields.items()])
    sums = lengths.agg(F.count("*").alias("n"), *[F.sum(name).alias(name) for name in fields])
    stats = sums.select("n", F.explode(F.array(*[F.struct(F.lit(name).alias("field"), F.coalesce(F.col(name), F.lit(0)).alias("total")) for name in fields])).alias("x"))
    stats = stats.select("x.field", "n", F.when(F.col("x.total") > 0, F.col("x.total") / F.col("n")).otherwise(1.0).alias("avg"))  # a row for each field
    df = tf.groupBy("field", "term").agg(F.count("*").alias("df"))
    x = tf.join(df, ["field", "term"]).join(F.broadcast(stats), "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    return x.select("field", "term", "item_id", w.alias("w"))


def query_terms(queries: DataFrame, posted: DataFrame, forms: Column | None = None) -> DataFrame:
    """``(query_id, term, qw)``: each word weighs 1, shared by its distinct forms that are in the vocabulary; repeated words add.

    ``forms`` is an array of arrays, each word's forms; by default a word is its own form.
    """
    forms = forms if forms is not None else F.transform(T.lemma_tokens("text"), lambda w: F.array(w))
    words = queries.select("query_id", F.posexplode(forms).alias("pos", "forms"))
    flat = words.select("query_id", "pos", F.explode(F.array_distinct("forms")).alias("term"))
    known = flat.join(posted.select("term").distinct(), "term", "left_semi")
    each = known.withColumn("qw", 1.0 / F.count("*").over(Window.partitionBy("query_id", "pos")))
    return each.groupBy("query_id", "term").agg(F.sum("qw").alias("qw"))


def field_scores(terms: DataFrame, posted: DataFrame) -> DataFrame:
    """``(query_id, item_id, field, s)``: the part of the score that each field gives."""
    return terms.join(posted, "term").groupBy("query_id", "item_id", "field").agg(F.sum(F.col("qw") * F.col("w")).alias("s"))


def bm25_scores(terms: DataFrame, posted: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``(query_id, item_id, score)`` over the weighted fields, positive scores only."""
    weights = weights or FIELD_WEIGHTS
    weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(w)) for f, w in weights.items()], F.lit(0.0))
    # one row for each term and item first: fields meet before the join with the queries
    merged = posted.groupBy("term", "item_id").agg(F.sum(F.col("w") * weight).alias("w"))
    return terms.join(merged, "term").groupBy("query_id", "item_id").agg(F.round(F.sum(F.col("qw") * F.col("w")), 9).alias("score")).where("score > 0")


def char_weights(texts: DataFrame, key: str, low: int, high: int, min_df: int = 1, max_df: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Unit TF-IDF vectors ``(key, gram, x)`` of ``texts(key, text)``, and the vocabulary ``(gram, idf)``.

    Term frequency is 1 + ln tf, idf ln((1 + n) / (1 + df)) + 1; grams are those of at least ``min_df`` texts and at most a share
    ``max_df`` of them.
    """
    grams = texts.select(key, F.explode(T.char_ngrams(F.col("text"), low, high)).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))
    n = texts.agg(F.count("*").alias("n"))
    df = grams.groupBy("gram").agg(F.count("*").alias("df")).join(F.broadcast(n))  # one row
    vocabulary = df.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("n"))).select("gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    return unit_vectors(grams, vocabulary, key), vocabulary


def unit_vectors(grams: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    x = grams.join(vocabulary, "gram").select(key, "gram", ((1 + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("x"))
    norm = x.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return x.join(norm, key).select(key, "gram", (F.col("x") / F.col("norm")).alias("x"))


def char_query_vectors(queries: DataFrame, vocabulary: DataFrame, low: int, high: int) -> DataFrame:
    """Queries' vectors in the documents' vocabulary; grams outside it do not count for the length."""
    grams = queries.select("query_id", F.explode(T.char_ngrams(F.col("text"), low, high)).alias("gram")).groupBy("query_id", "gram").agg(F.count("*").alias("tf"))
    return unit_vectors(grams, vocabulary, "query_id")


def cosine(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """``(left_key, right_key, sim)`` of the pairs that share a gram."""
    both = left.select(left_key, "gram", F.col("x").alias("__a")).join(right.select(right_key, "gram", F.col("x").alias("__b")), "gram")
    return both.groupBy(left_key, right_key).agg(F.round(F.sum(F.col("__a") * F.col("__b")), 9).alias("sim"))
