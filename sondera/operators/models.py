"""Learned parts: the class of a query's text and the ranker."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import prep
from .split import shuffled

LEFT_OUT = ("query_id", "item_id", "label")


def train_classifier(pairs: DataFrame, item_class: DataFrame, support: int = 20, grams: int = 20_000) -> PipelineModel:
    """P(class | text and filters) from words, marked filter words and character 2- to 4-grams.

    One row for each text, filters and class, weighing ln(1 + count); classes with fewer than ``support`` pairs are left out.
    """
    rows = pairs.join(item_class.where("microcat is not null"), "item_id").groupBy("qn", "filters", "microcat").agg(F.count("*").alias("n"))
    common = rows.groupBy("microcat").agg(F.sum("n").alias("s")).where(F.col("s") >= support).select("microcat")
    rows = features(rows.join(common, "microcat", "left_semi").withColumn("w", F.log1p(F.col("n").cast("double"))))
    stages = [
        StringIndexer(inputCol="microcat", outputCol="y", stringOrderType="alphabetAsc"),
        CountVectorizer(inputCol="words", outputCol="wc", minDF=2), IDF(inputCol="wc", outputCol="wx"),
        CountVectorizer(inputCol="chars", outputCol="cc", minDF=3, vocabSize=grams), IDF(inputCol="cc", outputCol="cx"),
        VectorAssembler(inputCols=["wx", "cx"], outputCol="x"),
        LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1e-3, maxIter=15),
    ]
    return Pipeline(stages=stages).fit(rows)


def features(texts: DataFrame) -> DataFrame:
    return texts.withColumn("words", T.classifier_words("qn", "filters")).withColumn("chars", T.char_ngrams(F.col("qn"), 2, 4))


def classify(model: PipelineModel, texts: DataFrame, key: str = "query_id") -> DataFrame:
    """``(key, microcat, p)`` for every class."""
    labels = F.array(*[F.lit(x) for x in model.stages[0].labels])
    p = model.transform(features(texts)).select(key, F.explode(F.arrays_zip(labels.alias("microcat"), vector_to_array("probability").alias("p"))).alias("x"))
    return p.select(key, "x.microcat", "x.p")


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in LEFT_OUT]


def train_ranker(table: DataFrame, seed: int = 42, rounds: int = 20) -> PipelineModel:
    """A pointwise gradient-boosted ranker on the groups that have a positive; a tenth of the queries, if that is any, decides when to stop."""
    good = table.groupBy("query_id").agg(F.max("label").alias("m")).where("m > 0").select("query_id")
    rows = table.join(good, "query_id", "left_semi").na.fill(-1.0)
    held = (F.pmod(shuffled(F.xxhash64("query_id") % 1000003, seed), F.lit(10)) == 0).alias("held")
    rows = prep.settled(rows.select("*", held))  # the trees read it many times
    columns = feature_columns(table)
    trees = GBTRegressor(featuresCol="__features", labelCol="label", maxIter=rounds, maxDepth=4, seed=seed)
    if not rows.where("held").isEmpty():  # a table of few queries may have none to decide by
        trees.setParams(validationIndicatorCol="held")
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="__features", handleInvalid="keep"), trees]).fit(rows)


def rank(model: PipelineModel, table: DataFrame) -> DataFrame:
    return model.transform(table.na.fill(-1.0)).select("query_id", "item_id", F.col("prediction").alias("score"))
