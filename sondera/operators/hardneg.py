"""Hard negatives for training an encoder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .split import shuffled


def positives(pairs: DataFrame, per_text: int, most: int, seed: int) -> DataFrame:
    """Up to ``per_text`` distinct chosen items of each text, in a seeded order, ``most`` rows in all."""
    one = pairs.groupBy("qn", "item_id").agg(F.min("row_id").alias("row_id"))
    place = F.row_number().over(Window.partitionBy("qn").orderBy(shuffled(F.col("row_id"), seed), "row_id"))
    kept = one.withColumn("p", place).where(F.col("p") <= per_text)
    return kept.orderBy(shuffled(F.col("row_id"), seed + 1), "row_id").limit(most).select("qn", "item_id", "row_id")


def negatives(positive: DataFrame, pairs: DataFrame, lists: DataFrame, items: DataFrame, take: int, seed: int, first: int = 30) -> DataFrame:
    """``(qn, item_id, neg, place)``: ``take`` negatives for each positive from the text's candidate ``lists(qn, item_id, rank)``.

    False negatives go: items chosen for the text, items with a positive's title, items of the positive's class. Of the ``first`` that
    remain, ``take`` are drawn in a seeded order.
    """
    chosen = pairs.select("qn", F.col("item_id").alias("neg")).distinct()
    info = items.select("item_id", "title", "microcat")
    titles = positive.select("qn", "item_id").join(info, "item_id").select("qn", "title").distinct()
    listed = lists.select("qn", F.col("item_id").alias("neg"), "rank").join(chosen, ["qn", "neg"], "left_anti")
    listed = listed.join(info.select(F.col("item_id").alias("neg"), "title", F.col("microcat").alias("neg_class")), "neg").join(titles, ["qn", "title"], "left_anti")
    own = positive.join(info.select("item_id", "microcat"), "item_id").join(listed.select("qn", "neg", "neg_class", "rank"), "qn").where("neg_class <> microcat")
    by = Window.partitionBy("qn", "item_id")
    own = own.withColumn("p", F.row_number().over(by.orderBy("rank", "neg"))).where(F.col("p") <= first)
    place = F.row_number().over(by.orderBy(shuffled(F.col("row_id") * 31 + F.col("p"), seed), "p"))
    return own.withColumn("place", place).where(F.col("place") <= take).select("qn", "item_id", "neg", "place")
