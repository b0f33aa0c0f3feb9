"""Recall, final answers and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import valid_item_id


def recall_at(lists: DataFrame, answers: DataFrame, ks: list[int]) -> DataFrame:
    """``(k, recall, queries)``: the mean over queries with answers of the share of answers among the first ``k``."""
    gold = answers.where(F.size("answers") > 0).select("query_id", F.explode(F.array_distinct("answers")).alias("item_id"))
    hits = gold.join(lists.select("query_id", "item_id", "rank"), ["query_id", "item_id"], "left")
    each = hits.groupBy("query_id").agg(F.count("*").alias("n"), *[F.sum((F.coalesce("rank", F.lit(1 << 30)) < k).cast("int")).alias(f"h{k}") for k in ks])
    means = each.agg(F.count("*").alias("queries"), *[F.avg(F.col(f"h{k}") / F.col("n")).alias(f"m{k}") for k in ks])
    return means.select("queries", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"m{k}").alias("recall")) for k in ks])).alias("x")).select("x.k", F.round("x.recall", 6).alias("recall"), "queries")


def final_answers(scored: DataFrame, fallback: DataFrame, k: int = 50) -> DataFrame:
    """``(query_id, answer)``: the ``k`` best items joined by spaces, topped up from ``fallback(query_id, item_id, rank)`` without repeats."""
    own = scored.select("query_id", "item_id", F.lit(0).alias("tier"), F.negative("score").alias("at"))
    more = fallback.select("query_id", "item_id", F.lit(1).alias("tier"), F.col("rank").cast("double").alias("at"))
    best = own.unionByName(more).groupBy("query_id", "item_id").agg(F.min(F.struct("tier", "at")).alias("o"))
    spot = F.row_number().over(Window.partitionBy("query_id").orderBy("o.tier", "o.at", "item_id"))
    ranked = best.withColumn("r", spot).where(F.col("r") <= k)
    return ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("r", F.col("item_id").cast("string").alias("i")))).alias("x")).select("query_id", F.array_join(F.transform("x", lambda x: x["i"]), " ").alias("answer"))


def check_answers(answers: DataFrame, queries: DataFrame, items: DataFrame, k: int = 50, hex_ids: bool = True) -> DataFrame:
    """``(query_id, problem)`` for every rule that an answer breaks; empty if all are well formed."""
    ids = F.split("answer", " ")
    listed = answers.withColumn("ids", F.filter(ids, lambda x: x != ""))
    problems = [
        F.when(F.col("answer").rlike("  |^ | $"), "spacing"), F.when(F.size("ids") > k, "too many"),
        F.when(F.size("ids") != F.size(F.array_distinct("ids")), "repeated item"), F.when(F.size("ids") == 0, "empty"),
    ]
    if hex_ids:
        problems.append(F.when(F.exists("ids", lambda x: ~valid_item_id(x)), "malformed item"))
    rows = listed.select("query_id", F.explode(F.array_compact(F.array(*problems))).alias("problem"))
    one = answers.groupBy("query_id").agg(F.count("*").alias("n"))
    rows = rows.unionByName(one.where("n > 1").select("query_id", F.lit("repeated query").alias("problem")))
    rows = rows.unionByName(one.join(queries.select("query_id"), "query_id", "left_anti").select("query_id", F.lit("unknown query").alias("problem")))
    rows = rows.unionByName(queries.select("query_id").distinct().join(one, "query_id", "left_anti").select("query_id", F.lit("missing query").alias("problem")))
    known = items.select(F.col("item_id").cast("string").alias("i")).distinct()
    strange = listed.select("query_id", F.explode("ids").alias("i")).join(known, "i", "left_anti").select("query_id").distinct()
    return rows.unionByName(strange.select("query_id", F.lit("unknown item").alias("problem")))
