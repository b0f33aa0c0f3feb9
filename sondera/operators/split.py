"""A hold-out that looks like the benchmark: cells, quotas, picks and the rows that may inform them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FULL, TEXT_LOC, TEXT, UNSEEN = "3_full", "2_text_loc", "1_text", "0_unseen"
CELL = ["status", "has_params", "region"]


def shuffled(c: Column, seed: int) -> Column:
    """A place in a seeded order that any SQL engine computes alike."""
    return (c * 7919 + seed * 104729) % 1000003


def statuses(queries: DataFrame, seen: DataFrame, key: list[str], text: str = "qn", loc: str = "loc") -> DataFrame:
    """``queries`` with ``status``: whether the whole key, text and location, the text or nothing of it is in ``seen``."""
    def flag(cols: list[str], name: str) -> DataFrame:
        return seen.select(*cols).distinct().withColumn(name, F.lit(True))

    out = queries.join(flag(key, "__f"), key, "left").join(flag([text, loc], "__tl"), [text, loc], "left").join(flag([text], "__t"), [text], "left")
    status = F.when(F.col("__f"), FULL).when(F.col("__tl"), TEXT_LOC).when(F.col("__t"), TEXT).otherwise(UNSEEN)
    return out.withColumn("status", status).drop("__f", "__tl", "__t")


def cell_shares(queries: DataFrame) -> DataFrame:
    """``(status, has_params, region, n, share)`` of ``queries``."""
    counts = queries.groupBy(*CELL).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # a row for each of sixteen cells


def allocate(cells: DataFrame, total: int) -> DataFrame:
    """``cells`` with ``quota``: shares of ``total`` rounded down, the rest to the largest remainders; quotas sum to ``total``."""
    raw = F.round(F.col("share") * total, 9)
    x = cells.withColumn("__base", F.floor(raw)).withColumn("__rest", F.round(raw - F.floor(raw), 9))
    all_cells = Window.partitionBy(F.lit(0))
    left = F.lit(total) - F.sum("__base").over(all_cells)
    place = F.row_number().over(all_cells.orderBy(F.desc("__rest"), *CELL))
    return x.withColumn("__left", left).withColumn("__place", place).withColumn("quota", (F.col("__base") + (F.col("__place") <= F.col("__left")).cast("int")).cast("long")).drop("__base", "__rest", "__left", "__place")


def one_query_a_text(queries: DataFrame, seed: int) -> DataFrame:
    """One query for each text, the first in the seeded order."""
    place = F.row_number().over(Window.partitionBy("qn").orderBy(shuffled(F.col("qid"), seed), "qid"))
    return queries.withColumn("__p", place).where("__p = 1").drop("__p")


def stratified_pick(candidates: DataFrame, cells: DataFrame, seed: int) -> DataFrame:
    """Picked queries with their target ``cell_status`` and ``row_split``.

    ``candidates``: qid, n rows, status (without its own rows), has_params, region. ``cells``: the cells with quotas. First the cells of
    status 3_full take candidates that have that status or at least two rows, whose rows are then split; the other cells take
    the rest by their own status. A candidate fits one cell in each pass, so a greedy walk is a rank within the cell.
    """
    quotas = cells.select(*CELL, "quota")
    spot = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(shuffled(F.col("qid"), seed), "qid"))
    side = ["has_params", "region"]
    full = candidates.where((F.col("status") == FULL) | (F.col("n") >= 2)).withColumn("__p", spot(side))
    first = full.join(quotas.where(F.col("status") == FULL).drop("status"), side).where(F.col("__p") <= F.col("quota"))
    first = first.withColumn("row_split", F.col("status") != FULL).withColumn("cell_status", F.lit(FULL)).drop("__p", "quota")
    rest = candidates.where(F.col("status") != FULL).join(first.select("qid"), "qid", "left_anti").withColumn("__p", spot(CELL))
    second = rest.join(quotas, CELL).where(F.col("__p") <= F.col("quota")).withColumn("row_split", F.lit(False)).withColumn("cell_status", F.col("status")).drop("__p", "quota")
    return first.unionByName(second)


def assign_rows(pairs: DataFrame, picked: DataFrame, part: str, seed: int) -> DataFrame:
    """``(row_id, qid, part)``: a picked query's rows go to ``part``; of a split query's a seeded half, at least one on each side."""
    own = pairs.select("row_id", "qid").join(picked.select("qid", "row_split"), "qid")
    coin = shuffled(F.col("row_id"), seed) % 2 == 0
    by = Window.partitionBy("qid")
    x = own.withColumn("__c", coin.cast("int")).withColumn("__n", F.count("*").over(by)).withColumn("__h", F.sum("__c").over(by))
    x = x.withColumn("__p", F.row_number().over(by.orderBy(shuffled(F.col("row_id"), seed + 1), "row_id")))
    held = F.when(~F.col("row_split"), True).when(F.col("__h") == 0, F.col("__p") == 1).when(F.col("__h") == F.col("__n"), F.col("__p") > 1).otherwise(F.col("__c") == 1)
    return x.select("row_id", "qid", F.when(held, F.lit(part)).otherwise(F.lit("base")).alias("part"))


def parts(pairs: DataFrame, assigned: DataFrame) -> DataFrame:
    """``(row_id, part)`` of every row; those not assigned are base."""
    held = assigned.where(F.col("part") != "base").select("row_id", "part")
    return pairs.select("row_id").join(held, "row_id", "left").withColumn("part", F.coalesce("part", F.lit("base")))


def answers(pairs: DataFrame, assigned: DataFrame) -> DataFrame:
    """``(part, qid, answers)``: the distinct items of a held-out query's rows, in order."""
    rows = pairs.select("row_id", "item_id").join(assigned.where(F.col("part") != "base"), "row_id")
    return rows.groupBy("part", "qid").agg(F.sort_array(F.collect_set("item_id")).alias("answers"))


def corpora(items: DataFrame, bench: DataFrame, held: DataFrame) -> DataFrame:
    """``(item_id, in_bench, in_val, in_rank)``: items of the benchmark or that a part's queries chose belong to the part's corpus."""
    flags = items.select("item_id").join(bench.select("item_id").distinct().withColumn("in_bench", F.lit(True)), "item_id", "left")
    picked = held.select("part", F.explode("answers").alias("item_id")).groupBy("item_id").agg(F.max(F.col("part") == "val").alias("v"), F.max(F.col("part") == "rank").alias("r"))
    no = F.lit(False)
    x = flags.join(picked, "item_id", "left").withColumn("in_bench", F.coalesce("in_bench", no))
    return x.select("item_id", "in_bench", (F.col("in_bench") | F.coalesce("v", no)).alias("in_val"), (F.col("in_bench") | F.coalesce("r", no)).alias("in_rank"))


def context_rows(pairs: DataFrame, part: DataFrame, for_part: str) -> DataFrame:
    """Rows that may inform a part: all for the benchmark, otherwise those of no held-out query's share."""
    return pairs if for_part == "bench" else pairs.join(part.where(F.col("part") == "base").select("row_id"), "row_id", "left_semi")


def eligible(items: DataFrame, required: dict[str, object]) -> DataFrame:
    """The items that have every required value; an item whose value is not known is not eligible."""
    for column, value in required.items():
        items = items.where(F.col(column) == F.lit(value))
    return items
