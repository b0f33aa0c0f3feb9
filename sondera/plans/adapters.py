"""The search domain's tables from the driver's: as DataFrames and as SQL of the same meaning."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import prep

SERVICE = "114"
HELD_EVERY = 997
SERVICE_PART = "CASE WHEN p_size % 3 = 0 THEN '114' ELSE p_type END"
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of_parts(lines: DataFrame, part: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lines`` once for each part of their key, as their inner join has them, and ``part``; ``copy`` tells parts of one key apart.

    The lines stay where they are: only keys that have no part or several, none in a table whose keys are whole, are joined to them.
    """
    known = part.groupBy("p_partkey").agg(F.count("*").alias("n"))
    keys = lines.where("l_partkey is not null").select("l_partkey").distinct()
    odd = keys.join(known, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_partkey", F.coalesce("n", F.lit(0)).cast("int").alias("n")).where("n <> 1")
    odd = prep.settled(odd)
    lines = lines.where("l_partkey is not null")
    if odd.isEmpty():
        return lines.withColumn("copy", F.lit(1)), part.withColumn("copy", F.lit(1))
    lines = lines.join(odd, "l_partkey", "left").where("coalesce(n, 1) > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(1))))).drop("n")
    return lines, part.withColumn("copy", F.row_number().over(Window.partitionBy("p_partkey").orderBy("qn", "cat")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The click log: row_id, qn, loc, delivery, filters, cat, item_id.

    The lines, the largest table, are shuffled whole once, by blocks of orders, for their orders and their numbers. What is left of them
    meets the parts' texts after that, so the two shuffles never lie on disk together; of many lines, each is done in passes.
    """
    r = lambda name: read(spark, sf_dir, name)
    part = r("part").select("p_partkey", T.normalize("p_name").alias("qn"), F.expr(SERVICE_PART).alias("cat"))
    lines, part = _of_parts(r("lineitem").select(*ORDER), part)
    places = r("customer").join(F.broadcast(r("nation").select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_regionkey", "c_mktsegment")
    block = F.floor(F.col("l_orderkey") / 50_000)
    orders = r("orders").select("o_orderkey", "o_custkey").join(places, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
    orders = orders.withColumnRenamed("o_orderkey", "l_orderkey").withColumn("block", block)
    lines = lines.withColumn("block", block)

    def placed(one: Column) -> DataFrame:
        x = lines.where(one).repartition("block").join(orders.where(one).repartition("block"), ["block", "l_orderkey"])
        return x.select(
            *ORDER, "copy", "block",
            F.when(F.col("l_linenumber") % 4 == 0, 1000 + F.col("n_regionkey")).otherwise(F.col("c_nationkey")).cast("int").alias("loc"),
            (F.col("l_linenumber") % 2).cast("int").alias("delivery"),
            F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("filters"),
            F.col("l_partkey").alias("item_id"),
        )

    with prep.setting(spark, prep.ALL_KEYS, "false"):
        first, *more = map(placed, prep.passes(lines, "block"))
        numbered = prep.dense_ids(first, [*ORDER, "copy"], F.col("block"), "row_id", ["loc", "delivery", "filters", "item_id", "copy"], tuple(more))
    numbered, part = numbered.withColumn("row_id", F.col("row_id").cast("long")), part.withColumnRenamed("p_partkey", "item_id")
    columns = ["row_id", "qn", "loc", "delivery", "filters", "cat", "item_id"]
    log = prep.settled(*[numbered.where(one).join(part.where(one), ["item_id", "copy"]).select(*columns) for one in prep.passes(numbered, "item_id")])
    prep.release(numbered)
    return log


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    loc = F.col("p_partkey") % 25
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), loc.cast("int").alias("loc"), F.col("p_brand").alias("microcat"), F.expr(SERVICE_PART).alias("category"),
        (40 + 0.5 * loc).alias("lat"), (10 + 0.3 * loc).alias("lon"), F.when(F.col("p_size") % 7 != 0, (F.col("p_size") % 6).cast("double")).alias("rating"),
        F.col("p_size").alias("reviews"), F.col("p_retailprice").alias("price"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_brand", "p_type").alias("params"),
        F.concat_ws(" ", "p_name", "p_type").alias("descr"), (F.col("p_size") % 2).alias("phone_hidden"), (F.col("p_size") % 5 == 0).cast("int").alias("msg_forbidden"),
    )


def past(log: DataFrame) -> DataFrame:
    return log.where(F.col("row_id") % HELD_EVERY != 0)


def asked(log: DataFrame) -> DataFrame:
    """Every HELD_EVERY-th row of the log as a query, with the item it chose."""
    return log.where(F.col("row_id") % HELD_EVERY == 0).select(F.col("row_id").alias("query_id"), "qn", F.col("qn").alias("text"), "loc", "cat", "filters", "item_id")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items with long descriptions."""
    loc = F.col("doc_id") % 25
    words = F.split("text", r"\s+")
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), loc.cast("int").alias("loc"), F.when(F.col("lang") == "en", SERVICE).otherwise(F.col("lang")).alias("category"), (40 + 0.5 * loc).alias("lat"),
        (10 + 0.3 * loc).alias("lon"), F.array_join(F.slice(words, 1, 8), " ").alias("title"), F.col("source").alias("params"), F.col("text").alias("descr"),
    )


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts, cut to their first six words, as queries."""
    q = F.array_join(F.slice(T.tokenize("text"), 1, 6), " ")
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), q.alias("text"), (F.col("item_id") % 25).cast("int").alias("loc"), F.when(F.col("item_id") % 2 == 0, SERVICE).otherwise("any").alias("cat"))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries (every fiftieth vector) and items of the embedding table."""
    x = read(spark, sf_dir, "embeddings")
    cat = F.when(F.col("label") % 2 == 0, SERVICE).otherwise("any")
    q = x.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.floor(F.col("vec_id") / 50 % 25).cast("int").alias("loc"), cat.alias("cat"), F.col("embedding").alias("v"))
    loc = F.col("vec_id") % 25
    i = x.where("vec_id % 50 <> 0").select(F.col("vec_id").alias("item_id"), loc.cast("int").alias("loc"), cat.alias("category"), (40 + 0.5 * loc).alias("lat"), (10 + 0.3 * loc).alias("lon"), F.col("embedding").alias("v"))
    return q, i


def no_zone(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "loc int, item_loc int")


# ---- the same in SQL ----

_NORM = "trim(regexp_replace(lower({}), '[^0-9a-zа-я]+', ' ', 'g'))"
_TOKENS = "list_filter(string_split(" + _NORM + ", ' '), lambda w: w <> '')"
NORM, TOKENS = _NORM.format, _TOKENS.format

VIEWS: dict[str, str] = {
    "pairs": f"""SELECT CAST(row_number() OVER (ORDER BY {', '.join(ORDER)}) - 1 AS BIGINT) AS row_id, {NORM('p_name')} AS qn,
  CAST(CASE WHEN l_linenumber % 4 = 0 THEN 1000 + n_regionkey ELSE c_nationkey END AS INTEGER) AS loc, CAST(l_linenumber % 2 AS INTEGER) AS delivery,
  CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS filters, {SERVICE_PART} AS cat, l_partkey AS item_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey""",
    "items": f"""SELECT p_partkey AS item_id, CAST(p_partkey % 25 AS INTEGER) AS loc, p_brand AS microcat, {SERVICE_PART} AS category, CAST(40 + 0.5 * (p_partkey % 25) AS DOUBLE) AS lat,
  CAST(10 + 0.3 * (p_partkey % 25) AS DOUBLE) AS lon, CASE WHEN p_size % 7 <> 0 THEN CAST(p_size % 6 AS DOUBLE) END AS rating, p_size AS reviews, p_retailprice AS price, p_name AS title,
  p_brand || ' ' || p_type AS params, p_name || ' ' || p_type AS descr, p_size % 2 AS phone_hidden, CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS msg_forbidden FROM part""",
    "past": f"SELECT * FROM pairs WHERE row_id % {HELD_EVERY} <> 0",
    "asked": f"SELECT row_id AS query_id, qn, qn AS text, loc, cat, filters, item_id FROM pairs WHERE row_id % {HELD_EVERY} = 0",
    "regions": "SELECT DISTINCT loc FROM past WHERE loc NOT IN (SELECT loc FROM items)",
    "zone_counts": "SELECT p.loc, i.loc AS item_loc, count(*) AS n FROM past p JOIN regions USING (loc) JOIN items i ON p.item_id = i.item_id GROUP BY ALL",
    "zone": """SELECT loc, item_loc FROM (SELECT loc, item_loc, coalesce(sum(n) OVER (PARTITION BY loc ORDER BY n DESC, item_loc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(n) OVER (PARTITION BY loc) AS total FROM zone_counts) WHERE before < 0.9 * total""",
    "local": """SELECT query_id, item_loc FROM asked JOIN zone USING (loc) UNION ALL SELECT query_id, loc AS item_loc FROM asked WHERE loc NOT IN (SELECT loc FROM zone)""",
    "popular": "SELECT item_id, count(*) AS chosen FROM past GROUP BY 1",
    "centroids": """SELECT loc, median(lat) AS lat, median(lon) AS lon FROM items GROUP BY 1 UNION ALL
  SELECT p.loc, median(lat) AS lat, median(lon) AS lon FROM past p JOIN regions r ON p.loc = r.loc JOIN items i ON p.item_id = i.item_id GROUP BY 1""",
    "corpus": """SELECT doc_id AS item_id, CAST(doc_id % 25 AS INTEGER) AS loc, CASE WHEN lang = 'en' THEN '114' ELSE lang END AS category, CAST(40 + 0.5 * (doc_id % 25) AS DOUBLE) AS lat,
  CAST(10 + 0.3 * (doc_id % 25) AS DOUBLE) AS lon, array_to_string(list_slice(string_split_regex(text, '\\s+'), 1, 8), ' ') AS title, source AS params, text AS descr FROM documents""",
    "bq": f"""SELECT item_id AS query_id, array_to_string(list_slice({TOKENS('text')}, 1, 6), ' ') AS text, CAST(item_id % 25 AS INTEGER) AS loc,
  CASE WHEN item_id % 2 = 0 THEN '114' ELSE 'any' END AS cat FROM benchmark""",
    "field_rows": f"""SELECT item_id, 'title' AS field, 1.0 AS fw, {TOKENS('title')} AS terms FROM corpus UNION ALL SELECT item_id, 'params', 0.5, {TOKENS('params')} FROM corpus
  UNION ALL SELECT item_id, 'descr', 1.0, list_slice({TOKENS('descr')}, 1, 300) FROM corpus""",
    "field_stats": "SELECT field, count(*) AS n, CASE WHEN sum(len(terms)) > 0 THEN sum(len(terms)) / count(*) ELSE 1.0 END AS avg FROM field_rows GROUP BY 1",
    "tf": "SELECT item_id, field, any_value(fw) AS fw, term, count(*) AS tf, any_value(l) AS l FROM (SELECT item_id, field, fw, len(terms) AS l, unnest(terms) AS term FROM field_rows) GROUP BY item_id, field, term",
    "postings": """SELECT field, term, item_id, fw, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avg)) AS w
  FROM (SELECT *, count(*) OVER (PARTITION BY field, term) AS df FROM tf) JOIN field_stats USING (field)""",
    "bq_terms": f"""SELECT query_id, term, CAST(count(*) AS DOUBLE) AS qw FROM (SELECT query_id, unnest({TOKENS('text')}) AS term FROM bq) WHERE term IN (SELECT term FROM postings) GROUP BY ALL""",
    "bm25": "SELECT query_id, item_id, round(sum(qw * w * fw), 9) AS score FROM bq_terms JOIN postings USING (term) GROUP BY ALL HAVING round(sum(qw * w * fw), 9) > 0",
    "bm25_placed": """SELECT s.query_id, s.item_id, score, q.loc = c.loc AS local, c.loc AS item_loc FROM bm25 s JOIN bq q USING (query_id) JOIN corpus c USING (item_id) WHERE q.cat <> '114' OR c.category = '114'""",
    "vq": "SELECT vec_id AS query_id, CAST(floor(vec_id / 50 % 25) AS INTEGER) AS loc, CASE WHEN label % 2 = 0 THEN '114' ELSE 'any' END AS cat, embedding AS v FROM embeddings WHERE vec_id % 50 = 0",
    "vi": """SELECT vec_id AS item_id, CAST(vec_id % 25 AS INTEGER) AS loc, CASE WHEN label % 2 = 0 THEN '114' ELSE 'any' END AS category, CAST(40 + 0.5 * (vec_id % 25) AS DOUBLE) AS lat,
  CAST(10 + 0.3 * (vec_id % 25) AS DOUBLE) AS lon, embedding AS v FROM embeddings WHERE vec_id % 50 <> 0""",
    "dense": """SELECT query_id, item_id, round(list_sum(list_transform(list_zip(q.v, i.v), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 9) AS score, q.loc = i.loc AS local
  FROM vq q JOIN vi i ON q.cat <> '114' OR i.category = '114'""",
}
_NEEDS: dict[str, list[str]] = {}


def _named(body: str, own: str | None = None) -> list[str]:
    """The views that ``body`` reads: their names after FROM, JOIN or a comma."""
    found = set(re.findall(r"(?:FROM|JOIN)\s+(\w+)", body))
    return [n for n in VIEWS if n in found and n != own]


def refresh() -> None:
    """Find again which views need which, after views were added."""
    _NEEDS.update({name: _named(body, name) for name, body in VIEWS.items()})


refresh()


def sql(final: str) -> str:
    """``final`` with the views that it needs before it."""
    wanted: list[str] = []

    def add(names: list[str]) -> None:
        for name in names:
            if name not in wanted:
                add(_NEEDS[name])
                wanted.append(name)

    add(_named(final))
    return ("WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted) + "\n" if wanted else "") + final
