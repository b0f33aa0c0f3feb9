"""Queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geo import haversine_km
from ..operators import candidates as C
from ..operators import context, evaluate, fusion, hardneg, lexical, models, prep, split
from ..sources import tables
from . import adapters as A
from .adapters import NORM, TOKENS, sql

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
SEED, KEY = 42, ["qn", "loc", "delivery", "filters", "cat"]
PICKS = 40


def query(body: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL if it can be said in SQL."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if body:
            _SQL[f.__name__] = sql(body)
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def long(c: str) -> Column:
    return F.col(c).cast("long").alias(c)


# ---- sources and preparation ----


@query("SELECT CAST(p_partkey AS VARCHAR) AS item_id, coalesce(p_name, '') AS title, coalesce(p_type, '') AS kind, p_retailprice AS price FROM part")
def typed_scan(spark: SparkSession, sf: str) -> DataFrame:
    x = tables.typed_scan(spark, f"{sf}/part.parquet", ["p_partkey", "p_name", "p_type", "p_retailprice"], ["p_name", "p_type"], ["p_retailprice"])
    return x.select(F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("title"), F.col("p_type").alias("kind"), F.col("p_retailprice").alias("price"))


@query("SELECT p_partkey AS item_id, p_name AS title FROM part WHERE p_partkey IN (1, 5, 17, 99, 1000)")
def pushed_id_scan(spark: SparkSession, sf: str) -> DataFrame:
    x = tables.scan_ids(A.read(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", [1, 5, 17, 99, 1000])
    return x.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))


@query("SELECT item_id, row_id, qn, loc FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY row_id) AS p FROM pairs) WHERE p = 1")
def first_wins_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return prep.first_wins(A.pairs(spark, sf), ["item_id"], ["row_id"]).select("item_id", "row_id", "qn", "loc")


@query("""SELECT qn, loc, delivery, filters, cat, first_row, CAST(row_number() OVER (ORDER BY first_row) - 1 AS BIGINT) AS qid
FROM (SELECT qn, loc, delivery, filters, cat, min(row_id) AS first_row FROM pairs GROUP BY ALL)""")
def composite_key_factorize(spark: SparkSession, sf: str) -> DataFrame:
    return prep.number_keys(A.pairs(spark, sf), KEY).select(*KEY, "first_row", long("qid"))


def _item_versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    own = A.items(spark, sf).select("item_id", "title", "price")
    return own.where("item_id % 3 = 0"), own.where("item_id % 2 = 0").withColumn("price", F.lit(0.0))


@query("""SELECT item_id, title, price, item_id % 2 = 0 AS in_train, true AS in_bench FROM items WHERE item_id % 3 = 0
UNION ALL SELECT item_id, title, 0.0, true, false FROM items WHERE item_id % 2 = 0 AND item_id % 3 <> 0""")
def merged_items(spark: SparkSession, sf: str) -> DataFrame:
    return prep.merge_items(*_item_versions(spark, sf)).select("item_id", "title", "price", "in_train", "in_bench")


_STATIC = f"""SELECT item_id, loc, microcat, category, lat, lon, rating, round(ln(1 + coalesce(reviews, 0)), 6) AS log_reviews, CASE WHEN rating IS NULL THEN 0 ELSE 1 END AS has_rating,
  round(ln(1 + greatest(price, 0)), 6) AS log_price, CASE WHEN price <= 1 THEN 1 ELSE 0 END AS price_is_1, round(ln(1 + greatest(price, 0)) - ln(1 + greatest(median(price) OVER (PARTITION BY loc, microcat), 0)), 6) AS price_rel_med,
  CAST(phone_hidden AS INTEGER) AS phone_hidden, msg_forbidden, len(string_split(title, ' ')) AS title_words, len(string_split(descr, ' ')) AS desc_words, len(string_split(params, ' ')) AS params_words,
  round(ln(count(*) OVER (PARTITION BY descr)), 6) AS desc_dup, round(ln(count(*) OVER (PARTITION BY {NORM('title')})), 6) AS title_dup, round(len(regexp_extract_all(descr, '[\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}]')) / (len(string_split(descr, ' ')) + 1), 6) AS emoji_share FROM items"""
_ROUNDED = ("log_reviews", "log_price", "price_rel_med", "desc_dup", "title_dup", "emoji_share")


def _static(spark: SparkSession, sf: str) -> DataFrame:
    x = prep.item_static(A.items(spark, sf))
    return x.withColumns({c: F.round(c, 6) for c in _ROUNDED})


@query(_STATIC)
def item_static(spark: SparkSession, sf: str) -> DataFrame:
    return _static(spark, sf)


@query("SELECT doc_id, round(ln(count(*) OVER (PARTITION BY text)), 6) AS text_dup FROM documents")
def dup_counts(spark: SparkSession, sf: str) -> DataFrame:
    x = prep.repeats(A.read(spark, sf, "documents").select("doc_id", "text"), F.col("text"), "text_dup")
    return x.select("doc_id", F.round("text_dup", 6).alias("text_dup"))


@query("SELECT item_id, round(ln(1 + price) - ln(1 + median(price) OVER (PARTITION BY loc, category)), 6) AS price_rel_med FROM items")
def price_rel_median(spark: SparkSession, sf: str) -> DataFrame:
    return prep.relative_price(A.items(spark, sf), "price", ["loc", "category"]).select("item_id", F.round("price_rel_med", 6).alias("price_rel_med"))


@query(f"SELECT doc_id, md5({NORM('text')}) AS norm_md5, CAST(len({NORM('text')}) AS BIGINT) AS norm_chars FROM documents")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    x = A.read(spark, sf, "documents").select("doc_id", T.normalize("text").alias("n"))
    return x.select("doc_id", F.md5(F.col("n").cast("binary")).alias("norm_md5"), F.length("n").cast("long").alias("norm_chars"))


@query(f"SELECT doc_id, CAST(len({TOKENS('text')}) AS BIGINT) AS tokens, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS words, len(regexp_extract_all(coalesce(text, ''), '[\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}]')) / (len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) + 1) AS emoji FROM documents")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    x = A.read(spark, sf, "documents")
    return x.select("doc_id", F.size(T.tokenize("text")).cast("long").alias("tokens"), T.word_count("text").cast("long").alias("words"), T.emoji_share("text").alias("emoji"))


# ---- context ----


def _context(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    log, items = A.pairs(spark, sf), A.items(spark, sf)
    before, queries_ = A.past(log), prep.settled(A.asked(log))
    regions = context.region_locations(before, items)
    zone = context.zones(before, items, regions)
    return {"log": log, "items": items, "past": before, "asked": queries_, "regions": regions, "zone": zone, "local": context.local_pairs(queries_, zone), "popular": context.popularity(before)}


@query("SELECT loc FROM regions")
def region_locations(spark: SparkSession, sf: str) -> DataFrame:
    return _context(spark, sf)["regions"]


@query("SELECT loc, item_loc FROM zone")
def zone_90(spark: SparkSession, sf: str) -> DataFrame:
    return _context(spark, sf)["zone"]


@query("SELECT loc, round(lat, 6) AS lat, round(lon, 6) AS lon FROM centroids")
def centroids(spark: SparkSession, sf: str) -> DataFrame:
    c = _context(spark, sf)
    return context.centroids(c["past"], c["items"], c["regions"]).select("loc", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("SELECT item_id, chosen FROM popular")
def popularity(spark: SparkSession, sf: str) -> DataFrame:
    return context.popularity(A.past(A.pairs(spark, sf)))


@query("""SELECT loc, item_loc, round((n + 0.1) / (sum(n) OVER (PARTITION BY loc) + 10), 9) AS p_loc
FROM (SELECT p.loc, i.loc AS item_loc, count(*) AS n FROM past p JOIN items i ON p.item_id = i.item_id GROUP BY ALL)""")
def p_loc(spark: SparkSession, sf: str) -> DataFrame:
    return context.location_probability(A.past(A.pairs(spark, sf)), A.items(spark, sf)).select("loc", "item_loc", F.round("p_loc", 9).alias("p_loc"))


@query("SELECT query_id, CAST(item_loc AS INTEGER) AS item_loc FROM local")
def local_zone(spark: SparkSession, sf: str) -> DataFrame:
    return _context(spark, sf)["local"]


# ---- hold-out ----

# the log by key; keys that first appear on a multiple of seven stand for the benchmark
A.VIEWS |= {
    "qids": "SELECT *, CAST(row_number() OVER (ORDER BY first_row) - 1 AS BIGINT) AS qid FROM (SELECT qn, loc, delivery, filters, cat, min(row_id) AS first_row, count(*) AS n FROM pairs GROUP BY ALL)",
    "flags": """SELECT q.*, CASE WHEN filters = '' THEN 0 ELSE 1 END AS has_params, CASE WHEN loc >= 1000 THEN 1 ELSE 0 END AS region FROM qids q""",
    "base_q": "SELECT * FROM flags WHERE first_row % 7 <> 0",
    "bench_q": """SELECT b.*, CASE WHEN EXISTS (SELECT 1 FROM base_q s WHERE s.qn = b.qn AND s.loc = b.loc AND s.delivery = b.delivery AND s.filters = b.filters AND s.cat = b.cat) THEN '3_full'
  WHEN EXISTS (SELECT 1 FROM base_q s WHERE s.qn = b.qn AND s.loc = b.loc) THEN '2_text_loc' WHEN EXISTS (SELECT 1 FROM base_q s WHERE s.qn = b.qn) THEN '1_text' ELSE '0_unseen' END AS status FROM flags b WHERE first_row % 7 = 0""",
    "cells": "SELECT *, n / sum(n) OVER () AS share FROM (SELECT status, has_params, region, count(*) AS n FROM bench_q GROUP BY status, has_params, region)",
    "quotas": """SELECT status, has_params, region, n, share, CAST(base + CASE WHEN row_number() OVER (ORDER BY rest DESC, status, has_params, region) <= 40 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota
  FROM (SELECT *, floor(round(share * 40, 9)) AS base, round(round(share * 40, 9) - floor(round(share * 40, 9)), 9) AS rest FROM cells)""",
    "cand_all": """SELECT qid, qn, n, has_params, region, CASE WHEN qid % 5 = 0 THEN '3_full' WHEN EXISTS (SELECT 1 FROM base_q s WHERE s.qn = f.qn AND s.loc = f.loc AND s.qid <> f.qid) THEN '2_text_loc' ELSE '1_text' END AS status FROM base_q f""",
    "cand": "SELECT * FROM cand_all",
    "pass1": """SELECT c.qid, c.status, c.has_params, c.region, c.n, status <> '3_full' AS row_split, '3_full' AS cell_status FROM (SELECT *, row_number() OVER (PARTITION BY has_params, region ORDER BY (qid * 7919 + 42 * 104729) % 1000003, qid) AS p
  FROM cand WHERE status = '3_full' OR n >= 2) c JOIN (SELECT has_params, region, quota FROM quotas WHERE status = '3_full') q USING (has_params, region) WHERE p <= quota""",
    "pass2": """SELECT c.qid, c.status, c.has_params, c.region, c.n, false AS row_split, c.status AS cell_status FROM (SELECT *, row_number() OVER (PARTITION BY status, has_params, region ORDER BY (qid * 7919 + 42 * 104729) % 1000003, qid) AS p
  FROM cand WHERE status <> '3_full' AND qid NOT IN (SELECT qid FROM pass1)) c JOIN quotas q USING (status, has_params, region) WHERE p <= quota""",
    "picked": "SELECT * FROM pass1 UNION ALL SELECT * FROM pass2",
    "assigned": """SELECT row_id, qid, CASE WHEN NOT row_split THEN 'val' WHEN h = 0 THEN CASE WHEN p = 1 THEN 'val' ELSE 'base' END WHEN h = m THEN CASE WHEN p > 1 THEN 'val' ELSE 'base' END WHEN c = 1 THEN 'val' ELSE 'base' END AS part
  FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS m, sum(c) OVER (PARTITION BY qid) AS h, row_number() OVER (PARTITION BY qid ORDER BY (row_id * 7919 + 43 * 104729) % 1000003, row_id) AS p
  FROM (SELECT row_id, qid, row_split, CASE WHEN (row_id * 7919 + 42 * 104729) % 1000003 % 2 = 0 THEN 1 ELSE 0 END AS c FROM pairs JOIN qids USING (qn, loc, delivery, filters, cat) JOIN picked USING (qid)))""",
    "held": "SELECT 'val' AS part, qid, list_sort(list(DISTINCT item_id)) AS answers FROM assigned JOIN pairs USING (row_id) WHERE part = 'val' GROUP BY qid",
}
A.refresh()


def _numbered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    log = A.pairs(spark, sf)
    keys = prep.number_keys(log, KEY)
    counts = log.groupBy(*KEY).agg(F.count("*").alias("n"))
    flags = keys.join(counts, KEY).withColumn("has_params", (F.col("filters") != "").cast("int")).withColumn("region", (F.col("loc") >= 1000).cast("int"))
    return log, prep.settled(flags)


def _bench_cells(flags: DataFrame) -> DataFrame:
    return split.cell_shares(split.statuses(flags.where("first_row % 7 = 0"), flags.where("first_row % 7 <> 0"), KEY))


def _picked(flags: DataFrame) -> DataFrame:
    base = flags.where("first_row % 7 <> 0")
    # a key's own row does not count as seen: more than one key must have its text and place
    more = base.groupBy("qn", "loc").agg(F.count("*").alias("same"))
    status = F.when(F.col("qid") % 5 == 0, split.FULL).when(F.col("same") > 1, split.TEXT_LOC).otherwise(split.TEXT)
    cand = base.join(more, ["qn", "loc"]).select("qid", "n", status.alias("status"), "has_params", "region")
    return split.stratified_pick(cand, split.allocate(_bench_cells(flags), PICKS), SEED)


def _assigned(log: DataFrame, flags: DataFrame) -> DataFrame:
    return split.assign_rows(log.join(flags.select(*KEY, "qid"), KEY), _picked(flags), "val", SEED)


@query("SELECT status, has_params, region, n, round(share, 9) AS share FROM cells")
def bench_cell_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _bench_cells(_numbered(spark, sf)[1]).withColumn("share", F.round("share", 9))


@query("SELECT status, has_params, region, quota FROM quotas")
def largest_remainder(spark: SparkSession, sf: str) -> DataFrame:
    return split.allocate(_bench_cells(_numbered(spark, sf)[1]), PICKS).select(*split.CELL, "quota")


@query("SELECT qid, cell_status, has_params, region, row_split FROM picked")
def stratified_pick(spark: SparkSession, sf: str) -> DataFrame:
    return _picked(_numbered(spark, sf)[1]).select(long("qid"), "cell_status", "has_params", "region", "row_split")


@query("SELECT qid, qn FROM (SELECT *, row_number() OVER (PARTITION BY qn ORDER BY (qid * 7919 + 42 * 104729) % 1000003, qid) AS p FROM qids) WHERE p = 1")
def one_query_a_text(spark: SparkSession, sf: str) -> DataFrame:
    return split.one_query_a_text(_numbered(spark, sf)[1], SEED).select(long("qid"), "qn")


@query("SELECT row_id, qid, part FROM assigned")
def row_split(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(*_numbered(spark, sf)).select("row_id", long("qid"), "part")


@query("SELECT part, count(*) AS n FROM (SELECT p.row_id, coalesce(a.part, 'base') AS part FROM pairs p LEFT JOIN (SELECT * FROM assigned WHERE part <> 'base') a USING (row_id)) GROUP BY 1")
def split_parts(spark: SparkSession, sf: str) -> DataFrame:
    log, flags = _numbered(spark, sf)
    return split.parts(log, _assigned(log, flags)).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT qid, array_to_string(answers, ' ') AS answers, CAST(len(answers) AS INTEGER) AS n FROM held")
def held_answers(spark: SparkSession, sf: str) -> DataFrame:
    log, flags = _numbered(spark, sf)
    return split.answers(log, _assigned(log, flags)).select(long("qid"), F.array_join(F.col("answers").cast("array<string>"), " ").alias("answers"), F.size("answers").alias("n"))


@query("""SELECT i.item_id, i.item_id % 3 = 0 AS in_bench, i.item_id % 3 = 0 OR i.item_id IN (SELECT unnest(answers) FROM held) AS in_val, i.item_id % 3 = 0 AS in_rank FROM items i""")
def corpora_flags(spark: SparkSession, sf: str) -> DataFrame:
    log, flags = _numbered(spark, sf)
    items = A.items(spark, sf)
    return split.corpora(items, items.where("item_id % 3 = 0"), split.answers(log, _assigned(log, flags)))


@query("SELECT count(*) AS n, count(DISTINCT item_id) AS items FROM pairs WHERE row_id NOT IN (SELECT row_id FROM assigned WHERE part <> 'base')")
def leak_free_context(spark: SparkSession, sf: str) -> DataFrame:
    log, flags = _numbered(spark, sf)
    return split.context_rows(log, split.parts(log, _assigned(log, flags)), "val").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("items"))


# ---- lexical candidates ----


def _bm25(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    items, q = A.corpus(spark, sf), A.text_queries(spark, sf)
    posted = lexical.postings(items)
    return items, q, posted, lexical.query_terms(q, posted)


def _own_place(spark: SparkSession, q: DataFrame) -> DataFrame:
    return context.local_pairs(q, A.no_zone(spark))


def _rounded(x: DataFrame, digits: int = 9) -> DataFrame:
    return x.withColumn("score", F.round(F.col("score").cast("double"), digits))


def _top(source: str, depth: int, order: str = "score DESC, item_id", digits: int = 9) -> str:
    return f"""SELECT query_id, item_id, round(CAST(score AS DOUBLE), {digits}) AS score, CAST(rank - 1 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM {source} ) WHERE rank <= {depth}"""


@query("SELECT field, term, item_id, round(w, 6) AS w FROM postings")
def bm25_postings(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.postings(A.corpus(spark, sf)).withColumn("w", F.round("w", 6))


@query("SELECT query_id, term, round(qw, 6) AS qw FROM bq_terms")
def bm25_query_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf)[3].withColumn("qw", F.round("qw", 6))


def _bm25_list(spark: SparkSession, sf: str, depth: int, local_first: bool, alpha: float | None = None) -> DataFrame:
    items, q, posted, terms = _bm25(spark, sf)
    return C.lexical_candidates(lexical.bm25_scores(terms, posted), q, items, _own_place(spark, q), depth, local_first, alpha)


@query(_top("bm25_placed", 300))
def bm25_global(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_bm25_list(spark, sf, 300, False))


@query(_top("bm25_placed", 1000, "local DESC, score DESC, item_id"))
def bm25_local(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_bm25_list(spark, sf, 1000, True))


@query(_top("bm25_placed", 100, "score * (1 + 0.5 * CAST(local AS INTEGER)) DESC, item_id"))
def bm25_boosted(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_bm25_list(spark, sf, 100, False, 0.5))


_FILL = """SELECT query_id, item_id, CAST(tier AS INTEGER) AS tier, CAST(rank - 1 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, own, less, item_id) AS rank FROM (
  SELECT query_id, item_id, o.tier, o.own, o.less FROM (SELECT query_id, item_id, min({'tier': tier, 'own': own, 'less': less}) AS o FROM (
    SELECT query_id, item_id, 0 AS tier, rank AS own, 0 AS less FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM bm25_placed ) WHERE rank <= 20
    UNION ALL SELECT q.query_id, c.item_id, CASE WHEN q.loc = c.loc THEN 1 ELSE 2 END, 0, -(c.item_id % 10) FROM bq q JOIN corpus c ON q.cat <> '114' OR c.category = '114') GROUP BY ALL)))
  WHERE rank <= 50"""


@query(_FILL)
def bm25_fill_top50(spark: SparkSession, sf: str) -> DataFrame:
    items, q, posted, terms = _bm25(spark, sf)
    local = _own_place(spark, q)
    best = C.lexical_candidates(lexical.bm25_scores(terms, posted), q, items, local, 20, False)
    popular = items.select("item_id", (F.col("item_id") % 10).alias("chosen"))
    return C.fill(best, q, items, local, popular, 50)


# ---- behavioural candidates ----

_PLACED = """SELECT x.query_id, x.item_id, score, i.loc AS item_loc, l.item_loc IS NOT NULL AS local FROM ({}) x JOIN asked a ON a.query_id = x.query_id JOIN items i ON i.item_id = x.item_id
  LEFT JOIN local l ON l.query_id = x.query_id AND l.item_loc = i.loc WHERE a.cat <> '114' OR i.category = '114'"""
A.VIEWS |= {
    "memory_any_scored": _PLACED.format("SELECT a.query_id, p.item_id, count(*) AS score FROM asked a JOIN past p USING (qn) GROUP BY ALL"),
    "memory_loc_scored": _PLACED.format("SELECT a.query_id, p.item_id, count(*) AS score FROM asked a JOIN past p USING (qn, loc) GROUP BY ALL"),
}


def _grams(word: str, low: int, high: int) -> str:
    each = [f"CASE WHEN len({word}) + 2 >= {n} THEN list_transform(range(1, len({word}) + 4 - {n}), lambda i: substr(' ' || {word} || ' ', CAST(i AS BIGINT), {n})) ELSE [] END" for n in range(low, high + 1)]
    out = each[0]
    for e in each[1:]:
        out = f"list_concat({out}, {e})"
    return out


A.VIEWS |= {
    "grams_of": f"SELECT qn, g, count(*) AS tf FROM (SELECT qn, unnest({_grams('w', 2, 4)}) AS g FROM (SELECT qn, unnest(string_split(qn, ' ')) AS w FROM (SELECT DISTINCT qn FROM past))) GROUP BY ALL",
    "gram_vocab": "SELECT g, ln((1 + (SELECT count(DISTINCT qn) FROM past)) / (1 + count(*))) + 1 AS idf FROM grams_of GROUP BY g HAVING count(*) >= 2",
    "gram_unit": "SELECT qn, g, x / sqrt(sum(x * x) OVER (PARTITION BY qn)) AS x FROM (SELECT qn, g, (1 + ln(tf)) * idf AS x FROM grams_of JOIN gram_vocab USING (g))",
    "asked_grams": f"SELECT query_id, g, count(*) AS tf FROM (SELECT query_id, unnest({_grams('w', 2, 4)}) AS g FROM (SELECT query_id, unnest(string_split(qn, ' ')) AS w FROM asked)) GROUP BY ALL",
    "asked_unit": "SELECT query_id, g, x / sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS x FROM (SELECT query_id, g, (1 + ln(tf)) * idf AS x FROM asked_grams JOIN gram_vocab USING (g))",
    "neighbours": "SELECT query_id, qn, round(sum(a.x * b.x), 9) AS sim FROM asked_unit a JOIN gram_unit b USING (g) GROUP BY ALL",
    "similar_scored": _PLACED.format("SELECT query_id, item_id, round(sum(sim * n), 9) AS score FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, qn) AS r FROM neighbours WHERE sim > 0) WHERE r <= 30) JOIN (SELECT qn, item_id, count(*) AS n FROM past GROUP BY ALL) USING (qn) GROUP BY ALL"),
    "popular_scored": "SELECT l.query_id, i.item_id, chosen AS score FROM local l JOIN items i ON i.loc = l.item_loc JOIN asked a ON a.query_id = l.query_id JOIN popular p ON p.item_id = i.item_id WHERE a.cat <> '114' OR i.category = '114'",
    "class_n": "SELECT a.query_id, i.microcat, count(*) AS n FROM asked a JOIN past USING (qn) JOIN items i ON i.item_id = past.item_id GROUP BY a.query_id, i.microcat",
    "class_p": "SELECT query_id, microcat, n / sum(n) OVER (PARTITION BY query_id) AS p FROM class_n",
    "microcat_scored": """SELECT c.query_id, i.item_id, round(p * (1 + coalesce(chosen, 0) + 1e-3 * ln(1 + coalesce(reviews, 0))), 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, microcat) AS r FROM class_p ) c
  JOIN local l ON l.query_id = c.query_id JOIN items i ON i.loc = l.item_loc AND i.microcat = c.microcat JOIN asked a ON a.query_id = c.query_id LEFT JOIN popular p ON p.item_id = i.item_id WHERE r <= 3 AND (a.cat <> '114' OR i.category = '114')""".replace("round(p *", "round(c.p *").replace("LEFT JOIN popular p ON p.item_id", "LEFT JOIN popular pop ON pop.item_id"),
}
A.refresh()


@query(_top("memory_loc_scored", 300))
def memory_loc(spark: SparkSession, sf: str) -> DataFrame:
    c = _context(spark, sf)
    return _rounded(C.memory_same_place(c["past"], c["asked"], c["items"], 300))


@query(_top("memory_any_scored", 300, "local DESC, score DESC, item_id"))
def memory_any(spark: SparkSession, sf: str) -> DataFrame:
    c = _context(spark, sf)
    return _rounded(C.memory_anywhere(c["past"], c["asked"], c["items"], c["local"], 300))


def _neighbours(c: dict[str, DataFrame]) -> DataFrame:
    """``(text, qn, sim)`` of each different text that is asked."""
    texts = c["past"].select("qn", F.col("qn").alias("text")).distinct()
    known, vocabulary = lexical.char_weights(texts, "qn", 2, 4, min_df=2)
    asked = c["asked"].select(F.col("qn").alias("query_id"), F.col("qn").alias("text")).distinct()
    return lexical.cosine(lexical.char_query_vectors(asked, vocabulary, 2, 4), known, "query_id", "qn").withColumnRenamed("query_id", "text")


@query("SELECT query_id, qn, sim FROM neighbours")
def text_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    c = _context(spark, sf)
    return c["asked"].select("query_id", F.col("qn").alias("text")).join(_neighbours(c), "text").select("query_id", "qn", "sim")


@query(_top("similar_scored", 300, "local DESC, score DESC, item_id"))
def similar_queries(spark: SparkSession, sf: str) -> DataFrame:
    c, members = _once(_context(spark, sf))
    return fusion.spread(_rounded(C.similar_queries(prep.settled(_neighbours(c)), c["past"], c["asked"], c["items"], c["local"], 300)), members.select("like", "query_id"))


@query(f"SELECT item_id, g AS gram, count(*) AS tf FROM (SELECT item_id, unnest({_grams('w', 3, 5)}) AS g FROM (SELECT item_id, unnest({TOKENS('title')}) AS w FROM items)) GROUP BY ALL")
def char_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    x = A.items(spark, sf).select("item_id", F.explode(T.char_ngrams(T.normalize("title"), 3, 5)).alias("gram"))
    return x.groupBy("item_id", "gram").agg(F.count("*").alias("tf"))


A.VIEWS |= {
    "title_grams": f"SELECT item_id, g, count(*) AS tf FROM (SELECT item_id, unnest({_grams('w', 3, 5)}) AS g FROM (SELECT item_id, unnest({TOKENS('title')}) AS w FROM corpus)) GROUP BY ALL",
    "title_vocab": "SELECT g, ln((1 + (SELECT count(*) FROM corpus)) / (1 + count(*))) + 1 AS idf FROM title_grams GROUP BY g HAVING count(*) >= 2 AND count(*) <= 0.3 * (SELECT count(*) FROM corpus)",
    "title_unit": "SELECT item_id, g, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS x FROM (SELECT item_id, g, (1 + ln(tf)) * idf AS x FROM title_grams JOIN title_vocab USING (g))",
    "bq_grams": f"SELECT query_id, g, count(*) AS tf FROM (SELECT query_id, unnest({_grams('w', 3, 5)}) AS g FROM (SELECT query_id, unnest(string_split(text, ' ')) AS w FROM bq)) GROUP BY ALL",
    "bq_unit": "SELECT query_id, g, x / sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS x FROM (SELECT query_id, g, (1 + ln(tf)) * idf AS x FROM bq_grams JOIN title_vocab USING (g))",
    "char_scored": """SELECT query_id, item_id, score, q.loc = c.loc AS local FROM (SELECT query_id, item_id, round(sum(a.x * b.x), 9) AS score FROM bq_unit a JOIN title_unit b USING (g) GROUP BY ALL) JOIN bq q USING (query_id)
  JOIN corpus c USING (item_id) WHERE score > 0 AND (q.cat <> '114' OR c.category = '114')""",
}
A.refresh()


@query(_top("char_scored", 300, "local DESC, score DESC, item_id"))
def char_candidates(spark: SparkSession, sf: str) -> DataFrame:
    items, q = A.corpus(spark, sf), A.text_queries(spark, sf)
    known, vocabulary = lexical.char_weights(items.select("item_id", T.normalize("title").alias("text")), "item_id", 3, 5, min_df=2, max_df=0.3)
    sim = lexical.cosine(lexical.char_query_vectors(q, vocabulary, 3, 5), known, "query_id", "item_id")
    return _rounded(C.lexical_candidates(sim.where("sim > 0").withColumnRenamed("sim", "score"), q, items, _own_place(spark, q), 300, True))


@query(_top("popular_scored", 100))
def popular_local(spark: SparkSession, sf: str) -> DataFrame:
    c = _context(spark, sf)
    return _rounded(C.popular_local(c["popular"], c["asked"], c["items"], c["local"], 100))


def _classes(c: dict[str, DataFrame]) -> DataFrame:
    counts = c["past"].select("qn", "item_id").join(c["items"].select("item_id", "microcat"), "item_id").groupBy("qn", "microcat").agg(F.count("*").alias("n"))
    total = counts.groupBy("qn").agg(F.sum("n").alias("total"))
    return c["asked"].select("query_id", "qn").join(counts.join(total, "qn"), "qn").select("query_id", "microcat", (F.col("n") / F.col("total")).alias("p"))


@query(_top("microcat_scored", 200))
def microcat_empirical(spark: SparkSession, sf: str) -> DataFrame:
    c = _context(spark, sf)
    return _rounded(C.microcat_candidates(_classes(c), c["asked"], c["items"], c["popular"], c["local"], 200))


# ---- dense and ring ----


def _dense(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    q, i = A.vectors(spark, sf)
    return _rounded(C.dense_candidates(C.dense_scores(q, i), q, i, _own_place(spark, q), 300, mode))


@query(_top("dense", 300))
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _dense(spark, sf, "glob")


@query(_top("(SELECT * FROM dense WHERE local)", 300))
def dense_loc(spark: SparkSession, sf: str) -> DataFrame:
    return _dense(spark, sf, "loc")


@query(_top("dense", 300, "local DESC, score DESC, item_id"))
def dense_lf(spark: SparkSession, sf: str) -> DataFrame:
    return _dense(spark, sf, "lf")


_KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"
A.VIEWS |= {
    "bq_at": "SELECT q.query_id, q.loc, q.cat, 40 + 0.5 * q.loc AS lat, 10 + 0.3 * q.loc AS lon FROM bq q",
    "vq_at": "SELECT q.query_id, q.loc, q.cat, 40 + 0.5 * q.loc AS lat, 10 + 0.3 * q.loc AS lon FROM vq q",
    "ring_bm25_scored": f"SELECT s.query_id, s.item_id, s.score FROM bm25 s JOIN bq_at q USING (query_id) JOIN corpus c USING (item_id) WHERE q.loc <> c.loc AND (q.cat <> '114' OR c.category = '114') AND {_KM.format(a='q.', b='c.')} <= 100",
    "ring_dense_scored": f"SELECT s.query_id, s.item_id, s.score FROM dense s JOIN vq_at q USING (query_id) JOIN vi i USING (item_id) WHERE NOT s.local AND {_KM.format(a='q.', b='i.')} <= 100",
}
A.refresh()


def _places(items: DataFrame) -> DataFrame:
    return items.groupBy("loc").agg(F.median("lat").alias("lat"), F.median("lon").alias("lon"))


@query(_top("ring_bm25_scored", 50))
def ring_bm25(spark: SparkSession, sf: str) -> DataFrame:
    items, q, posted, terms = _bm25(spark, sf)
    around = C.ring(q, _places(items), items, _own_place(spark, q))
    return _rounded(C.ring_candidates(lexical.bm25_scores(terms, posted), around, 50))


@query(_top("ring_dense_scored", 50))
def ring_dense(spark: SparkSession, sf: str) -> DataFrame:
    q, i = A.vectors(spark, sf)
    around = C.ring(q, _places(i), i, _own_place(spark, q))
    return _rounded(C.ring_candidates(C.dense_scores(q, i), around, 50))


@query(f"SELECT a.loc AS a, b.loc AS b, round({_KM.format(a='a.', b='b.')}, 6) AS km FROM (SELECT DISTINCT loc, lat, lon FROM items) a, (SELECT DISTINCT loc, lat, lon FROM items) b WHERE b.loc = (a.loc * 7 + 3) % 25")
def haversine(spark: SparkSession, sf: str) -> DataFrame:
    x = A.items(spark, sf).select("loc", "lat", "lon").distinct()
    y = x.select(F.col("loc").alias("b"), F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    both = x.withColumn("b", ((F.col("loc") * 7 + 3) % 25).cast("int")).join(y, "b")
    return both.select(F.col("loc").alias("a"), "b", F.round(haversine_km(F.col("lat"), F.col("lon"), F.col("blat"), F.col("blon")), 6).alias("km"))


# ---- fusion and features ----

DEPTHS = {"memory_loc": 300, "memory_any": 300, "popular": 50, "microcat": 150}


def _lists(c: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        "memory_loc": C.memory_same_place(c["past"], c["asked"], c["items"], 300), "memory_any": C.memory_anywhere(c["past"], c["asked"], c["items"], c["local"], 300),
        "popular": C.popular_local(c["popular"], c["asked"], c["items"], c["local"], 100), "microcat": C.microcat_candidates(_classes(c), c["asked"], c["items"], c["popular"], c["local"], 200),
    }


def _once(c: dict[str, DataFrame], *more: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """The context with one query, the first, of those that the lists and ``more`` cannot tell apart, and every query with the one that it is ``like``.

    Lists look at a query's text, its place and whether its category is open to all items.
    """
    kind = Window.partitionBy("qn", "loc", F.coalesce(F.col("cat") != A.SERVICE, F.lit(False)), *more)
    members = prep.settled(c["asked"].withColumn("like", F.min("query_id").over(kind)))
    one = members.where("query_id = like").drop("like")
    return c | {"asked": one, "local": prep.settled(context.local_pairs(one, c["zone"]))}, members


def _pool(c: dict[str, DataFrame], behavioural: set[str] = frozenset({"memory_loc", "memory_any", "popular"})) -> DataFrame:
    # what was chosen at each place is as long as the log; a query's list needs no other texts and places than its own
    at_places = lambda: prep.settled(*[C.memory_same_place(c["past"].where(one), c["asked"], c["items"], 300) for one in prep.passes(c["past"], "qn", "loc")])
    return prep.settled(fusion.pool({n: at_places() if n == "memory_loc" else prep.settled(x) for n, x in _lists(c).items()}, DEPTHS, behavioural))


A.VIEWS |= {
    "listed": " UNION ALL ".join(f"SELECT query_id, item_id, CAST(score AS DOUBLE) AS score, rank, '{n}' AS source FROM ({_top(v, DEPTHS[n], o, 9)}) t" for n, v, o in (("memory_loc", "memory_loc_scored", "score DESC, item_id"), ("memory_any", "memory_any_scored", "local DESC, score DESC, item_id"), ("popular", "popular_scored", "score DESC, item_id"), ("microcat", "microcat_scored", "score DESC, item_id"))),
    "pooled": "SELECT query_id, item_id, count(*) AS n_sources FROM listed GROUP BY ALL",
    "gold": "SELECT query_id, [item_id] AS answers FROM asked",
}
A.refresh()


@query("SELECT query_id, item_id, count(*) AS n_sources, " + ", ".join(f"max(CASE WHEN source = '{n}' THEN rank END) AS r_{n}, round(max(CASE WHEN source = '{n}' THEN score END), 9) AS s_{n}" for n in DEPTHS) + " FROM listed GROUP BY query_id, item_id")
def pool_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    one, members = _once(_context(spark, sf))
    x = _pool(one, set()).withColumns({f"s_{n}": F.round(f"s_{n}", 9) for n in DEPTHS})
    return fusion.spread(x, members.select("like", "query_id"))


@query("SELECT n_sources, count(*) AS candidates FROM pooled GROUP BY 1")
def n_sources(spark: SparkSession, sf: str) -> DataFrame:
    one, members = _once(_context(spark, sf))
    each = _pool(one).groupBy("query_id", "n_sources").agg(F.count("*").alias("n"))
    return fusion.spread(each, members.select("like", "query_id")).groupBy("n_sources").agg(F.sum("n").alias("candidates"))


def _gold(c: dict[str, DataFrame]) -> DataFrame:
    return c["asked"].select("query_id", F.array("item_id").alias("answers"))


def _answered(members: DataFrame) -> DataFrame:
    return members.select("like", "query_id", F.array("item_id").alias("answers"))


@query("SELECT p.query_id, p.item_id, CASE WHEN a.item_id = p.item_id THEN 1 ELSE 0 END AS label FROM pooled p JOIN asked a ON a.query_id = p.query_id")
def label_join(spark: SparkSession, sf: str) -> DataFrame:
    one, members = _once(_context(spark, sf))
    return fusion.with_label(_pool(one), _answered(members)).select("query_id", "item_id", "label")


A.VIEWS |= {
    "bq_pool": "SELECT query_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM bm25_placed ) WHERE r <= 50",
    "bq_words": f"SELECT query_id, {TOKENS('text')} AS q FROM bq",
    "corpus_words": f"SELECT item_id, {TOKENS('title')} AS title, {TOKENS('params')} AS params, list_slice({TOKENS('descr')}, 1, 300) AS descr FROM corpus",
}
A.refresh()


def _text_pool(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    items, q, posted, terms = _bm25(spark, sf)
    best = C.lexical_candidates(lexical.bm25_scores(terms, posted), q, items, _own_place(spark, q), 50, False).select("query_id", "item_id")
    return best, items, q, posted, terms


@query("""SELECT b.query_id, b.item_id, """ + ", ".join(f"round(coalesce(sum(CASE WHEN field = '{f}' THEN qw * w END), 0), 6) AS bm25_{f}" for f in ("title", "params", "descr")) + """
FROM bq_pool b LEFT JOIN (SELECT * FROM bq_terms JOIN postings USING (term)) t ON t.query_id = b.query_id AND t.item_id = b.item_id GROUP BY ALL""")
def bm25_field_features(spark: SparkSession, sf: str) -> DataFrame:
    best, _, _, posted, terms = _text_pool(spark, sf)
    return fusion.field_features(best, terms, posted, ["title", "params", "descr"])


_OVL = ", ".join(f"CASE WHEN len(q) > 0 THEN round(len(list_filter(q, lambda w: list_contains({f}, w))) / len(q), 9) END AS ovl_{f}" for f in ("title", "params", "descr"))


@query(f"SELECT query_id, item_id, {_OVL}, CASE WHEN len(q) > 0 AND len(list_filter(q, lambda w: NOT list_contains(title, w))) = 0 THEN 1 ELSE 0 END AS all_in_title FROM bq_pool JOIN bq_words USING (query_id) JOIN corpus_words USING (item_id)")
def overlap_features(spark: SparkSession, sf: str) -> DataFrame:
    best, items, q, _, _ = _text_pool(spark, sf)
    x = fusion.overlap_features(best, q, items, lexical.item_fields())
    return x.select("query_id", "item_id", *[F.round(f"ovl_{f}", 9).alias(f"ovl_{f}") for f in ("title", "params", "descr")], "all_in_title")


@query("SELECT query_id, item_id, round(score, 9) AS cos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM dense ) WHERE r <= 20")
def cosine_feature(spark: SparkSession, sf: str) -> DataFrame:
    q, i = A.vectors(spark, sf)
    best = C.dense_candidates(C.dense_scores(q, i), q, i, _own_place(spark, q), 20, "glob").select("query_id", "item_id")
    return fusion.cosine_feature(best, q, i, "cos").select("query_id", "item_id", "cos")


A.VIEWS |= {
    "loc_counts": "SELECT p.loc, i.loc AS item_loc, count(*) AS n FROM past p JOIN items i ON p.item_id = i.item_id GROUP BY ALL",
    "loc_p": "SELECT loc, item_loc, (n + 0.1) / (sum(n) OVER (PARTITION BY loc) + 10) AS p, sum(n) OVER (PARTITION BY loc) AS total FROM loc_counts",
}
A.refresh()


@query(f"""SELECT p.query_id, p.item_id, CASE WHEN a.loc = i.loc THEN 1 ELSE 0 END AS same_loc, CASE WHEN l.item_loc IS NULL THEN 0 ELSE 1 END AS in_local, round({_KM.format(a='c.', b='i.')}, 6) AS dist_km,
round(coalesce(lp.p, 0.1 / (coalesce((SELECT max(total) FROM loc_p t WHERE t.loc = a.loc), 0) + 10)), 9) AS p_loc FROM pooled p JOIN asked a ON a.query_id = p.query_id JOIN items i ON i.item_id = p.item_id
LEFT JOIN local l ON l.query_id = p.query_id AND l.item_loc = i.loc LEFT JOIN centroids c ON c.loc = a.loc LEFT JOIN loc_p lp ON lp.loc = a.loc AND lp.item_loc = i.loc""")
def place_features(spark: SparkSession, sf: str) -> DataFrame:
    c, members = _once(_context(spark, sf))
    p = context.location_probability(c["past"], c["items"])
    totals = c["past"].groupBy("loc").agg(F.count("*").alias("n_loc"))
    around = prep.settled(p.join(totals, "loc")), prep.settled(context.centroids(c["past"], c["items"], c["regions"]))
    x = fusion.place_features(_pool(c).select("query_id", "item_id"), c["asked"], c["items"], c["local"], around[1], around[0])
    return fusion.spread(x, members.select("like", "query_id")).select("query_id", "item_id", "same_loc", "in_local", "dist_km", "p_loc")


@query("""SELECT p.query_id, p.item_id, round(coalesce(c.p, 0), 9) AS p_microcat, CAST(coalesce(c.r - 1, 999) AS INTEGER) AS microcat_rank FROM pooled p JOIN items i ON i.item_id = p.item_id
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, microcat) AS r FROM class_p ) c ON c.query_id = p.query_id AND c.microcat = i.microcat""")
def class_features(spark: SparkSession, sf: str) -> DataFrame:
    c, members = _once(_context(spark, sf))
    x = fusion.class_features(_pool(c).select("query_id", "item_id"), _classes(c), c["items"])
    x = x.select("query_id", "item_id", F.round("p_microcat", 9).alias("p_microcat"), "microcat_rank")
    return fusion.spread(x, members.select("like", "query_id"))


_IT = ["rating", "log_reviews", "has_rating", "log_price", "price_is_1", "price_rel_med", "phone_hidden", "msg_forbidden", "title_words", "desc_words", "params_words", "desc_dup", "title_dup", "emoji_share"]


@query(f"SELECT p.query_id, p.item_id, {', '.join(f's.{c} AS it_{c}' for c in _IT)} FROM pooled p JOIN ({_STATIC}) s ON s.item_id = p.item_id")
def item_features(spark: SparkSession, sf: str) -> DataFrame:
    one, members = _once(_context(spark, sf))
    return fusion.spread(fusion.item_features(_pool(one).select("query_id", "item_id"), _static(spark, sf)), members.select("like", "query_id"))


@query(f"""SELECT query_id, CAST(len({TOKENS('text')}) AS INTEGER) AS q_len, CASE WHEN filters = '' THEN 0 ELSE 1 END AS q_has_filters, CASE WHEN loc IN (SELECT loc FROM regions) THEN 1 ELSE 0 END AS q_region,
CASE WHEN qn IN (SELECT qn FROM past) THEN 1 ELSE 0 END AS q_text_seen, CASE WHEN cat = '114' THEN 1 ELSE 0 END AS q_service FROM asked""")
def query_features(spark: SparkSession, sf: str) -> DataFrame:
    c = _context(spark, sf)
    return fusion.query_features(c["asked"], c["past"], c["regions"], A.SERVICE)


@query()
def filter_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Filters of the known form from the log's segments and categories, parsed again and matched with items."""
    c, members = _once(_context(spark, sf))
    made = F.concat(F.lit("Вид услуги "), F.col("cat"), F.lit(" Тип услуги "), F.col("qn"), F.when(F.col("loc") % 2 == 0, F.lit(" Рейтинг пользователя 4 звезды")).otherwise(""))
    q = members.withColumn("filters", made)
    items = c["items"].withColumn("params", F.concat(F.lit("Вид услуги "), "category", F.lit(" Тип услуги "), T.normalize("title")))
    x = fusion.filter_features(_pool(c).select("query_id", "item_id"), q, items)
    return x.select("query_id", "item_id", "f_vid", "f_tip", "f_rating4_ok")


# ---- ranking and evaluation ----


@query("""SELECT k, round(avg(CASE WHEN l.rank < k THEN 1.0 ELSE 0.0 END), 6) AS recall, count(*) AS queries FROM (SELECT unnest([10, 50, 300]) AS k) CROSS JOIN asked a
LEFT JOIN (SELECT * FROM listed WHERE source = 'memory_any') l ON l.query_id = a.query_id AND l.item_id = a.item_id GROUP BY k""")
def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    c = _context(spark, sf)
    return evaluate.recall_at(_lists(c)["memory_any"], _gold(c), [10, 50, 300])


_FINAL = """SELECT query_id, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY r) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, own, item_id) AS r FROM (
  SELECT query_id, item_id, o.tier, o.own FROM (SELECT query_id, item_id, min({'tier': tier, 'own': own}) AS o FROM (SELECT query_id, item_id, 0 AS tier, CAST(-score AS DOUBLE) AS own FROM listed WHERE source = 'memory_loc'
  UNION ALL SELECT query_id, item_id, 1, CAST(rank AS DOUBLE) FROM listed WHERE source = 'popular') GROUP BY ALL))) WHERE r <= 50 GROUP BY query_id"""


def _final(c: dict[str, DataFrame]) -> DataFrame:
    lists = _lists(c)
    return evaluate.final_answers(lists["memory_loc"].withColumn("score", F.col("score").cast("double")), lists["popular"].where("rank < 50"))


@query(_FINAL)
def final_top50(spark: SparkSession, sf: str) -> DataFrame:
    return _final(_context(spark, sf))


@query(f"""SELECT query_id, 'missing query' AS problem FROM asked WHERE query_id NOT IN (SELECT query_id FROM ({_FINAL}))""")
def answer_check(spark: SparkSession, sf: str) -> DataFrame:
    c = _context(spark, sf)
    return evaluate.check_answers(_final(c), c["asked"], c["items"], hex_ids=False)


_HARD = """SELECT qn, item_id, neg, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY qn, item_id ORDER BY ((row_id * 31 + p) * 7919 + 42 * 104729) % 1000003, p) AS place FROM (SELECT * FROM (
  SELECT o.qn, o.item_id, o.row_id, n.neg, row_number() OVER (PARTITION BY o.qn, o.item_id ORDER BY n.rank, n.neg) AS p FROM (SELECT po.*, i.microcat FROM pos po JOIN items i USING (item_id)) o JOIN (SELECT l.qn, l.neg, l.rank, i.title, i.microcat AS c FROM neg_lists l JOIN items i ON i.item_id = l.neg
    WHERE NOT EXISTS (SELECT 1 FROM past p WHERE p.qn = l.qn AND p.item_id = l.neg)) n ON n.qn = o.qn AND n.c <> o.microcat
    WHERE NOT EXISTS (SELECT 1 FROM pos p2 JOIN items i2 USING (item_id) WHERE p2.qn = o.qn AND i2.title = n.title)) WHERE p <= 30)) WHERE place <= 2"""
A.VIEWS |= {
    "pos": """SELECT qn, item_id, row_id FROM (SELECT *, row_number() OVER (PARTITION BY qn ORDER BY (row_id * 7919 + 42 * 104729) % 1000003, row_id) AS p FROM (SELECT qn, item_id, min(row_id) AS row_id FROM past GROUP BY ALL)) WHERE p <= 5
  ORDER BY (row_id * 7919 + 43 * 104729) % 1000003, row_id LIMIT 1000""",
    "neg_lists": "SELECT qn, item_id AS neg, r - 1 AS rank FROM (SELECT t.qn, i.item_id, row_number() OVER (PARTITION BY t.qn ORDER BY (i.item_id * 7919 + len(t.qn)) % 1009, i.item_id) AS r FROM (SELECT DISTINCT qn, cat FROM past) t JOIN items i ON i.category = t.cat) WHERE r <= 100",
}
A.refresh()


@query(_HARD)
def hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    c = _context(spark, sf)
    positive = hardneg.positives(c["past"], 5, 1000, SEED)
    # a text's candidates are all items of the categories that it was searched in
    texts = c["past"].select("qn", F.col("cat").alias("category")).distinct()
    order = (F.col("item_id") * 7919 + F.length("qn")) % 1009
    spot = F.row_number().over(Window.partitionBy("qn").orderBy(order, "item_id"))
    lists = c["items"].select("item_id", "category").join(texts, "category").withColumn("rank", spot - 1).where(F.col("rank") < 100)
    out = hardneg.negatives(positive, c["past"], lists, c["items"], 2, SEED)
    return out.select("qn", "item_id", "neg", "place")


@query()
def microcat_classifier(spark: SparkSession, sf: str) -> DataFrame:
    c = _context(spark, sf)
    model = models.train_classifier(c["past"], c["items"].select("item_id", "microcat"))
    found = models.classify(model, c["asked"].select("query_id", "qn", "filters"))
    return C.microcat_candidates(found, c["asked"], c["items"], c["popular"], c["local"], 200)


def _table(c: dict[str, DataFrame], spark: SparkSession, sf: str) -> DataFrame:
    x = fusion.class_features(_pool(c, {"memory_loc"}), _classes(c), c["items"])
    x = fusion.item_features(x, _static(spark, sf))
    return prep.settled(x.join(fusion.query_features(c["asked"], c["past"], c["regions"], A.SERVICE), "query_id"))


@query()
def gbt_rank(spark: SparkSession, sf: str) -> DataFrame:
    # features see of the filters whether there are any, so queries that are alike have the same scores and differ in their labels
    c, members = _once(_context(spark, sf), F.coalesce("filters", F.lit("")) != "")
    table = _table(c, spark, sf)
    model = models.train_ranker(fusion.with_label(table, _answered(members)))
    return fusion.spread(C.top(models.rank(model, table), 50), members.select("like", "query_id"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_local(spark, sf_dir)
