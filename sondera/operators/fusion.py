"""One table of candidates with features, from many lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geo import haversine_km


def pool(lists: dict[str, DataFrame], depths: dict[str, int], behavioural: set[str] = frozenset()) -> DataFrame:
    """``(query_id, item_id, r_<source>, s_<source>, ..., n_sources)`` of every candidate of any list.

    A union and one aggregation instead of a chain of full outer joins: one shuffle whatever the number of lists. Behavioural lists
    count in ``n_sources`` but give no columns.
    """
    stacked = None
    for name, one in lists.items():
        part = one.where(F.col("rank") < depths[name]).select("query_id", "item_id", F.col("score").cast("double").alias("score"), "rank", F.lit(name).alias("source"))
        stacked = part if stacked is None else stacked.unionByName(part)
    kept = [n for n in lists if n not in behavioural]
    of = lambda name, c: F.max(F.when(F.col("source") == name, F.col(c)))
    columns = [x for n in kept for x in (of(n, "rank").alias(f"r_{n}"), of(n, "score").alias(f"s_{n}"))]
    return stacked.groupBy("query_id", "item_id").agg(F.count("*").alias("n_sources"), *columns)


def spread(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """The candidates of one query for every query that is like it, with the columns of ``members(like, query_id, ...)``."""
    return candidates.withColumnRenamed("query_id", "like").join(members, "like").drop("like")


def with_label(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """``candidates`` spread to ``members(like, query_id, answers, ...)``, with ``label`` 1 where the item is among the query's answers."""
    hit = F.coalesce(F.array_contains("answers", F.col("item_id")), F.lit(False))
    return spread(candidates, members).withColumn("label", hit.cast("int")).drop("answers")


def field_features(candidates: DataFrame, terms: DataFrame, posted: DataFrame, fields: list[str]) -> DataFrame:
    """``bm25_<field>`` of the candidates only: the pool meets the query's terms, then the postings, on item and term."""
    wanted = candidates.select("query_id", "item_id").join(terms, "query_id")
    s = wanted.join(posted, ["item_id", "term"]).groupBy("query_id", "item_id").agg(*[F.round(F.sum(F.when(F.col("field") == f, F.col("qw") * F.col("w"))), 6).alias(f"bm25_{f}") for f in fields])
    out = candidates.join(s, ["query_id", "item_id"], "left")
    return out.withColumns({f"bm25_{f}": F.coalesce(f"bm25_{f}", F.lit(0.0)) for f in fields})


def overlap_features(candidates: DataFrame, queries: DataFrame, items: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """``ovl_<field>``: the share of a query's words that the field has, unknown words included; NULL without words. ``all_in_title``."""
    words = queries.select("query_id", T.lemma_tokens("text").alias("__all"))
    terms = items.select("item_id", *[t.alias(f"__{f}") for f, t in fields.items()])
    x = candidates.join(words, "query_id").join(terms, "item_id")
    found = lambda f: F.size(F.filter("__all", lambda w: F.array_contains(F.col(f"__{f}"), w)))
    for f in fields:
        has = found(f)
        x = x.withColumn(f"ovl_{f}", F.when(F.size("__all") > 0, has / F.size("__all")))
    x = x.withColumn("all_in_title", F.when(F.col("ovl_title") >= 1, 1).otherwise(0))
    return x.drop("__all", *[f"__{f}" for f in fields])


def cosine_feature(candidates: DataFrame, queries: DataFrame, items: DataFrame, name: str) -> DataFrame:
    """Inner product of the query's and the item's vector; NULL where one has none."""
    dot = F.aggregate(F.zip_with("__q", "__v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    x = candidates.join(queries.select("query_id", F.col("v").alias("__q")), "query_id", "left").join(items.select("item_id", F.col("v").alias("__v")), "item_id", "left")
    return x.withColumn(name, F.round(dot, 9)).drop("__q", "__v")


def place_features(candidates: DataFrame, queries: DataFrame, items: DataFrame, local: DataFrame, centroids: DataFrame, p_loc: DataFrame, alpha: float = 0.1, places: int = 10) -> DataFrame:
    """``same_loc``, ``in_local``, ``dist_km`` (NULL without a centroid) and the smoothed ``p_loc``."""
    x = candidates.join(queries.select("query_id", "loc"), "query_id").join(items.select("item_id", F.col("loc").alias("item_loc"), F.col("lat").alias("__ilat"), F.col("lon").alias("__ilon")), "item_id")
    x = x.join(local.withColumn("__l", F.lit(1)), ["query_id", "item_loc"], "left").join(F.broadcast(centroids.select("loc", F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))), "loc", "left")
    totals = p_loc.groupBy("loc").agg(F.max("n_loc").alias("__n"))
    x = x.join(p_loc.select("loc", "item_loc", "p_loc"), ["loc", "item_loc"], "left").join(totals, "loc", "left")
    x = x.withColumn("p_loc", F.round(F.coalesce("p_loc", F.lit(alpha) / (F.coalesce("__n", F.lit(0)) + F.lit(places))), 9))
    x = x.withColumn("same_loc", (F.col("loc") == F.col("item_loc")).cast("int")).withColumn("in_local", F.coalesce("__l", F.lit(0)))
    x = x.withColumn("dist_km", F.round(haversine_km(F.col("__lat"), F.col("__lon"), F.col("__ilat"), F.col("__ilon")), 6))
    return x.drop("loc", "item_loc", "__ilat", "__ilon", "__lat", "__lon", "__l", "__n")


def class_features(candidates: DataFrame, classes: DataFrame, items: DataFrame) -> DataFrame:
    """``p_microcat`` and ``microcat_rank`` (from 0) of the item's class for the query; 0 and 999 where it has none."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("p"), "microcat")) - 1
    ranked = classes.withColumn("microcat_rank", rank).withColumnRenamed("p", "p_microcat")
    x = candidates.join(items.select("item_id", "microcat"), "item_id").join(ranked, ["query_id", "microcat"], "left")
    return x.withColumn("p_microcat", F.coalesce("p_microcat", F.lit(0.0))).withColumn("microcat_rank", F.coalesce("microcat_rank", F.lit(999))).drop("microcat")


def filter_features(candidates: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """``f_vid``, ``f_tip``: whether the item has what the query's filters ask for; ``f_rating4_ok``: four stars or unrated.

    The candidates meet their items before they are spread to ``queries(like, query_id, filters)``.
    """
    own = candidates.join(items.select("item_id", F.col("params").alias("__p"), F.col("rating").alias("__r")), "item_id")
    x = spread(own, queries.select("like", "query_id", T.parse_query_filters("filters").alias("__f")))
    x = x.withColumn("f_vid", T.item_matches(F.col("__f.vid"), F.col("__p"), "vid")).withColumn("f_tip", T.item_matches(F.col("__f.tip"), F.col("__p"), "tip"))
    return x.withColumn("f_rating4_ok", F.when(F.col("__f.rating4"), F.coalesce((F.col("__r") >= 4).cast("double"), F.lit(1.0)))).drop("__f", "__p", "__r")


def item_features(candidates: DataFrame, static: DataFrame) -> DataFrame:
    """The item's own features as ``it_*``."""
    keep = [c for c in static.columns if c not in ("item_id", "loc", "microcat", "category", "lat", "lon")]
    return candidates.join(static.select("item_id", *[F.col(c).alias(f"it_{c}") for c in keep]), "item_id")


def query_features(queries: DataFrame, pairs: DataFrame, regions: DataFrame, service: str) -> DataFrame:
    """``q_len``, ``q_has_filters``, ``q_region``, ``q_text_seen`` and ``q_service`` of each query."""
    seen = pairs.select("qn").distinct().withColumn("__s", F.lit(1))
    region = regions.select("loc").withColumn("__r", F.lit(1))
    x = queries.join(seen, "qn", "left").join(F.broadcast(region), "loc", "left")
    return x.select("query_id", F.size(T.lemma_tokens("text")).alias("q_len"), (F.coalesce("filters", F.lit("")) != "").cast("int").alias("q_has_filters"), F.coalesce("__r", F.lit(0)).alias("q_region"), F.coalesce("__s", F.lit(0)).alias("q_text_seen"), (F.col("cat") == service).cast("int").alias("q_service"))
