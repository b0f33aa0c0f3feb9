"""Candidate generators: each gives ``(query_id, item_id, score, rank)``, ranks from 0, ties to the smaller item_id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import KM_A_DEGREE, haversine_km
from .context import mark_local

SERVICE = "114"
RADIUS_KM = 100.0
REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def source(name: str) -> Callable:
    """Register a generator under ``name``."""

    def keep(f: Callable) -> Callable:
        REGISTRY[name] = f
        return f

    return keep


def top(scored: DataFrame, depth: int, local_first: bool = False, by: list[Column] | None = None) -> DataFrame:
    """Each query's first ``depth`` rows: local ones first if wanted, then the highest scores."""
    order = ([F.desc("local")] if local_first else []) + (by or [F.desc("score"), F.asc("item_id")])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    out = scored.withColumn("rank", rank - 1).where(F.col("rank") < depth)
    return out.select("query_id", "item_id", "score", F.col("rank").cast("int").alias("rank"))


def allowed(scored: DataFrame, service: str = SERVICE) -> DataFrame:
    """Queries in the service category see only its items; ``cat`` is the query's category and ``item_cat`` the item's."""
    return scored.where((F.col("cat") != service) | (F.col("item_cat") == service))


def shortlist(placed: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """The first ``depth`` rows of each ``keys``, of the service category's items and of the others: the longest list with these keys needs no more."""
    own = F.coalesce(F.col("item_cat") == SERVICE, F.lit(False))
    place = F.row_number().over(Window.partitionBy(*keys, own).orderBy(F.desc("score"), F.asc("item_id")))
    return placed.withColumn("__p", place).where(F.col("__p") <= depth).drop("__p")


def at_places(items: DataFrame, *more: str) -> DataFrame:
    return items.select("item_id", F.col("loc").alias("item_loc"), F.col("category").alias("item_cat"), *more)


def of_texts(scored: DataFrame, queries: DataFrame, items: DataFrame, local: DataFrame, depth: int) -> DataFrame:
    """Each query's list, local ones first, of ``scored(qn, item_id, score)``, whose scores depend on the query's text alone.

    A text's first ``depth`` items at each location and in all are found once, not once a query.
    """
    placed = scored.join(at_places(items), "item_id")
    mine = queries.select("query_id", "qn", "cat")
    near = allowed(mine.join(local, "query_id").join(shortlist(placed, ["qn", "item_loc"], depth), ["qn", "item_loc"])).withColumn("local", F.lit(True))
    far = mark_local(allowed(mine.join(shortlist(placed, ["qn"], depth), "qn")), local).where(~F.col("local"))
    columns = ["query_id", "item_id", "score", "local"]
    return top(near.select(*columns).unionByName(far.select(*columns)), depth, local_first=True)


def with_places(scored: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """Scores with the query's category and the item's location and category, hard filter applied."""
    x = scored.join(at_places(items), "item_id")
    return allowed(x.join(queries.select("query_id", "cat"), "query_id"))


@source("bm25")
def lexical_candidates(scores: DataFrame, queries: DataFrame, items: DataFrame, local: DataFrame, depth: int, local_first: bool, alpha: float | None = None) -> DataFrame:
    """BM25 or n-gram scores as a list: local first, or by score * (1 + alpha) where local."""
    x = mark_local(with_places(scores, queries, items), local)
    if alpha:
        x = x.withColumn("boosted", F.col("score") * (1 + F.lit(alpha) * F.col("local").cast("int")))
        return top(x, depth, by=[F.desc("boosted"), F.asc("item_id")])
    return top(x, depth, local_first)


def fill(answers: DataFrame, queries: DataFrame, items: DataFrame, local: DataFrame, popular: DataFrame, k: int) -> DataFrame:
    """Short answers filled up to ``k``: popular local items, then any popular ones; ``popular(item_id, chosen)``.

    Only the ``k`` most popular items of each location and category, and of all, can be needed, so no query meets the whole corpus.
    """
    x = items.select("item_id", F.col("loc").alias("item_loc"), F.col("category").alias("item_cat")).join(popular, "item_id", "left").withColumn("chosen", F.coalesce("chosen", F.lit(0)))
    order = [F.desc("chosen"), F.asc("item_id")]
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    near = x.withColumn("p", place("item_loc", "item_cat")).where(F.col("p") <= k).drop("p")
    far = x.withColumn("p", place("item_cat")).where(F.col("p") <= k).drop("p")
    short = answers.where(F.col("rank") < k).groupBy("query_id").agg(F.count("*").alias("have"))
    open_ = queries.select("query_id", "cat").join(short, "query_id", "left").where(F.coalesce("have", F.lit(0)) < k).select("query_id", "cat")
    nearby = allowed(open_.join(local, "query_id").join(near, "item_loc")).select("query_id", "item_id", "chosen", F.lit(1).alias("tier"))
    cats = far.select("item_cat").distinct()
    wide = open_.join(F.broadcast(cats), (F.col("cat") != SERVICE) | (F.col("item_cat") == SERVICE)).join(far, "item_cat").select("query_id", "item_id", "chosen", F.lit(2).alias("tier"))
    own = answers.where(F.col("rank") < k).select("query_id", "item_id", F.lit(0).cast("long").alias("chosen"), F.lit(0).alias("tier"), "rank")
    more = nearby.unionByName(wide).withColumn("rank", F.lit(0))
    best = own.unionByName(more).groupBy("query_id", "item_id").agg(F.min(F.struct("tier", "rank", F.negative("chosen").alias("less"))).alias("at"))
    spot = F.row_number().over(Window.partitionBy("query_id").orderBy("at.tier", "at.rank", "at.less", "item_id"))
    return best.withColumn("rank", spot - 1).where(F.col("rank") < k).select("query_id", "item_id", F.col("at.tier").alias("tier"), F.col("rank").cast("int").alias("rank"))


@source("memory_loc")
def memory_same_place(pairs: DataFrame, queries: DataFrame, items: DataFrame, depth: int) -> DataFrame:
    """Items chosen for the same text in the same search location, by how often."""
    counts = pairs.groupBy("qn", "loc", "item_id").agg(F.count("*").alias("score"))
    best = shortlist(counts.join(at_places(items), "item_id"), ["qn", "loc"], depth)
    return top(allowed(queries.select("query_id", "qn", "loc", "cat").join(best, ["qn", "loc"])), depth)


@source("memory_any")
def memory_anywhere(pairs: DataFrame, queries: DataFrame, items: DataFrame, local: DataFrame, depth: int) -> DataFrame:
    """Items chosen for the same text anywhere, local ones first."""
    return of_texts(pairs.groupBy("qn", "item_id").agg(F.count("*").alias("score")), queries, items, local, depth)


@source("similar")
def similar_queries(neighbours: DataFrame, pairs: DataFrame, queries: DataFrame, items: DataFrame, local: DataFrame, depth: int, nearest: int = 30) -> DataFrame:
    """Items of the ``nearest`` most similar past texts, by the sum of similarity times count. ``neighbours(text, qn, sim)`` of each different text."""
    place = F.row_number().over(Window.partitionBy("text").orderBy(F.desc("sim"), "qn"))
    near = neighbours.where("sim > 0").withColumn("p", place).where(F.col("p") <= nearest)
    counts = pairs.groupBy("qn", "item_id").agg(F.count("*").alias("n"))
    found = near.join(counts, "qn").groupBy(F.col("text").alias("qn"), "item_id").agg(F.round(F.sum(F.col("sim") * F.col("n")), 9).alias("score"))
    return of_texts(found, queries, items, local, depth)


@source("popular")
def popular_local(popular: DataFrame, queries: DataFrame, items: DataFrame, local: DataFrame, depth: int) -> DataFrame:
    """The most chosen local items. The first ``depth`` of a location are found once, not once a query."""
    x = at_places(items).join(popular.withColumnRenamed("chosen", "score"), "item_id").where("score > 0")
    return top(allowed(local.join(queries.select("query_id", "cat"), "query_id").join(shortlist(x, ["item_loc"], depth), "item_loc")), depth)


@source("microcat")
def microcat_candidates(classes: DataFrame, queries: DataFrame, items: DataFrame, popular: DataFrame, local: DataFrame, depth: int, best: int = 3) -> DataFrame:
    """Local items of a query's ``best`` likeliest classes, by p * (1 + chosen + reviews / 1000 on a log scale). ``classes(query_id, microcat, p)``.

    Queries that give a class the same p share its first ``depth`` items of each location, found by the rounded score.
    """
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("p"), "microcat"))
    likely = classes.withColumn("r", place).where(F.col("r") <= best).select("query_id", "microcat", "p")
    worth = 1 + F.coalesce("chosen", F.lit(0)) + F.lit(1e-3) * F.log1p(F.coalesce("reviews", F.lit(0)).cast("double"))
    x = at_places(items, "microcat", "reviews").join(popular, "item_id", "left").withColumn("worth", worth)
    scored = likely.select("microcat", "p").distinct().join(x, "microcat").withColumn("score", F.round(F.col("p") * F.col("worth"), 9))
    short = shortlist(scored, ["microcat", "p", "item_loc"], depth)
    found = likely.join(local, "query_id").join(short, ["microcat", "p", "item_loc"]).join(queries.select("query_id", "cat"), "query_id")
    return top(allowed(found), depth)


def dense_scores(queries: DataFrame, items: DataFrame) -> DataFrame:
    """``(query_id, item_id, score)``: inner products of a bounded set of queries, sent to every task, with every item's vector."""
    dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    # the queries of a part are a benchmark's few thousand; callers with more send them in blocks
    pairs = items.select("item_id", "v").join(F.broadcast(queries.select("query_id", F.col("v").alias("qv"))))
    return pairs.select("query_id", "item_id", F.round(dot, 9).alias("score"))


@source("dense")
def dense_candidates(scores: DataFrame, queries: DataFrame, items: DataFrame, local: DataFrame, depth: int, mode: str = "lf") -> DataFrame:
    """``glob``: the whole corpus; ``loc``: local items only; ``lf``: local first, then the rest."""
    x = with_places(scores, queries, items)
    if mode == "glob":
        return top(x, depth)
    x = mark_local(x, local)
    return top(x.where("local"), depth) if mode == "loc" else top(x, depth, local_first=True)


def ring(queries: DataFrame, centroids: DataFrame, items: DataFrame, local: DataFrame, km: float = RADIUS_KM) -> DataFrame:
    """``(query_id, item_id)``: items up to ``km`` from the search location's centroid that are not local.

    Places meet by bands of latitude as wide as the radius, neighbouring bands included, so the join is on equal bands; the exact
    distance is looked at afterwards, once for each pair of places. Locations without a centroid have no ring.
    """
    band = lambda lat: F.floor(lat * F.lit(KM_A_DEGREE) / F.lit(km))
    spots = items.select(F.col("lat").alias("ilat"), F.col("lon").alias("ilon")).where("ilat is not null and ilon is not null").distinct().withColumn("band", band(F.col("ilat")))
    centres = queries.select("loc").distinct().join(centroids.where("lat is not null and lon is not null"), "loc")
    reach = centres.withColumn("band", F.explode(F.array(*[band(F.col("lat")) + d for d in (-1, 0, 1)])))
    near = reach.join(spots, "band").where(haversine_km(F.col("lat"), F.col("lon"), F.col("ilat"), F.col("ilon")) <= km).select("loc", "ilat", "ilon")
    placed = items.select("item_id", F.col("loc").alias("item_loc"), F.col("category").alias("item_cat"), F.col("lat").alias("ilat"), F.col("lon").alias("ilon"))
    around = allowed(queries.select("query_id", "loc", "cat").join(near, "loc").join(placed, ["ilat", "ilon"]))
    return around.join(local, ["query_id", "item_loc"], "left_anti").select("query_id", "item_id")


@source("ring")
def ring_candidates(scores: DataFrame, around: DataFrame, depth: int) -> DataFrame:
    """The best of the ring by any score."""
    return top(around.join(scores, ["query_id", "item_id"]), depth)
