"""What the past tells about places: regions without items, zones, centroids, popularity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COVER, ALPHA, PLACES = 0.9, 0.1, 10


def region_locations(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Search locations that hold no item."""
    return pairs.select("loc").distinct().join(items.select("loc").distinct(), "loc", "left_anti")


def zones(pairs: DataFrame, items: DataFrame, regions: DataFrame, cover: float = COVER) -> DataFrame:
    """``(loc, item_loc)``: each region's item locations, most chosen first, until those before cover ``cover`` of its choices."""
    chosen = pairs.join(regions, "loc", "left_semi").join(items.select("item_id", F.col("loc").alias("item_loc")), "item_id")
    counts = chosen.groupBy("loc", "item_loc").agg(F.count("*").alias("n"))
    own = Window.partitionBy("loc")
    before = own.orderBy(F.desc("n"), "item_loc").rowsBetween(Window.unboundedPreceding, -1)
    shares = counts.withColumn("total", F.sum("n").over(own)).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # whole numbers: a running sum of shares would differ in its last bits with the order of addition
    return shares.where(F.col("before") < F.lit(cover) * F.col("total")).select("loc", "item_loc")


def local_pairs(queries: DataFrame, zone: DataFrame, whole: int | None = None) -> DataFrame:
    """``(query_id, item_loc)``: the item locations that are local to each query; a region's are its zone, another's itself.

    An equi-join and a union instead of a condition with OR. Queries for the ``whole`` country have no row: ``mark_local`` takes them beside these, as every location is local to them.
    """
    named = queries.select("query_id", "loc") if whole is None else queries.where(F.col("loc") != whole).select("query_id", "loc")
    in_zone = named.join(zone, "loc").select("query_id", "item_loc")
    same = named.join(zone.select("loc").distinct(), "loc", "left_anti").select("query_id", F.col("loc").alias("item_loc"))
    return in_zone.unionByName(same)


def mark_local(scored: DataFrame, local: DataFrame, everywhere: DataFrame | None = None) -> DataFrame:
    """``scored(query_id, item_loc, ...)`` with the flag ``local``; to the queries of ``everywhere(query_id)`` all locations are."""
    flags = local.withColumn("__l", F.lit(True))
    if everywhere is not None:
        marked = scored.join(flags, ["query_id", "item_loc"], "left").join(everywhere.select("query_id").distinct().withColumn("__w", F.lit(True)), "query_id", "left")
        return marked.withColumn("local", F.coalesce("__l", "__w", F.lit(False))).drop("__l", "__w")
    return scored.join(flags, ["query_id", "item_loc"], "left").withColumn("local", F.coalesce("__l", F.lit(False))).drop("__l")


def popularity(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("item_id").agg(F.count("*").alias("chosen"))


def centroids(pairs: DataFrame, items: DataFrame, regions: DataFrame) -> DataFrame:
    """``(loc, lat, lon)``: coordinate-wise medians of a location's items; of a region, of the items chosen there, once a choice."""
    own = items.groupBy("loc").agg(F.median("lat").alias("lat"), F.median("lon").alias("lon"))
    chosen = pairs.select("item_id", "loc").join(regions, "loc", "left_semi").join(items.select("item_id", "lat", "lon"), "item_id")
    return own.unionByName(chosen.groupBy("loc").agg(F.median("lat").alias("lat"), F.median("lon").alias("lon")))


def location_probability(pairs: DataFrame, items: DataFrame, alpha: float = ALPHA, places: int = PLACES) -> DataFrame:
    """``(loc, item_loc, p_loc)``: smoothed share of a search location's choices that an item location has."""
    at = pairs.select("item_id", "loc").join(items.select("item_id", F.col("loc").alias("item_loc")), "item_id")
    counts = at.groupBy("loc", "item_loc").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("loc"))
    return counts.select("loc", "item_loc", ((F.col("n") + F.lit(alpha)) / (total + F.lit(places))).alias("p_loc"))
