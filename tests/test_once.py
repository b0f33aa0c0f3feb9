"""Lists are made once for queries that they cannot tell apart, and steps leave no shuffle files."""

import pytest
from pyspark.sql import functions as F

from sondera.operators import candidates as C
from sondera.operators import context, prep
from sondera.plans import registry

QUERIES = "filter_parse item_features label_join place_features pool_full_outer class_features gbt_rank n_sources similar_queries".split()
FAR = 10**9


@pytest.fixture(scope="module")
def made(spark, data):
    return registry._context(spark, data)


@pytest.mark.parametrize("name", QUERIES)
def test_queries_that_are_alike_share_their_lists(spark, data, made, monkeypatch, name):
    kinds = made["asked"].select("qn", "loc", "cat", "filters").distinct().count()
    twice = made["asked"].withColumn("query_id", F.explode(F.array(F.col("query_id"), F.col("query_id") + FAR)))
    monkeypatch.setattr(registry, "_context", lambda *_: made | {"asked": twice, "local": context.local_pairs(twice, made["zone"])})
    seen = []
    for f, at in (("memory_same_place", 1), ("similar_queries", 2)):
        monkeypatch.setattr(C, f, lambda *a, own=getattr(C, f), at=at: seen.append(a[at].count()) or own(*a))
    out = registry.queries()[name](spark, data)
    assert seen and max(seen) <= kinds
    if "query_id" in out.columns:
        rows = sorted(map(repr, out.where(f"query_id < {FAR}").collect()))
        assert rows and rows == sorted(map(repr, out.where(f"query_id >= {FAR}").withColumn("query_id", F.col("query_id") - FAR).collect()))
    else:
        assert all(r.candidates % 2 == 0 for r in out.collect())


def test_settled_leaves_no_shuffle_files(spark):
    kept = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = kept()
    x = prep.settled(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n")))
    assert not kept() - before and x.count() == 10


def test_shortlist_keeps_enough_for_both_kinds_of_query(spark):
    placed = spark.createDataFrame([("a", i, i % 3, "114" if i % 4 == 0 else None if i % 4 == 1 else "x") for i in range(40)], "qn string, item_id long, score int, item_cat string")
    got = sorted(r.item_id for r in C.shortlist(placed, ["qn"], 3).collect())
    order = sorted(placed.collect(), key=lambda r: (-r.score, r.item_id))
    assert got == sorted(r.item_id for own in (True, False) for r in [r for r in order if (r.item_cat == "114") is own][:3])
