"""Long tables are taken in passes, so that their shuffle files never lie on disk all together; the rows are the same."""

import os

import pytest
from pyspark.sql import functions as F

from sondera.operators import prep
from sondera.plans import registry

from .conftest import rows_of, rows_of_sql


@pytest.mark.parametrize("name", ["place_features", "pool_full_outer"])
def test_long_tables_go_in_passes(spark, data, duck, monkeypatch, name):
    monkeypatch.setattr(prep, "PASS_ROWS", 2000)
    written = []
    monkeypatch.setattr(prep, "settled", lambda df, *more, own=prep.settled: written.append((df.columns, 1 + len(more))) or own(df, *more))
    got = rows_of(registry.queries()[name](spark, data))
    several = [columns for columns, n in written if n > 2]
    # the numbered lines, the log with its texts, and what was chosen for each text and place
    assert len(several) == 3 and "copy" in several[0] and "qn" in several[1] and "rank" in several[2]
    assert got == rows_of_sql(duck, registry.oracle_sql()[name])


def test_passes_share_out_every_row_once(spark, monkeypatch):
    x = spark.range(100).withColumn("k", F.when(F.col("id") % 7 != 0, F.col("id") % 10))
    monkeypatch.setattr(prep, "PASS_ROWS", 30)
    shares = [[r for r in x.where(one).collect()] for one in prep.passes(x, "k")]
    assert len(shares) == 4 and sorted(r.id for s in shares for r in s) == list(range(100))
    assert all(not {r.k for r in a} & {r.k for r in b} for i, a in enumerate(shares) for b in shares[:i])
    assert prep.settled(*[x.where(one) for one in prep.passes(x, "k")]).count() == 100
    assert len(prep.passes(x.limit(30), "k")) == 1


def test_settled_tables_are_packed(spark):
    n = 200_000
    place = spark.range(0, n, 1, 1).select((F.col("id") % 50_000).cast("int").alias("__i"), F.when(F.col("id") % 10 != 0, F.col("id") * 7 % n).alias("row_id"), F.concat(F.lit("text "), F.col("id") % 100).alias("qn"), F.array("id").alias("a"))
    kept = prep.settled(place, place.where("__i < 3"))
    files = [f.split(":", 1)[-1].replace("///", "/") for f in kept.select("__i", "row_id", "qn").inputFiles()]
    assert sorted(kept.collect()) == sorted(place.collect() + place.where("__i < 3").collect())
    numbers = prep.settled(place.select("__i", "row_id"))
    size = sum(os.path.getsize(f.split(":", 1)[-1].replace("///", "/")) for f in numbers.inputFiles())
    assert len(files) == 2 and size < 4 * n  # 8 bytes and more of a place and an id, plain
