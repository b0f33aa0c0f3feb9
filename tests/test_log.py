"""The log's rows do not lie on disk twice, whatever parts its lines have."""

import glob
import os
import shutil

import duckdb
from pyspark.sql import functions as F

from sondera.operators import prep
from sondera.plans import adapters as A
from tests.conftest import TABLES


def test_whole_lines_and_texts_are_never_shuffled_together(spark, data, monkeypatch):
    plans = []
    monkeypatch.setattr(prep, "settled", lambda df, own=prep.settled: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or own(df))
    top = spark.sparkContext._jsc.sc().getCheckpointDir()
    before = set(glob.glob(f"{top.get().split(':', 1)[-1]}/settled-*")) if top.isDefined() else set()
    log = A.pairs(spark, data)
    assert sum("l_shipdate" in p for p in plans) == 1 and not any("l_shipdate" in p and "p_name" in p for p in plans)
    left = set(glob.glob(f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().split(':', 1)[-1]}/settled-*")) - before
    assert {f.rsplit("/", 2)[-2] for f in log.inputFiles()} <= {os.path.basename(x) for x in left} and len(left) == len(plans) - 1  # the numbered lines are gone


def test_release_leaves_other_tables(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/own")
    kept, gone = spark.read.parquet(f"{tmp_path}/own"), prep.settled(spark.range(5))
    prep.release(kept.union(gone))
    assert kept.count() == 3 and os.path.isdir(f"{tmp_path}/own") and not os.path.exists(gone.inputFiles()[0].split(":", 1)[-1])


def test_lines_without_a_part_or_with_several(spark, data, tmp_path):
    for t in TABLES:
        if t not in ("part", "lineitem"):
            os.symlink(f"{data}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    part, lines = spark.read.parquet(f"{data}/part.parquet"), spark.read.parquet(f"{data}/lineitem.parquet")
    twice = part.where("p_partkey = 7").withColumn("p_name", F.lit("another name")).withColumn("p_size", F.lit(3).cast(part.schema["p_size"].dataType))
    none = F.when(F.col("l_orderkey") % 11 != 0, F.col("l_partkey"))
    part.where("p_partkey % 5 <> 0").unionByName(twice).toPandas().to_parquet(f"{tmp_path}/part.parquet")
    lines.withColumn("l_partkey", none).write.parquet(f"{tmp_path}/lines")
    duck = duckdb.connect()
    duck.execute(f"COPY (SELECT * FROM '{tmp_path}/lines/*.parquet') TO '{tmp_path}/lineitem.parquet'")
    shutil.rmtree(f"{tmp_path}/lines")
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    columns = ["row_id", "qn", "loc", "delivery", "filters", "cat", "item_id"]
    got = sorted(tuple(r) for r in A.pairs(spark, str(tmp_path)).select(columns).collect())
    want = sorted(duck.execute(A.sql(f"SELECT {', '.join(columns)} FROM pairs")).fetchall())
    assert [r[0] for r in got] == list(range(len(want))) and len(want) < lines.count()
    # the parts of one key have equal places in the SQL's order: their rows' texts may change places
    assert [r for r in got if r[-1] != 7] == [r for r in want if r[-1] != 7] and any(r[-1] == 7 for r in got)
    assert sorted(r[1:] for r in got) == sorted(r[1:] for r in want)
