"""Stages leave the driver's memory as they found it, as far as they can."""

import re
from pathlib import Path

import corpus_pipeline
from sondera.llm import queries
from sondera.llm.common import give_back


def test_driver_gives_memory_back(spark):
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    held = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())))
    spark.range(2_000_000).selectExpr("repeat(cast(id as string), 5) as x").distinct().count()
    before = held()
    assert give_back(spark) and held() < before


def test_every_stage_gives_back_before_and_after(monkeypatch):
    said = []
    monkeypatch.setattr(corpus_pipeline, "give_back", lambda spark: said.append("back"))
    stage = corpus_pipeline.lean(lambda spark, docs, sf_dir: said.append("stage") or docs)
    assert stage("spark", "docs", "sf") == "docs" and said == ["back", "stage", "back"]
    assert all(hasattr(f, "__wrapped__") for _, f in corpus_pipeline.STAGES)


def test_executors_give_memory_back_too(spark):
    sc = spark.sparkContext
    sc.setJobGroup("gives-back", "")
    try:
        collections = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
        before = collections()
        assert give_back(spark) and collections() - before > sc.defaultParallelism  # one of the driver's own, the others by tasks
        jobs = sc.statusTracker().getJobIdsForGroup("gives-back")
        assert jobs and sc.statusTracker().getStageInfo(sc.statusTracker().getJobInfo(jobs[0]).stageIds[0]).numTasks == sc.defaultParallelism
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_bpe_takes_texts_in_small_batches(spark, data, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(key), []
    monkeypatch.setattr(queries, "cut", lambda df, own=queries.cut: seen.append(int(spark.conf.get(key))) or own(df))
    out = queries.op3_byte_bpe(spark, data)
    assert seen == [queries.BATCH_ROWS] and spark.conf.get(key) == before
    assert out.count() == spark.read.parquet(f"{data}/documents.parquet").count()
