"""The corpus queries against brute force and SQL, on whole small tables."""

import hashlib
import zlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from sondera.llm import queries as Q
from sondera.llm.langid import UNKNOWN

from ..conftest import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, data, duck, name):
    assert rows_of(Q.queries()[name](spark, data)) == rows_of_sql(duck, Q.oracle_sql()[name])


def documents(spark, data):
    return {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def test_bpe_matches_the_library(spark, data):
    ranks, pattern = Q.tokenizer()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    docs = documents(spark, data)
    rows = Q.op3_byte_bpe(spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id].text
        ids = own.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_ann_recall_and_scores(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    got = {}
    for r in Q.op8_ann_search(spark, data).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    found = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[i]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:20]
        mine = sorted(got[ids[i]])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(abs(m[2] - float(x[list(ids).index(m[1])] @ x[i])) < 1e-9 for m in mine)
        found += len({ids[j] for j in order} & {m[1] for m in mine})
        total += 20
    assert found / total >= 0.9


def test_language_held_out_accuracy(spark, data):
    docs = documents(spark, data)
    rows = Q.op6_language_id(spark, data).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != UNKNOWN]
    assert sum(docs[r.doc_id].lang == r.lang_pred for r in held) / len(held) >= 0.95


def test_quality_agrees_with_labels(spark, data):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in Q.op10_quality_classifier(spark, data).collect()}
    good = [rows[d].keep for d, q in labels.items() if q == 1]
    bad = [rows[d].keep for d, q in labels.items() if q == 0]
    assert np.mean(good) >= 0.98 and (not bad or np.mean(bad) <= 0.4)


def test_quality_on_labels_that_were_held_out(spark, data):
    from sondera.llm import quality

    larger = data.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    own = labels.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    scored = quality.score(docs, quality.fit(docs, own.where("not held")))
    rows = scored.join(own.where("held"), "doc_id").select("quality", "__quality").collect()
    good = [r["__quality"] >= quality.THRESHOLD for r in rows if r.quality == 1]
    bad = [r["__quality"] >= quality.THRESHOLD for r in rows if r.quality == 0]
    assert len(good) > 80 and len(bad) > 5
    assert np.mean(good) >= 0.95 and np.mean(bad) <= 0.5


def test_pipeline_stages(spark, data, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{data}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, data).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        left = [r.doc_id for r in after.select("doc_id").collect()]
        assert set(left) <= ids and len(left) == len(set(left))
        if k == 3:
            assert set(left) == ids
        if k < 4:
            assert after.columns == docs.columns
        ids, docs = set(left), after
    assert {"doc_id", "ids", "n_tokens"} <= set(docs.columns)


def test_pipeline_result_is_in_the_order_of_the_mixture(spark, data):
    import corpus_pipeline as P
    from sondera.llm import mixing

    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))
    docs = docs.union(odd).union(docs.limit(1)).repartition(7)
    got = P.byte_bpe(spark, docs, data)
    want = sorted((r["__slot"], r["__place"], r.doc_id) for r in mixing.mix(docs).collect() if r.doc_id is not None)
    rows = got.collect()
    assert sorted((r.slot, r.place, r.doc_id) for r in rows if r.doc_id is not None) == want
    assert len(rows) == docs.count() == len({(r.slot, r.place) for r in rows})
    assert [(r.slot, r.place) for r in rows] == sorted((r.slot, r.place) for r in rows)


def test_pipeline_run_returns_that_order(spark, data, monkeypatch):
    import corpus_pipeline as P

    monkeypatch.setattr(P, "STAGES", P.STAGES[3:])
    rows = P.run(spark, data).collect()
    assert len(rows) == len(documents(spark, data))
    assert [(r.slot, r.place) for r in rows] == sorted((r.slot, r.place) for r in rows)
