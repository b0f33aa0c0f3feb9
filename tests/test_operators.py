"""Operators on small inline tables, with nulls, ties and empty tables."""

import pytest
from pyspark.sql import functions as F

from sondera.operators import candidates as C
from sondera.operators import context, evaluate, fusion, lemmas, lexical, models, prep, split
from sondera.sources import tables


def test_dense_ids_follow_the_order(spark):
    df = spark.range(1000).withColumn("k", F.col("id") * 3)
    got = prep.dense_ids(df, ["k"], F.floor(F.col("k") / 100), "n").orderBy("k").collect()
    assert [r.n for r in got] == list(range(1000))


def test_first_wins_and_empty(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), ("b", 1)], "k string, o int")
    assert sorted((r.k or "", r.o) for r in prep.first_wins(df, ["k"], ["o"]).collect()) == [("", 3), ("a", 1), ("b", 1)]
    assert prep.first_wins(df.limit(0), ["k"], ["o"]).count() == 0


def test_relative_price_masks_null_keys(spark):
    df = spark.createDataFrame([(1, "x", 10.0), (1, "x", 20.0), (1, None, 5.0), (2, "x", None)], "loc int, microcat string, price double")
    got = prep.relative_price(df, "price", ["loc", "microcat"]).collect()
    assert [r.price_rel_med is None for r in sorted(got, key=lambda r: (r.price or 0))] == [True, True, False, False]


def test_allocate(spark):
    cells = spark.createDataFrame([("a", 0, 0, 0.5), ("b", 0, 0, 0.3), ("c", 0, 0, 0.2)], "status string, has_params int, region int, share double")
    assert {r.status: r.quota for r in split.allocate(cells, 7).collect()} == {"a": 4, "b": 2, "c": 1}


def test_zone_keeps_the_row_that_crosses(spark):
    items = spark.createDataFrame([(i, i) for i in range(4)], "item_id long, loc int")
    counts = {0: 50, 1: 30, 2: 15, 3: 5}
    pairs = spark.createDataFrame([(1000, i) for i, n in counts.items() for _ in range(n)], "loc int, item_id long")
    regions = context.region_locations(pairs, items)
    assert sorted(r.item_loc for r in context.zones(pairs, items, regions).collect()) == [0, 1, 2]


def test_local_first_and_ties(spark):
    scored = spark.createDataFrame([("q", 1, 5.0, True), ("q", 2, 9.0, False), ("q", 3, 1.0, True), ("q", 4, 9.0, False)], "query_id string, item_id long, score double, local boolean")
    assert [r.item_id for r in C.top(scored, 3, local_first=True).orderBy("rank").collect()] == [1, 3, 2]
    assert [r.item_id for r in C.top(scored, 2).orderBy("rank").collect()] == [2, 4]


def test_query_terms_share_weight_among_forms(spark):
    q = spark.createDataFrame([(1, [["a", "b"], ["b"], ["zz"]])], "query_id long, forms array<array<string>>")
    known = spark.createDataFrame([("a",), ("b",)], "term string")
    assert {r.term: r.qw for r in lexical.query_terms(q, known, F.col("forms")).collect()} == {"a": 0.5, "b": 1.5}


def test_lemma_variants(spark):
    tokens = spark.createDataFrame([("abc1",), ("стали",), ("роллет",), ("нет",)], "token string")
    words = spark.createDataFrame([("стали", ["сталь", "стать", "сталь", "a", "b"], True), ("роллет", ["ролгод"], False)], "token string, forms array<string>, known boolean")
    got = {r.token: r.variants for r in lemmas.variants(tokens, words).collect()}
    assert got == {"abc1": ["abc1"], "стали": ["сталь", "стать", "a"], "роллет": ["ролгод", "роллет"], "нет": ["нет"]}


def test_pool_counts_sources_and_recall(spark):
    one = spark.createDataFrame([("q", 1, 1.0, 0), ("q", 2, 0.5, 1)], "query_id string, item_id long, score double, rank int")
    two = spark.createDataFrame([("q", 2, 7.0, 0), ("q", 3, 6.0, 1)], "query_id string, item_id long, score double, rank int")
    got = {r.item_id: r for r in fusion.pool({"a": one, "b": two}, {"a": 9, "b": 1}, {"b"}).collect()}
    assert (got[2].n_sources, got[2].r_a, got[1].n_sources, set(got)) == (2, 1, 1, {1, 2}) and "r_b" not in got[1].asDict()
    gold = spark.createDataFrame([("q", [2, 9]), ("r", [])], "query_id string, answers array<long>")
    assert [(r.k, r.recall, r.queries) for r in evaluate.recall_at(one, gold, [1, 2]).orderBy("k").collect()] == [(1, 0.0, 1), (2, 0.5, 1)]


def test_check_answers(spark):
    queries = spark.createDataFrame([("q",), ("r",), ("s",)], "query_id string")
    items = spark.createDataFrame([("a" * 16,), ("b" * 16,)], "item_id string")
    answers = spark.createDataFrame([("q", "a" * 16 + " " + "b" * 16), ("r", "a" * 16 + "  " + "a" * 16), ("t", "xyz")], "query_id string, answer string")
    got = {(r.query_id, r.problem) for r in evaluate.check_answers(answers, queries, items).collect()}
    assert got == {("r", "spacing"), ("r", "repeated item"), ("s", "missing query"), ("t", "unknown query"), ("t", "malformed item"), ("t", "unknown item")}


def test_ring_skips_local_and_far(spark):
    items = spark.createDataFrame([(1, 1, "x", 0.0, 0.0), (2, 2, "x", 0.5, 0.0), (3, 3, "x", 5.0, 0.0), (4, 4, "x", None, None)], "item_id long, loc int, category string, lat double, lon double")
    q = spark.createDataFrame([("q", 1, "x"), ("w", 9, "x")], "query_id string, loc int, cat string")
    centroid = spark.createDataFrame([(1, 0.0, 0.0)], "loc int, lat double, lon double")
    local = context.local_pairs(q, spark.createDataFrame([], "loc int, item_loc int"))
    assert [(r.query_id, r.item_id) for r in C.ring(q, centroid, items, local).collect()] == [("q", 2)]


@pytest.mark.parametrize("part", ["val", "rank"])
def test_candidate_tables(spark, tmp_path, part):
    one = spark.createDataFrame([("q", "i", 1.0, 0)], "query_id string, item_id string, score double, rank int")
    tables.save_candidates(one, str(tmp_path / "c"), "bm25", part)
    tables.save_candidates(one, str(tmp_path / "c"), "dense", part)
    assert tables.load_candidates(spark, str(tmp_path / "c"), part).count() == 2
    assert tables.load_candidates(spark, str(tmp_path / "c"), part, "dense").count() == 1


def test_answer_file_and_cache(spark, tmp_path):
    a = spark.createDataFrame([("q1", "a b"), ("q2", "")], "query_id string, answer string")
    tables.write_answer(a, str(tmp_path / "a"))
    assert {(r.query_id, r.answer) for r in tables.read_answer(spark, str(tmp_path / "a")).collect()} == {("q1", "a b"), ("q2", "")}
    compute = lambda x: x.select("k", (F.col("k") * 2).alias("v"))
    tables.update_cache(spark.createDataFrame([(1,), (2,)], "k int"), str(tmp_path / "m"), "k", compute)
    got = tables.update_cache(spark.createDataFrame([(2,), (3,)], "k int"), str(tmp_path / "m"), "k", compute)
    assert sorted(r.v for r in got.collect()) == [4, 6] and spark.read.parquet(str(tmp_path / "m")).count() == 3
    rows = spark.createDataFrame([("m", 1.0)], "model string, recall double")
    tables.append_metrics(rows, str(tmp_path / "s"), ["model"])
    tables.append_metrics(rows, str(tmp_path / "s"), ["model"])
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1


def test_typed_scan(spark, tmp_path):
    spark.sql("select cast(1.50 as decimal(9,2)) d, cast(null as string) t, 'x' n, double('NaN') f").write.parquet(str(tmp_path / "t"))
    assert tables.typed_scan(spark, str(tmp_path / "t"), ["d", "t", "n", "f"], ["t"], ["n", "f"]).first().asDict() == {"d": 1.5, "t": "", "n": None, "f": None}


def test_streaming_popularity(spark, tmp_path):
    from sondera.streaming import popularity

    spark.sql("select timestamp_ntz'2024-01-01 01:00:00' ts, 1L user_id, 'view' event_type union all select timestamp_ntz'2024-01-01 02:00:00', 2L, 'view'").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp_ntz, user_id long, event_type string").parquet(str(tmp_path / "e"))
    q = popularity.windowed_popularity(stream).writeStream.format("memory").queryName("pop").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.event_type, r.n, r.users) for r in spark.sql("select * from pop").collect()] == [("view", 2, 2)]


def test_every_location_is_local_to_a_search_of_the_whole_country(spark):
    scored = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 6)], "query_id long, item_loc int")
    local = spark.createDataFrame([(1, 5)], "query_id long, item_loc int")
    everywhere = spark.createDataFrame([(2,)], "query_id long")
    got = {(r.query_id, r.item_loc): r.local for r in context.mark_local(scored, local, everywhere).collect()}
    assert got == {(1, 5): True, (1, 6): False, (2, 5): True, (2, 6): True}


def test_class_probabilities_replace_one_part(spark, tmp_path):
    path, schema = str(tmp_path / "p"), "query_id long, microcat string, p double"
    tables.save_class_probabilities(spark.createDataFrame([(1, "a", 0.25), (2, None, 0.5)], schema), path, "val")
    tables.save_class_probabilities(spark.createDataFrame([(3, "b", 1.0)], schema), path, "test")
    tables.save_class_probabilities(spark.createDataFrame([(1, "a", 0.75)], schema), path, "val")
    got = [sorted(map(tuple, tables.load_class_probabilities(spark, path, part).collect())) for part in ("val", "test", "none")]
    assert got == [[(1, "a", 0.75)], [(3, "b", 1.0)], []]


def test_embeddings_are_made_once_for_each_setting(spark, tmp_path):
    asked = []

    def encode(rows):
        asked.append(sorted(r.text for r in rows.collect()))
        return rows.select("digest", F.array(F.length("text").cast("double")).alias("vector"))

    def cached(words, prefix):
        texts = spark.createDataFrame([(w,) for w in words], "text string")
        return sorted(map(tuple, tables.cached_embeddings(texts, str(tmp_path / "e"), "m", prefix, 64, encode).collect()))

    assert cached(["a", "bb", "a", None], "q: ") == [("a", [4.0]), ("bb", [5.0])]
    assert cached(["bb", "ccc"], "q: ") == [("bb", [5.0]), ("ccc", [6.0])]
    assert cached(["bb"], "") == [("bb", [2.0])]
    assert asked == [["q: a", "q: bb"], ["q: ccc"], ["bb"]]


def test_a_model_read_again_gives_the_same_scores(spark, tmp_path):
    table = spark.createDataFrame([(q, i, float(i % 3 == 0), float(i % 3)) for q in range(20) for i in range(6)], "query_id long, item_id long, label double, x double")
    model = models.train_ranker(table, rounds=2)
    for _ in range(2):  # the second replaces the first
        tables.save_model(model, str(tmp_path / "m"))
    scores = [sorted(map(tuple, models.rank(m, table).collect())) for m in (model, tables.load_model(str(tmp_path / "m")))]
    assert scores[0] == scores[1] and len(scores[0]) == 120


def test_unknown_values_are_not_eligible(spark):
    items = spark.createDataFrame([(1, 114, 0), (2, 114, 1), (3, 114, None), (4, None, 0)], "item_id long, category int, delivery int")
    assert [r.item_id for r in split.eligible(items, {"category": 114, "delivery": 0}).collect()] == [1]
    assert split.eligible(items, {}).count() == 4
