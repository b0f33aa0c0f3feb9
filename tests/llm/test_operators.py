"""The corpus operators on inline tables: nulls, empty texts, ties, repeated rows, empty tables, extra columns."""

import random
import re
import time

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from sondera.llm import ann, bpe, components, langid, licenses, linededup, mixing, neardup, pii, quality, simhash, topk
from sondera.llm.queries import tokenizer

DOCS = "doc_id long, text string, lang string, source string, score double, fingerprint string, label string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0.5, "x", "y") for i, t, lang, s in rows], DOCS)


ODD = [(1, None, None, None), (2, "", "en", "a"), (3, "one", "en", "a"), (3, "one", "en", "a"), (None, "no id\nat all", None, "b"), (5, "é\U0001f600 中 \x00 tab\t", "fr", None), (6, "long " * 30_000, "en", "a"), (7, "x" * 5000, "en", "a")]


# ---- line dedup ----

LINES = [f"line number {i} of the passage with words of its own" for i in range(40)]


def test_repeated_chunks_go_but_the_first(spark):
    a = "\n".join(LINES)
    b = "\n".join(["another start", *LINES, "another end"])
    got = {r.doc_id: r for r in linededup.line_dedup(docs_of(spark, [(2, b, "en", "s"), (1, a, "en", "s"), (3, a, "en", "s")])).collect()}
    assert got[1].text == a and got[1]["__chunks_cut"] == 0
    assert got[3].text == ""
    assert got[2]["__lines_cut"] >= 30 and got[2].text.startswith("another start")


def test_boundaries_depend_on_the_lines_around_them_alone():
    plain = linededup.chunk_ends(LINES)
    for before in range(7):
        moved = linededup.chunk_ends([f"other {k}" for k in range(before)] + LINES + ["end"])
        inside = {e + before for e in plain if 3 <= e <= len(LINES) - 2}
        assert inside == {e for e in moved if before + 3 <= e <= before + len(LINES) - 2}
    assert all(b - a >= 2 for a, b in zip([0, *plain], plain))


@pytest.mark.parametrize(("size", "least"), [(6, 0.2), (12, 0.5), (40, 0.85)])
def test_share_of_a_copied_passage_that_goes(spark, size, least):
    rows, rng = [], random.Random(size)
    line = lambda: " ".join(str(rng.random()) for _ in range(5))
    for k in range(60):
        passage = [line() for _ in range(size)]
        rows += [(2 * k + j, "\n".join([line() for _ in range(rng.randrange(1, 9))] + passage + [line() for _ in range(rng.randrange(1, 9))])) for j in (0, 1)]
    got = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.sum("__lines_cut")).first()[0]
    assert least <= got / (60 * size) <= 1


def test_long_lines_that_repeat_go_but_the_first(spark):
    passage = " ".join(f"word{i}" for i in range(51))
    rows = [(1, f"a\n{passage}\nb"), (2, f"c\nd\n{passage}"), (3, passage), (4, " ".join(passage.split()[:49]) + "\nshort"), (5, "z\n" + " ".join(passage.split()[:49]))]
    got = {r.doc_id: r.text for r in linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "c\nd", 3: "", 4: rows[3][1], 5: rows[4][1]}


def test_line_dedup_against_a_table_of_all_chunks(spark):
    rng = random.Random(11)
    lines = [f"line {i}" for i in range(25)] + [" ".join([f"long{i}"] * 55) for i in range(3)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 14)))) for i in range(150)]
    seen, want = set(), {}
    for i, text in rows:
        own, kept, first = text.split("\n"), [], 0
        for end in linededup.chunk_ends(own):
            chunk = tuple(own[first:end])
            counts = len(chunk) > 1 or len(chunk[0].split()) >= linededup.LONG_WORDS
            kept += [] if counts and chunk in seen else chunk
            seen |= {chunk} if counts else set()
            first = end
        want[i] = "\n".join(kept)
    got = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.text for r in got} == want


def test_line_dedup_odd_rows(spark):
    df = docs_of(spark, ODD)
    got = linededup.line_dedup(df)
    assert got.columns == [*df.columns, "__chunks_cut", "__lines_cut"]
    assert sorted(map(repr, (r[:7] for r in got.collect()))) == sorted(map(repr, (r[:] for r in df.collect())))
    assert linededup.line_dedup(df.limit(0)).count() == 0


# ---- exact top-k ----


def test_top_k_ties_nulls_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [0.25, 0.5]), (2, [0.25, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (7, [None, 1.0]), (8, [2.0, 2.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = [tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") == 0, 2).orderBy("rank").collect()]
    assert got == [(0, 1, 8, 2048 * 1024 + 2048 * 512), (0, 2, 1, 256 * 1024 + 512 * 512)]
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") == 0, 2).count() == 0


def test_products_stay_exact():
    a, b = np.array([[3e9, 1.0]]), np.array([[3e9, 1.0], [1.0, 7.0]])
    assert topk.products(a, b).tolist() == [[9_000_000_000_000_000_001, 3_000_000_007]]


def test_best_of_prefers_small_ids():
    i, j = topk.best_of(np.array([[5, 7, 5, 5]]), np.arange(4), np.array([[True, True, True, True]]), 2)
    assert (i.tolist(), j.tolist()) == ([0, 0], [0, 1])


# ---- byte-level BPE ----


def test_words_of_any_kind_match_the_library(spark):
    ranks, pattern = tokenizer()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    letters = "abcdefgh THE the  \n\t'llséß中\U0001f600\u0085 ​012٣<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(300)] + [t or "" for _, t, _, _ in ODD] + ["ab" * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = bpe.encode(df, ranks, pattern)
    got = {r.doc_id: r for r in encoded.select("doc_id", "ids", bpe.decode(F.col("ids"), ranks).alias("raw")).collect()}
    for i, t in enumerate(texts):
        assert list(got[i].ids) == own.encode_ordinary(t), t
        assert bytes(got[i].raw) == t.encode()
    assert bpe.encode(df.limit(0), ranks, pattern).count() == 0
    assert bpe.encode(docs_of(spark, ODD), ranks, pattern).count() == len(ODD)


# ---- licences ----

MIT = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + "\n\n".join(licenses.SENTENCES[k][0] for k in ("mit-grant", "mit-notice", "mit-as-is"))


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (MIT, "MIT"), ("Prose.\nReleased under the MIT License.\nMore prose.", "MIT"), ("prose Licensed under CC BY-NC 4.0. and on", ""),
        ("A.\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("x. LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.", "Apache-2.0"),
        ("This work is licensed under\nthe GNU General Public License, version 3.\nReleased under the MIT License.", "GPL-3.0-only,MIT"), ("Licensed under nothing.", ""),
    ],
)
def test_licences(spark, text, found):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert licenses.license_scan(df).first().licenses == found


def test_licence_rules_take_the_longest_sequence(spark):
    df = spark.createDataFrame([(1, MIT)], "doc_id long, text string")
    assert licenses.license_scan(df).first().n_matches == 1
    assert licenses.license_scan(docs_of(spark, ODD)).where("n_matches > 0").count() == 0
    assert licenses.license_scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("before", ["", "# ", " * ", "// "])
def test_every_known_text_is_found_in_itself(spark, before):
    commented = lambda text: "\n".join(before + line for line in text.split("\n"))
    own = [(name, v) for name, variants in licenses.SENTENCES.items() for v in variants]
    df = spark.createDataFrame([(i, commented(f"Some prose\n\n{v}\n\nMore prose")) for i, (_, v) in enumerate(own)], "doc_id long, text string")
    sign = licenses.signs()
    got = {r.doc_id: r.signs for r in licenses.signed_texts(df).collect()}
    assert [own[i] for i in got if sign[own[i][0]] not in got[i]] == []


def test_every_rule_is_found_in_its_own_text(spark):
    texts = []
    for _, sequence in licenses.RULES:
        seen = dict.fromkeys(sequence, 0)
        for name in sequence:  # a name that a rule repeats stands for its variants in turn
            texts.append(licenses.SENTENCES[name][min(seen[name], len(licenses.SENTENCES[name]) - 1)])
            seen[name] += 1
    at = iter(texts)
    df = spark.createDataFrame([(i, "\n\n".join(next(at) for _ in sequence)) for i, (_, sequence) in enumerate(licenses.RULES)], "doc_id long, text string")
    got = {r.doc_id: (r.matches, r.n_matches) for r in licenses.license_scan(df).collect()}
    assert [(name, got[i]) for i, (name, _) in enumerate(licenses.RULES) if got[i] != (name, 1)] == []


@pytest.mark.parametrize(
    ("text", "found", "first"),
    [
        ("x = 1\n// SPDX-License-Identifier: MIT\nint y;", "MIT", 2), ("/* SPDX-License-Identifier: GPL-2.0-only */", "GPL-2.0-only", 1),
        ("# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy", "MPL-2.0", 1),
        ("# This Source Code Form is subject to the\n# terms of the Mozilla Public License, v. 2.0. If a copy", "MPL-2.0", 1),
        ("# Permission is hereby granted\n# MIT\n# nothing", "", 0), (licenses.SENTENCES["mit-title"][0] + "\nMIT\n" + licenses.SENTENCES["mit-grant"][0], "MIT", 1),
    ],
)
def test_split_and_commented_licences(spark, text, found, first):
    row = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.matches, row.first_sentence) == (found, first)


# ---- personal data ----


@pytest.fixture(scope="module")
def network():
    return pii.train()


def test_base_spans_match_the_patterns():
    rng = random.Random(3)
    pieces = ["a.b@c.d-e.f", "x@y", "@@", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+12", " ", "z", "9" * 25, "a@b.c@d.e", "%", "\n"]
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(8))
        want = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        assert [s for s in pii.base_spans(text) if s[0] == 0] == want, text


def test_base_spans_of_every_kind_match_the_patterns():
    rng = random.Random(6)
    pieces = ["a.b@c.d", "@", "1.2.3.4", "256.1.1.1", "0001.2.3.255", ".5", "7", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+49", " ", "-", "é", "9" * 25, "x", "\n", "٣", "²"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(9))
        want = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        want += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            own = [int(c) for c in m[0] if c in "0123456789"]
            total = sum(own[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in own[-2::-2])
            want += [(2, m.start(), m.end())] * (13 <= len(own) <= 19 and total % 10 == 0)
        want += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
        assert sorted(pii.base_spans(text)) == sorted(want), text


def test_a_long_run_of_digits_is_read_once():
    began = time.time()
    assert pii.base_spans("1" * 1_000_000) == [] and pii.base_spans("1." * 3 + "2" * 300_000) == []
    assert time.time() - began < 5


def test_network_finds_what_patterns_miss(network):
    x, y = pii.labelled_windows(200, seed=9)
    tags, _ = network.decode(x)
    assert (tags == y).mean() >= 0.94
    text = 'Then the thing token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and more 1999 of it'
    (base, added), = pii.find([text], network)
    assert base == [] and [text[s:e] for k, s, e in added if pii.KINDS[k] == "secret"]
    (base, added), = pii.find(["only plain words here and nothing else"], network)
    assert base == added == []


def test_long_spans_are_found_at_every_offset(network):
    span = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    filler = "plain words go on here and there without any end to them at all so that " * 4
    texts = [f"{filler[: 96 + k]} {span} and then more of the plain words {filler}" for k in range(pii.STRIDE)]
    got = [[t[s:e] for k, s, e in added if pii.KINDS[k] == "secret"] for t, (_, added) in zip(texts, pii.find(texts, network), strict=True)]
    assert [k for k, g in enumerate(got) if g != [span]] == []


def test_spans_longer_than_a_window_are_decoded_whole():
    class Tagged:  # tags every "a" as one span of secrets
        def decode(self, x):
            own = x == pii.char_classes("a")[0]
            begins = own & ~np.vstack([np.zeros((1, x.shape[1]), bool), own[:-1]])
            return np.where(begins, 9, np.where(own, 10, 0)), np.full(x.shape, 5.0)

    for size in (95, 96, 200, 1000):
        text = "." * 150 + "a" * size + "." * 150
        found = []
        plausible, anchored = pii.plausible, pii._anchored
        pii.plausible, pii._anchored = lambda kind, piece: True, lambda text: list(range(-(-(len(text) - pii.WINDOW) // pii.STRIDE) + 1))
        try:
            found = pii.find([text], Tagged())[0][1]
        finally:
            pii.plausible, pii._anchored = plausible, anchored
        assert found == [(4, 150, 150 + size)]


def test_spelled_out_addresses_without_digits_are_decoded(network):
    before = "only words stand here and then "
    for address in ("jane.doe (at) mail (dot) org", "jane.doe [at] mail [dot] org"):
        assert pii._anchored(before * 10 + address)
    text = before + "anna_smith [at] example [dot] org goes on with more words"
    (_, added), = pii.find([text], network)
    assert [text[s:e] for _, s, e in added] == ["anna_smith [at] example [dot] org"]


def test_gradients(network):
    net = pii.Network.fresh(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = pii.labelled_windows(2, seed=1)
    _, grads = net.learn(x[:12], y[:12])
    for name in ("emb", "uf", "wb", "out", "trans", "start"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        old, h = net.p[name][at], 1e-4
        net.p[name][at] = old + h
        up = net.learn(x[:12], y[:12])[0]
        net.p[name][at] = old - h
        down = net.learn(x[:12], y[:12])[0]
        net.p[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * h), rel=0.05, abs=1e-3)


def test_reconcile_takes_the_best_set():
    assert pii.reconcile([(0, 0, 10, 1.0), (1, 5, 20, 1.0), (0, 20, 25, 3.0), (0, 20, 25, 1.0)]) == [(1, 5, 20), (0, 20, 25)]


def test_pii_odd_rows(spark, network):
    got = pii.digest(pii.pii_spans(docs_of(spark, ODD), network)).collect()
    assert len(got) == len(ODD) and all(r.spans == "" for r in got)
    assert pii.pii_spans(docs_of(spark, ODD).limit(0), network).count() == 0


# ---- language ----


def test_codewords_are_apart():
    for k in (2, 4, 9, 30):
        code = langid.codewords(k)
        distance = (code[:, None] != code[None]).sum(2) + np.eye(k) * 1000
        assert len(code) == k and distance.min() >= 1


def test_numerals_and_signs_are_no_letters(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the house", "en"), ("das haus", "de"), ("²½", None), ("Ⅷ ٣", None), ("12 .,_", None), ("é", None)])]
    got = {r.doc_id: r for r in langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and got[5].lang_pred in ("en", "de")


def test_language_odd_rows(spark):
    got = langid.language_id(docs_of(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2))
    assert langid.language_id(docs_of(spark, ODD).limit(0)).count() == 0
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.language_id(none).first().lang_pred == "und"


# ---- near-duplicates ----


def test_simhash_components(spark):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(500)]
    base = " ".join(rng.choice(words) for _ in range(400))
    rows = [(9, base, "en", "s"), (4, base.upper(), "en", "s"), (7, None, "en", "s"), (8, " \n", "en", "s"), (1, " ".join(rng.choice(words) for _ in range(400)), "en", "s")]
    got = {r.doc_id: r for r in simhash.simhash_near_duplicates(docs_of(spark, rows)).collect()}
    assert {k: r.component_id for k, r in got.items()} == {9: 4, 4: 4, 7: 7, 8: 7, 1: 1}
    assert got[7].fingerprint == "0" * 16
    assert simhash.simhash_near_duplicates(docs_of(spark, ODD)).count() == len(ODD)
    assert simhash.simhash_near_duplicates(docs_of(spark, ODD).limit(0)).count() == 0


def test_tiles_find_every_link(spark):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = [np.uint64(0), *(np.uint64(1) << rng.integers(0, 64, 12, dtype=np.uint64)), *((np.uint64(1) << rng.integers(0, 32, 12, dtype=np.uint64)) | (np.uint64(1) << rng.integers(32, 64, 12, dtype=np.uint64)))]
    fps = np.unique(np.concatenate([seeds ^ f for f in flips]))
    nodes = spark.createDataFrame([(int(x), int(x)) for x in fps.view("i8")], "id long, fp long")
    links = simhash.tile_links(nodes, simhash.quarter_counts(F.col("fp")), simhash.half_ball(4, 2), 2, "all", tile_rows=16)
    got = {frozenset((r.u, r.v)) for r in links.collect()}
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 2, 1))
    assert got == {frozenset((int(fps.view("i8")[a]), int(fps.view("i8")[b]))) for a, b in near}


@pytest.mark.parametrize("one_task", [0, 100, 10_000])
def test_components_of_a_long_chain(spark, one_task):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5), (None, 3)], "u long, v long")
    got = {}
    for r in components.connected_components(edges, one_task).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, got.values())) == [2, 301]
    assert components.connected_components(edges.limit(0)).count() == 0


def test_near_duplicate_classes(spark):
    rng = random.Random(2)
    words = ["w%d" % i for i in range(3000)]
    base = [rng.choice(words) for _ in range(600)]
    near = base[:300] + ["changed"] + base[301:]
    far = base[:300] + [rng.choice(words) for _ in range(300)]
    rows = [(5, " ".join(base), "en", "s"), (3, " ".join(near), "en", "s"), (8, " ".join(far), "en", "s"), (9, " ".join(base), "en", "s"), (None, "x", "en", "s"), (10, None, "en", "s")]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(docs_of(spark, rows)).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 8: 8, 10: 10}


def shingles(text, words=5):
    parts = text.lower().split()
    return {" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(8)
    words = ["w%d" % i for i in range(4000)]
    texts = []
    for _ in range(110):
        base = [rng.choice(words) for _ in range(rng.choice([6, 40, 150, 400]))]
        line = " ".join(rng.choice(words) for _ in range(12))
        texts.append(" ".join(base))
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8, 12])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
        texts += [" ".join(base) + "\n" + "\n".join([line] * n) for n in (3, 25)]  # equal sets, other counts
    sets = [shingles(t) for t in texts]
    by_shingle, pairs = {}, {}
    for i, own in enumerate(sets):
        shared = {}
        for x in own:
            for j in by_shingle.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            by_shingle[x].append(i)
        pairs |= {(j, i): n / (len(own) + len(sets[j]) - n) for j, n in shared.items()}
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = {p: s for p, s in pairs.items() if s >= 0.8}
    for a, b in linked:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(got) == len(texts)
    assert all(find(i) == find(c) for i, c in got.items())  # nothing is joined that exact similarity does not join
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.01)):
        band = [p for p, s in linked.items() if low <= s < high]
        assert len(band) > 100 and np.mean([got[a] == got[b] for a, b in band]) >= 0.99


def test_a_frequent_shingle_joins_nothing(spark):
    filler = " ".join(["the same five words again"] * 200)
    rng = random.Random(4)
    rows = [(i, filler + " " + " ".join(str(rng.random()) for _ in range(300))) for i in range(4)] + [(7, None), (7, "x y z"), (9, "")]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i] for i in range(4)} == {0: 0, 1: 1, 2: 2, 3: 3} and set(got) == {0, 1, 2, 3, 7, 9}
    assert neardup.near_duplicate_classes(docs_of(spark, ODD).limit(0)).count() == 0


# ---- nearest neighbours ----


def test_ann_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [0.5, 0.5]), (5, [0.5, 0.5]), (None, [1.0, 1.0]), (20, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.ann_search(df, F.col("vec_id") % 20 == 0, 20).collect())
    assert got == [(0, 1, 20, 3.0), (0, 2, 4, 0.5), (0, 3, 5, 0.5), (20, 1, 0, 3.0), (20, 2, 4, 2.0), (20, 3, 5, 2.0)]
    assert ann.ann_search(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_graph_search_finds_near_centroids():
    rng = np.random.default_rng(0)
    centroids, points = rng.normal(size=(600, 16)), rng.normal(size=(50, 16))
    ids, _ = ann.graph_search(points, centroids, ann.neighbour_graph(centroids, 16, 0), 64)
    exact = ann._distances(points, centroids).argsort(1)[:, :5]
    assert np.mean([len(set(a[:5]) & set(b)) / 5 for a, b in zip(ids, exact)]) >= 0.9


# ---- mixing ----


def test_schedule_stays_within_a_block(spark):
    quotas = {"a": 500, "b": 301, "c": 150, "d": 49}
    df = spark.createDataFrame([(k, q, 1000) for k, q in quotas.items()], "key string, quota long, slots long")
    rows = mixing.period_schedule(df).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(1000))
    had = dict.fromkeys(quotas, 0)
    for t, r in enumerate(rows):
        assert r.release <= r.slot < r.deadline and r.turn == had[r.key]
        had[r.key] += 1
        assert all(abs(had[k] - q * (t + 1) / 1000) < 1 for k, q in quotas.items())


def test_mix_keeps_every_row(spark):
    rows = [(i, "t", "en", "a" if i % 3 else None) for i in range(500)] + [(None, "t", "en", "b"), (1, "t", "en", "a")]
    df = docs_of(spark, rows)
    got = mixing.mix(df, block_rows=8).collect()
    assert sorted(repr(r[:7]) for r in got) == sorted(repr(r[:]) for r in df.collect())
    assert len({(r["__slot"], r["__place"]) for r in got}) == len(got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_takes_clashing_columns_and_hot_missing_ids(spark):
    names = ("slot", "slots", "quota", "release", "deadline", "key", "turn", "n", "key_", "__at")
    df = spark.createDataFrame([(None if i % 2 else i, "a") for i in range(300)], "doc_id long, source string")
    for name in names:
        df = df.withColumn(name, F.lit("x"))
    got = mixing.mix(df, block_rows=8).collect()
    assert len(got) == 300 == len({(r["__slot"], r["__place"]) for r in got}) and all(r["slot"] == "x" for r in got)


def test_weights(spark):
    sizes = spark.createDataFrame([("sa", 10), ("sb", 10), ("n", 10)], "key string, n long")
    got = {r.key: r.quota for r in mixing.period_quotas(sizes, {"a": 3.0, "b": 1.0}, 0.5, 1000).collect()}
    assert sum(got.values()) == 1000 and got["n"] == 1 and abs(got["sa"] - 749) <= 1


# ---- quality ----


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 0), (3, 1, 0), (None, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    df = docs_of(spark, ODD)
    got = quality.quality(df, labels).collect()
    assert len(got) == len(ODD) and all(r["__quality"] == 1 for r in got)  # labels of one class only
    assert quality.quality(df.limit(0), labels.limit(0)).count() == 0
    two = spark.createDataFrame([(2, 0, 0), (3, 1, 0), (6, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["__quality"] <= 1 for r in quality.quality(df, two).collect())


def test_fold_gives_tokens_that_merges_do_not_reach(spark):
    """A token without a merge that leads to it stands for itself as a whole word only; equal ranks merge from the left."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"aa": 257, b"xyz": 258, b"bab": 259}
    words = ["xyz", "xyzz", "aaa", "aaaa", "bab", "abab", "x", "\u00e9", "ab" * 40]
    rows = spark.createDataFrame([(words,)], "words array<string>").select(bpe.fold_words(F.col("words"), ranks).alias("ids")).first().ids
    assert rows == [bpe.merge_with_heap(w.encode(), ranks) for w in words]
    assert rows[0] == [258] and rows[1] == [120, 121, 122, 122] and rows[2] == [257, 97]


def test_frequent_words_of_a_table_are_folded_once(spark, monkeypatch):
    """Words that come again in every partition are shared, so that no task folds them; 200,000 words are not too many."""
    ranks, pattern = tokenizer()
    spelled = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    text = "".join(f" {spelled(i)}" for i in range(200_000))
    monkeypatch.setattr(bpe, "fold_words", lambda words, _: F.transform(words, lambda w: F.array(F.length(w))))
    shared = bpe.opened("test", lambda: bpe.common_words(spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string"), ranks, pattern))
    assert len(shared) == 200_000 and set(shared) == {f" {spelled(i)}" for i in range(200_000)}
