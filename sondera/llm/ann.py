"""Approximate nearest neighbours over balanced posting lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, cut, finite, hash_sample
from .topk import _matrix, best_of


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the rows that the centroids are fitted on and ``max_lists`` the centroids, whatever the table's size.

    A vector goes to its nearest list and to up to ``replicas`` - 1 more whose centroid is no farther than ``boundary`` times the
    nearest's distance. A query looks into the up to ``probes`` lists whose centroid is within ``ratio`` times the nearest's
    distance. A list of more than ``block_rows`` rows is stored in several blocks.
    """

    sample: int = 20_000
    rows_a_list: int = 256
    max_lists: int = 4096
    replicas: int = 4
    boundary: float = 1.15
    probes: int = 48
    ratio: float = 1.6
    beam: int = 96
    degree: int = 16
    block_rows: int = 512
    seed: int = 42


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)[None, :], 0.0)


def fit_centroids(sample: np.ndarray, lists: int, seed: int, turns: int = 12) -> np.ndarray:
    """Balanced k-means: a centroid that holds over twice its share is split with one that holds least."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    if len(distinct) <= lists:
        return distinct
    centroids = distinct[rng.choice(len(distinct), lists, replace=False)]
    for turn in range(turns):
        label = _distances(distinct, centroids).argmin(1)
        counts = np.bincount(label, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, label, distinct)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
        if turn < turns - 2:
            heavy = np.flatnonzero(counts > 2 * len(distinct) / lists)
            heavy = heavy[np.argsort(-counts[heavy])]
            light = np.argsort(counts)[: len(heavy)]
            for h, weak in zip(heavy, light, strict=False):
                if counts[weak] < counts[h] / 4:
                    centroids[weak] = distinct[rng.choice(np.flatnonzero(label == h))]
    return centroids


def neighbour_graph(centroids: np.ndarray, degree: int, seed: int) -> np.ndarray:
    """For each centroid its nearest centroids and, so that the graph hangs together, a few others."""
    n = len(centroids)
    rng = np.random.default_rng(seed)
    near = min(degree, n - 1)
    if near <= 0:
        return np.zeros((n, 1), dtype=np.int64)
    out = np.empty((n, near), dtype=np.int64)
    for low in range(0, n, 1024):
        d = _distances(centroids[low : low + 1024], centroids)
        d[np.arange(len(d)), low + np.arange(len(d))] = np.inf
        out[low : low + 1024] = np.argpartition(d, near - 1, axis=1)[:, :near]
    ring = (np.arange(n) + 1) % n
    return np.concatenate([out, ring[:, None], rng.integers(0, n, (n, 4))], axis=1)


def graph_search(points: np.ndarray, centroids: np.ndarray, graph: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroids that a best-first walk over ``graph`` finds for each point: numbers and squared distances.

    All points walk at once. Each turn opens the nearest centroids not yet opened and keeps the ``beam`` nearest seen; the walk
    ends when no point has an unopened centroid among them. Where the graph is no larger than the beam, all are looked at.
    """
    n, m = len(points), len(centroids)
    beam = min(beam, m)
    if m <= beam:
        d = _distances(points, centroids)
        order = np.argsort(d, axis=1, kind="stable")
        return order, np.take_along_axis(d, order, 1)
    norms = (centroids * centroids).sum(1)
    own = (points * points).sum(1)
    starts = np.unique(np.linspace(0, m - 1, beam).astype(np.int64))
    seen = np.zeros((n, m), dtype=bool)
    seen[:, starts] = True
    ids = np.broadcast_to(starts, (n, len(starts))).copy()
    dist = _distances(points, centroids[starts])
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    opened = np.zeros(ids.shape, dtype=bool)
    width = 4
    while True:
        rank = np.cumsum(~opened, axis=1)
        pick = ~opened & (rank <= width)
        live = pick.any(1)
        if not live.any():
            return ids, dist
        opened |= pick
        rows, cols = np.nonzero(pick)
        to_rows = np.repeat(rows, graph.shape[1])
        to = graph[ids[rows, cols]].ravel()
        fresh = ~seen[to_rows, to]
        pairs = np.unique(to_rows[fresh] * m + to[fresh])
        to_rows, to = pairs // m, pairs % m
        seen[to_rows, to] = True
        d = np.maximum(own[to_rows] - 2.0 * np.einsum("ij,ij->i", points[to_rows], centroids[to]) + norms[to], 0.0)
        count = np.bincount(to_rows, minlength=n)
        wide = int(count.max()) if len(count) else 0
        if not wide:
            continue
        slot = np.arange(len(to)) - np.repeat(np.cumsum(count) - count, count)
        new_ids, new_d, new_o = np.zeros((n, wide), dtype=np.int64), np.full((n, wide), np.inf), np.ones((n, wide), dtype=bool)
        new_ids[to_rows, slot], new_d[to_rows, slot], new_o[to_rows, slot] = to, d, False
        ids, dist, opened = np.concatenate([ids, new_ids], 1), np.concatenate([dist, new_d], 1), np.concatenate([opened, new_o], 1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        ids, dist, opened = (np.take_along_axis(x, order, 1) for x in (ids, dist, opened))


def _augment(v: np.ndarray, largest: float) -> np.ndarray:
    """One more component that gives all rows the same length, so that least distance is largest inner product."""
    return np.concatenate([v, np.sqrt(np.maximum(largest**2 - (v * v).sum(1), 0.0))[:, None]], axis=1)


@dataclass(frozen=True)
class Index:
    """``postings(list, vec_id, v)``, stored; the centroids and their graph, of bounded size; and the lists' sizes."""

    postings: DataFrame
    centroids: np.ndarray
    graph: np.ndarray
    sizes: dict[int, int]
    dim: int
    scale: float
    settings: Settings


def _usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding")
    kept = vectors.where(F.col("vec_id").isNotNull() & finite(v)).where(F.exists("embedding", lambda x: x != 0))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))


def build(vectors: DataFrame, settings: Settings = Settings()) -> Index | None:  # noqa: B008
    """Index every usable row of ``vectors(vec_id, embedding)``; None if there is none.

    Null, zero, empty and non-finite vectors and rows without vec_id are left out. All vectors must have one length, the most
    frequent one; others are left out too (products between different lengths are not defined).
    """
    rows = _usable(vectors)
    longest = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    stats = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(longest).alias("largest")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not stats:
        return None
    dim, n, largest = int(stats[0]["dim"]), int(stats[0]["n"]), float(stats[0]["largest"])
    rows = rows.where(F.size("v") == dim)
    s = settings
    drawn = hash_sample(rows, "vec_id", s.seed, s.sample).select("v").toPandas()["v"]
    sample = _augment(np.array(drawn.tolist(), dtype=np.float64), largest)
    lists = max(1, min(s.max_lists, n // s.rows_a_list, len(sample) // 4))
    centroids = fit_centroids(sample, lists, s.seed)
    graph = neighbour_graph(centroids, s.degree, s.seed)

    def place(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                v = _matrix(part.column(1))[0].reshape(-1, dim)
                ids, d = graph_search(_augment(v, largest), centroids, graph, 32)
                near = np.sqrt(d[:, : s.replicas]) <= np.sqrt(d[:, :1]) * s.boundary
                near[:, 0] = True
                i, j = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i, j].astype("int32")), part.column(0).take(pa.array(i)), part.column(1).take(pa.array(i))], names=["list", "vec_id", "v"])

    postings = cut(rows.mapInArrow(place, "list int, vec_id long, v array<double>"))
    sizes = {r["list"]: r["n"] for r in postings.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most max_lists rows
    return Index(postings, centroids, graph, sizes, dim, largest, s)


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of largest inner product found for ``queries(vec_id, embedding)``.

    Rows with the query's vec_id are not its candidates; ties go to the smaller vec_id; a vec_id counts once a query, with its
    highest product. Queries of another length than the index find nothing.
    """
    s, dim, largest = index.settings, index.dim, index.scale
    centroids, graph, counted = index.centroids, index.graph, index.sizes
    blocks = {at: -(-n // s.block_rows) for at, n in index.sizes.items()}

    def probe(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = np.zeros(len(centroids), dtype=np.int64)
        held = np.zeros(len(centroids), dtype=np.int64)
        for at, b in blocks.items():
            many[at], held[at] = b, counted[at]
        for batch in batches(source):
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                v = _matrix(part.column(1))[0].reshape(-1, dim)
                # a query has no extra component; dividing by its length changes no order and makes distances comparable
                unit = v / np.sqrt((v * v).sum(1))[:, None] * largest
                ids, d = graph_search(np.concatenate([unit, np.zeros((len(v), 1))], axis=1), centroids, graph, s.beam)
                ids, d = ids[:, : s.probes], d[:, : s.probes]
                # lists beyond the ratio are left out, but not before those chosen hold enough rows
                enough = np.cumsum(held[ids], axis=1) - held[ids] >= 8 * s.replicas * k
                i, j = np.nonzero((np.sqrt(d) <= np.sqrt(d[:, :1]) * s.ratio) | ~enough)
                at = ids[i, j]
                times = many[at]
                i, at = np.repeat(i, times), np.repeat(at, times)
                block = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype("int32")), pa.array(block.astype("int64")), part.column(0).take(pa.array(i)), part.column(1).take(pa.array(i))], names=["list", "block", "vec_id", "v"])

    asked = _usable(queries).where(F.size("v") == dim).mapInArrow(probe, "list int, block long, vec_id long, v array<double>")
    sizes = queries.sparkSession.createDataFrame(sorted(blocks.items()), "list int, blocks int")
    stored = index.postings.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks").cast("long")).alias("block"), "vec_id", "v")

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q_ids, c_ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        order = np.argsort(c_ids, kind="stable")
        c = _matrix(right["v"])[0].reshape(-1, dim)[order]
        q, c_ids = _matrix(left["v"])[0].reshape(-1, dim), c_ids[order]
        parts = []
        for low in range(0, len(q) if len(c) else 0, 256):
            # einsum adds in the same order for every pair, so equal vectors have equal scores
            scores = np.einsum("ij,kj->ik", q[low : low + 256], c)
            i, j = _best(scores, c_ids, q_ids[low : low + 256], k)
            parts.append(pd.DataFrame({"query_id": q_ids[low : low + 256][i], "vec_id": c_ids[j], "score": scores[i, j]}))
        out = pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return pa.table({"query_id": pa.array(out["query_id"].astype("int64")), "vec_id": pa.array(out["vec_id"].astype("int64")), "score": pa.array(out["score"].astype("float64"))})

    found = asked.groupBy("list", "block").cogroup(stored.groupBy("list", "block")).applyInArrow(scan, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    allowed = own[:, None] != ids[None, :]
    if scores.shape[1] <= k:
        return np.nonzero(allowed)
    masked = np.where(allowed, scores, -np.inf)
    least = np.partition(masked, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k][:, None]
    above = masked > least
    level = (masked == least) & allowed
    return np.nonzero(above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True))))


def ann_search(vectors: DataFrame, is_query: Column, k: int, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Index all of ``vectors(vec_id, embedding)`` and search for its rows where ``is_query`` holds. Empty without usable rows."""
    index = build(vectors.select("vec_id", "embedding"), settings)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, vectors.where(is_query).select("vec_id", "embedding"), k)


__all__ = ["Index", "Settings", "ann_search", "best_of", "build", "search"]
