"""Exact top-k search by tiled matrix products."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ceil_div, finite, parallelism

#: Rows of one block of queries and of one shard of candidates, and lists that one merge joins.
QUERY_BLOCK, SHARD_ROWS, FAN_IN = 4096, 32_768, 32
#: Scores that one tile holds at once.
TILE_SCORES = 2_000_000
#: Whole numbers below this are exact in a double.
EXACT = float(1 << 53)


def _matrix(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one list column as a flat array and their lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows as int64; exact, or OverflowError where one exceeds 64 bits."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], dtype=object) @ np.array([[int(x) for x in row] for row in b], dtype=object).T
    return exact.astype(np.int64)


LOWEST = np.iinfo(np.int64).min


def best_of(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of each row's ``k`` highest allowed scores, ties to the first columns (``ids`` ascend)."""
    if scores.shape[1] > k:
        masked = np.where(allowed, scores, LOWEST)
        least = np.partition(masked, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k][:, None]
        above = masked > least
        level = (masked == least) & allowed
        take = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    else:
        take = allowed
    return np.nonzero(take)


def cell_top(queries: pa.Table, shard: pa.Table, k: int) -> pd.DataFrame:
    """Each query's ``k`` best of one shard, tile by tile; vectors of another length than the query's are no candidates."""
    if not queries.num_rows or not shard.num_rows:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    q_ids, c_ids = queries["id"].to_numpy().astype(np.int64), shard["vec_id"].to_numpy().astype(np.int64)
    (q_flat, q_len), (c_flat, c_len) = _matrix(queries["v"]), _matrix(shard["v"])
    q_at, c_at = np.cumsum(q_len) - q_len, np.cumsum(c_len) - c_len
    parts = []
    for dim in np.intersect1d(q_len, c_len):
        qs, cs = np.flatnonzero(q_len == dim), np.flatnonzero(c_len == dim)
        cs = cs[np.argsort(c_ids[cs], kind="stable")]
        q = q_flat[q_at[qs][:, None] + np.arange(dim)]
        c = c_flat[c_at[cs][:, None] + np.arange(dim)]
        own_q, own_c = q_ids[qs], c_ids[cs]
        width = min(len(cs), 8192)
        height = max(1, TILE_SCORES // width)
        for low in range(0, len(qs), height):
            top = None
            rows = np.arange(low, min(len(qs), low + height))
            for left in range(0, len(cs), width):
                ids = own_c[left : left + width]
                scores = products(q[rows], c[left : left + width])
                i, j = best_of(scores, ids, own_q[rows][:, None] != ids[None, :], k)
                new = pd.DataFrame({"query_id": own_q[rows][i], "vec_id": ids[j], "score": scores[i, j]})
                top = new if top is None else merge_top(pd.concat([top, new]), k)
            if top is not None:
                parts.append(top)
    out = pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    return out.astype("int64")


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def merge_top(lists: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's ``k`` best of several lists."""
    lists = lists.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
    return lists[lists.groupby("query_id").cumcount() < k]


def exact_top_k(vectors: DataFrame, is_query: Column, k: int, scale: int = 1024) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of ``vectors(vec_id, embedding)`` of highest integer product.

    Components become floor(scale * x). Queries are the rows where ``is_query`` holds; every row but those of the query's
    own vec_id is a candidate; ties go to the smaller vec_id; ranks count from 1. Rows whose vec_id or vector is null, or
    whose vector is empty or has null or non-finite components, take no part. A vec_id that repeats is as many
    candidates, and one query (the least of its vectors). Vectors of other lengths than the query's are no candidates.
    An empty table gives an empty result; extra columns are ignored.

    Blocks of queries meet shards of candidates in cells of bounded size; a cell keeps ``k`` rows a query, and lists of
    FAN_IN shards are merged at a time until one is left.
    """
    spark = vectors.sparkSession
    usable = vectors.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")))
    flat = usable.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).alias("v"), is_query.alias("is_query"))
    sizes = flat.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("is_query").cast("int")), F.lit(0)).alias("q")).first()
    blocks = ceil_div(sizes["q"], QUERY_BLOCK)
    shards = max(ceil_div(sizes["n"], SHARD_ROWS), min(2 * parallelism(spark), ceil_div(sizes["n"], 256)))
    asked = flat.where("is_query").groupBy("id").agg(F.min("v").alias("v"))
    asked = asked.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.explode(_numbers(shards)).alias("shard"))
    stored = flat.select(F.col("id").alias("vec_id"), "v", F.explode(_numbers(blocks)).alias("block"), F.pmod(F.xxhash64("id", "v"), F.lit(shards)).alias("shard"))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        top = cell_top(left, right, k)
        shard = key[1].as_py() if hasattr(key[1], "as_py") else key[1]
        return pa.table({"query_id": pa.array(top["query_id"], pa.int64()), "vec_id": pa.array(top["vec_id"], pa.int64()), "score": pa.array(top["score"], pa.int64()), "part": pa.array([shard] * len(top), pa.int64())})

    lists = asked.groupBy("block", "shard").cogroup(stored.groupBy("block", "shard")).applyInArrow(run, "query_id long, vec_id long, score long, part long")
    order = [F.desc("score"), F.asc("vec_id")]
    while shards > FAN_IN:
        shards = ceil_div(shards, FAN_IN)
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN_IN))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).where(F.col("rank") <= k).drop("rank")
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
