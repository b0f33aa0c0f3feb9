"""Connected components by contraction, for graphs that fit no single machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut

MAX_ROUNDS = 64
#: Edges (16 bytes each) that one task contracts by itself; larger graphs are contracted by rounds of joins down to that.
ONE_TASK = 500_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """The same map by one task, for a counted number of edges."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches(source)]
        if not parts:
            return
        nodes, ends = np.unique(np.concatenate([np.concatenate(x) for x in zip(*parts, strict=True)]), return_inverse=True)
        i, j = ends.reshape(2, -1)
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            label = label[label]
            if (label == before).all():
                break
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "root"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, root long")


def connected_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """Map every node of ``edges(u long, v long)`` to a representative of its component: ``(node, root)``.

    Each round every root hooks onto its neighbour of least priority (a hash that changes from round to round, so that
    chains of any order shrink by a constant factor), the edges are rewritten to the new roots and loops and repeats go.
    The edges shrink geometrically. Rounds end when no edge is left; the maps of all rounds are then composed. Only one
    row per key goes through each aggregation, so a hub costs no more than another node. Null ends and loops are
    ignored; an empty table gives an empty map. Once no more than ``one_task`` edges are left, one task contracts those.
    """
    e = cut(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct())
    nodes = e.select(F.col("u").alias("node")).union(e.select(F.col("v").alias("node"))).distinct()
    maps: list[DataFrame] = []
    for turn in range(MAX_ROUNDS):
        left = e.count()
        if left <= one_task:
            if left:
                maps.append(_in_one_task(e).select("node", F.col("root").alias("to")))
            break
        priority = lambda c, t=turn: F.struct(F.xxhash64(c, F.lit(t)).alias("h"), F.col(c).alias("n"))
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooked = both.groupBy("u").agg(F.min(priority("v")).alias("best"))
        own = priority("u")
        hooked = cut(hooked.select(F.col("u").alias("node"), F.when(F.col("best") < own, F.col("best.n")).otherwise(F.col("u")).alias("to")))
        maps.append(hooked)
        at_u = hooked.select(F.col("node").alias("u"), F.col("to").alias("to_u"))
        at_v = hooked.select(F.col("node").alias("v"), F.col("to").alias("to_v"))
        e = cut(e.join(at_u, "u").join(at_v, "v").where("to_u <> to_v").select(F.greatest("to_u", "to_v").alias("u"), F.least("to_u", "to_v").alias("v")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    out = nodes.select("node", F.col("node").alias("root"))
    for step in maps:
        out = out.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out
