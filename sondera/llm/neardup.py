"""Near-duplicate texts of a wanted similarity: fingerprints propose, shingles decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, join_hot, slices
from .components import connected_components
from .simhash import HASHED_AT_ONCE, SKETCH_BITS, set_prints, shingle_hashes, tile_links

#: Bits in which the fingerprints of texts of similarity 0.8 differ at most, but for one in some thousand (see the README's measured recall).
RADIUS = 20


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """``(id, digest, set array<long>)``: the sorted distinct shingle hashes of each row."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            for part in slices(batch, 1, HASHED_AT_ONCE):
                own = [np.unique(shingle_hashes(t.as_py(), words)) for t in part.column(1)]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype("int32"))
                digests = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in own], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), digests, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(own).view("<i8")))], names=["id", "digest", "set"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "id long, digest binary, set array<long>")


def near_duplicate_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, class_id)`` of every row of ``docs(doc_id, text)`` with a doc_id; class_id is the class's smallest doc_id.

    Texts with the same set of ``words``-word shingles, whatever they repeat, are one node. The nodes' fingerprints (of the sets) are compared tile by tile:
    pairs that differ in ``radius`` or fewer bits, whose sets' sizes allow it and whose sketches agree as sets of that similarity
    do (but for three in a hundred thousand) are looked at closely, and linked where the Jaccard similarity of their sets is at least
    ``similarity``. Classes are the connected components. Texts without words are a group. Rows without doc_id are left out; rows
    that share one are one, for which the text of the least digest stands. An empty table gives an empty result.
    """
    found = set_prints(docs.where("doc_id is not null"), words)
    base = cut(found.groupBy("doc_id").agg(F.min(F.struct("digest", "fp", "shingles", "sketch")).alias("s")).select("doc_id", "s.*"))
    # equal sets have equal columns
    nodes = cut(base.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), F.min("fp").alias("fp"), F.min("shingles").alias("shingles"), F.min("sketch").alias("sketch")))
    several = nodes.where("shingles > 0")
    size = F.floor(F.log(F.col("shingles").cast("double")) / F.lit(math.log(1 / similarity)))
    bits = F.floor(F.bit_count("fp") / F.lit(radius + 1))
    # sets of similarity s differ in size by a factor s at most
    offsets = [(i, j) for i in range(0, 2) for j in (-1, 0, 1) if (i, j) >= (0, 0)]
    p = (1 + similarity) / 2
    agree = math.floor(SKETCH_BITS * p - 4 * math.sqrt(SKETCH_BITS * p * (1 - p)))
    digests = nodes.select("id", "digest")

    def alike(links: DataFrame) -> DataFrame:
        """The links whose shingle sets are similar enough."""
        pairs = cut(links.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
        asked = cut(pairs.select(F.col("a").alias("id")).distinct().union(pairs.select(F.col("b").alias("id")).distinct()).distinct().join(digests, "id"))
        texts = docs.join(asked.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        sets = cut(_sets(texts, words).join(asked, ["id", "digest"], "left_semi").dropDuplicates(["id"]).select("id", "set"))
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return cut(both.where(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared)).select(F.col("a").alias("u"), F.col("b").alias("v")))

    # spanning trees of each two tiles first: they join a large group, so that its pairs need not all be looked at
    first = alike(tile_links(several, [size, bits], offsets, radius, "tree", agree=agree))
    joined = connected_components(first).select(F.col("node").alias("id"), "root")
    labels = cut(several.join(joined, "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root"))
    # then every pair of texts not yet in one class
    rest = alike(tile_links(labels, [size, bits], offsets, radius, "all", agree=agree))
    roots = connected_components(first.union(rest))
    named = roots.join(roots.groupBy("root").agg(F.min("node").alias("class_id")), "root").select(F.col("node").alias("id"), "class_id")
    classes = nodes.select("digest", "id", "n").join(named, "id", "left").select("digest", "n", F.coalesce("class_id", "id").alias("class_id"))
    return join_hot(base.select("doc_id", "digest"), classes, "digest").select("doc_id", "class_id")
