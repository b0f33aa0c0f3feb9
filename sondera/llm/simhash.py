"""SimHash near-duplicates: exact tiled comparison of fingerprints."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, ceil_div, cut, join_hot, parallelism, slices
from .components import connected_components

#: Rows of one tile, bytes of the tiles that one task compares together, bytes of text hashed and shingles counted at once (the sums by
#: text copy the counted bits as 64-bit numbers, 512 bytes a shingle).
TILE_ROWS, BUNDLE_BYTES = 4096, 16_000_000
HASHED_AT_ONCE, COUNTED_AT_ONCE = 2_000_000, 40_000
SEED = 42


def _bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of shingle hashes; a bit is set where over half of a run has it."""
    out = np.zeros(len(sizes), dtype="<u8")
    ends = np.cumsum(sizes)
    starts = ends - sizes
    filled = np.flatnonzero(sizes)
    at = 0
    while at < len(filled):
        first = starts[filled[at]]
        stop = max(at + 1, int(np.searchsorted(ends[filled], first + COUNTED_AT_ONCE, side="right")))
        rows = filled[at:stop]
        counts = np.zeros((len(rows), 64), dtype=np.int64)
        last = ends[rows[-1]]
        for low in range(first, last, COUNTED_AT_ONCE):  # a single text may have more shingles than that
            part = np.unpackbits(hashes[low : min(last, low + COUNTED_AT_ONCE)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            if len(rows) == 1:
                counts[0] += part.sum(axis=0, dtype=np.int64)
            else:
                counts += np.add.reduceat(part, starts[rows] - first, axis=0, dtype=np.int64)
        out[rows] = np.packbits(counts * 2 > sizes[rows, None], axis=1, bitorder="little").view("<u8").ravel()
        at = stop
    return out


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included; A-Z is lower-cased and words part at ASCII white space.

    A text of fewer words has one shingle, all of it; a text without words none.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, dtype="<u8")
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(b" ".join(parts), SEED)], dtype="<u8")
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(parts) - words] + 1])
    del parts
    stops, out = ends[words - 1 :], np.empty(len(starts), dtype="<u8")
    for low in range(0, len(starts), COUNTED_AT_ONCE):  # a very long text's places are not all Python's numbers at once
        some = slice(low, low + COUNTED_AT_ONCE)
        out[some] = [digest(joined[s:e], SEED) for s, e in zip(starts[some].tolist(), stops[some].tolist(), strict=True)]
    return out


#: One bit of each of so many minima of differently mixed shingle hashes: two sets agree in a share (1 + similarity) / 2 of them.
SKETCH_BITS = 1024
_MIXERS = (np.random.default_rng(SEED).integers(0, 1 << 31, SKETCH_BITS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SKETCH_BITS bits, as 64-bit words, of a set of shingle hashes."""
    small = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(SKETCH_BITS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for low in range(0, len(small), 256):
        np.minimum(least, (small[low : low + 256, None] * _MIXERS).min(0), out=least)
    return np.packbits((least >> np.uint32(7)).astype(np.uint8) & 1, bitorder="little").view("<i8")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp long)`` of every row of ``docs(doc_id, text)``; texts without words have fingerprint 0."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            for part in slices(batch, 1, HASHED_AT_ONCE):
                own = [shingle_hashes(text.as_py(), words) for text in part.column(1)]
                bits = _bits(np.concatenate(own), np.array([len(x) for x in own], dtype=np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits.view("<i8"))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def set_prints(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, fp, shingles, digest, sketch)`` of the set of each row's different shingles: what a text repeats counts once.

    ``digest`` is equal where the sets are; ``sketch`` is an array of SKETCH_BITS bits in longs.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            for part in slices(batch, 1, HASHED_AT_ONCE):
                own = [np.unique(shingle_hashes(text.as_py(), words)) for text in part.column(1)]
                sizes = np.array([len(x) for x in own], dtype=np.int64)
                bits = _bits(np.concatenate(own), sizes)
                sketches = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * (SKETCH_BITS // 64)), pa.array(np.concatenate([sketch(x) for x in own])))
                digests = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in own], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits.view("<i8")), pa.array(sizes), digests, sketches], names=["doc_id", "fp", "shingles", "digest", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long, shingles long, digest binary, sketch array<long>")


def _labels(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each of ``n`` nodes' components."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (label == before).all():
            return label


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As few links as join the same nodes: every node of a component with its smallest node."""
    label = _labels(i, j, n)
    nodes = np.flatnonzero(label != np.arange(n))
    return nodes, label[nodes]


def _tree(i: np.ndarray, j: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the links of a spanning forest of least distances, by rounds in which every part takes its closest link out."""
    part, live, chosen = np.arange(n), np.arange(len(i)), []
    key = d.astype(np.int64) * len(i) + live
    while len(live):
        ci, cj = part[i[live]], part[j[live]]
        apart = ci != cj
        live, ci, cj = live[apart], ci[apart], cj[apart]
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, ci, key[live])
        np.minimum.at(best, cj, key[live])
        taken = np.unique(best[best < np.iinfo(np.int64).max]) % max(1, len(i))
        chosen.append(taken)
        part = _labels(part[i[taken]], part[j[taken]], n)[part]
    return np.concatenate(chosen) if chosen else np.zeros(0, dtype=np.int64)


def _close(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two tiles whose fingerprints differ in at most ``radius`` bits."""
    found_i, found_j = [], []
    step = max(1, 1_000_000 // max(1, len(b)))
    for low in range(0, len(a), step):
        near = np.bitwise_count(a[low : low + step, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        i += low
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        found_i.append(i)
        found_j.append(j)
    return np.concatenate(found_i), np.concatenate(found_j)


def tile_links(nodes: DataFrame, coords: list[Column], offsets: list[tuple[int, ...]], radius: int, mode: str = "all", tile_rows: int = TILE_ROWS, agree: int = 0) -> DataFrame:
    """Links ``(u long, v long)`` between different rows of ``nodes(id, fp, ...)`` whose fingerprints differ in ``radius`` or fewer bits.

    ``coords`` are counts that close fingerprints can differ in only by one of ``offsets`` (one of each opposite pair):
    tiles of other cells are skipped. A cell is cut into tiles of about ``tile_rows``; pairs of tiles are dealt out in bundles of about
    BUNDLE_BYTES, so what a task holds does not grow with a cell. Mode ``forest`` gives only links that join the same components, at
    most one a row of a tile; ``tree`` a spanning forest of the closest links; ``all`` every link. Where ``nodes`` have a ``label``, only
    links between different labels; where they have a ``sketch``, only links whose sketches agree in ``agree`` bits or more.
    """
    spark = nodes.sparkSession
    labelled, sketched = "label" in nodes.columns, "sketch" in nodes.columns
    words = SKETCH_BITS // 64 * sketched
    dims, width = len(coords), 1 << 12
    code = lambda parts: sum((p * F.lit(width**k) for k, p in enumerate(parts[1:], 1)), parts[0])
    placed = nodes.select("id", "fp", *["label"] * labelled, *["sketch"] * sketched, F.array(*[c.cast("long") for c in coords]).alias("at"))
    # one row for each combination of small counts: its size does not depend on the number of nodes
    counts = cut(placed.groupBy("at").agg(F.count("*").alias("n")).withColumn("tiles", F.ceil(F.col("n") / F.lit(tile_rows)).cast("int")))
    held = {tuple(r["at"]): (r["n"], r["tiles"]) for r in counts.collect()}
    volume = sum(n * held[to][1] + held[to][0] * tiles for at, (n, tiles) in held.items() for o in offsets if (to := tuple(x + y for x, y in zip(at, o, strict=True))) in held)
    bundles = max(2 * parallelism(spark), ceil_div(volume * 8 * (3 + words), BUNDLE_BYTES))
    counts = F.broadcast(counts.select(F.col("at").alias("to"), F.col("tiles").alias("others")))
    tiles = placed.join(counts, F.col("at") == F.col("to")).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("others").cast("long")).cast("int"))
    row = F.struct("id", "fp", F.col("label" if labelled else "id").alias("label"), *[F.col("sketch")[k].alias(f"s{k}") for k in range(words)])
    tiles = cut(tiles.groupBy("at", "tile").agg(F.collect_list(row).alias("rows")))
    step = F.explode(F.array(*[F.array(*[F.lit(int(x)).cast("long") for x in o]) for o in offsets])).alias("off")
    same = F.col("off") == F.array(*[F.lit(0).cast("long")] * dims)

    def side(sign: int) -> DataFrame:
        """Every tile once for each tile that it meets; the first of two tiles has sign 1."""
        met = tiles.select("at", "tile", "rows", step)
        met = met.withColumn("other", F.array(*[F.col("at")[k] + F.lit(sign) * F.col("off")[k] for k in range(dims)])).join(counts, F.col("other") == F.col("to"))
        low, high = (F.when(same, F.col("tile")).otherwise(0), F.col("others") - 1) if sign > 0 else (F.lit(0), F.when(same, F.col("tile") - 1).otherwise(F.col("others") - 1))
        met = met.where(high >= low).withColumn("other_tile", F.explode(F.sequence(low, high)))
        cell = code([F.col("at" if sign > 0 else "other")[k] for k in range(dims)])
        first, second = ("tile", "other_tile") if sign > 0 else ("other_tile", "tile")
        key = F.concat_ws(" ", cell, F.col(first), F.array_join(F.col("off").cast("array<string>"), ","), F.col(second))
        return met.select(key.alias("pair"), F.lit(sign).alias("side"), (same & (F.col("tile") == F.col("other_tile"))).alias("same"), "rows")

    pairs = side(1).unionByName(side(-1)).withColumn("bundle", F.pmod(F.xxhash64("pair"), F.lit(bundles)))

    def compare(a: list[np.ndarray], b: list[np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray]:
        x, y = a[1].view("<u8"), b[1].view("<u8")
        i, j = _close(x, y, radius, same)
        if labelled:
            apart = a[2][i] != b[2][j]
            i, j = i[apart], j[apart]
        strength = np.zeros(0, dtype=np.int64)
        if words and len(i):
            kept, strength = [], []
            for low in range(0, len(i), 200_000):
                p, q = i[low : low + 200_000], j[low : low + 200_000]
                like = SKETCH_BITS - sum(np.bitwise_count((s[p] ^ t[q]).view("<u8")).astype(np.int64) for s, t in zip(a[3:], b[3:], strict=True))
                near = np.flatnonzero(like >= agree)
                kept.append(low + near)
                strength.append(like[near])
            kept, strength = np.concatenate(kept), np.concatenate(strength)
            i, j = i[kept], j[kept]
        ids = a[0] if same else np.concatenate([a[0], b[0]])
        if not same:
            j = j + len(x)
        if mode == "forest" and len(i) > len(ids):
            i, j = _forest(i, j, len(ids))
        elif mode == "tree" and len(i):
            both = x if same else np.concatenate([x, y])
            kept = _tree(i, j, SKETCH_BITS - strength if words else np.bitwise_count(both[i] ^ both[j]), len(ids))
            i, j = i[kept], j[kept]
        return ids[i], ids[j]

    def run(group: pa.Table) -> pa.Table:
        names, sides, alone = group["pair"].to_pylist(), group["side"].to_pylist(), group["same"].to_pylist()
        lists = [c for chunk in group["rows"].chunks for c in (chunk[k] for k in range(len(chunk)))]
        at: dict[str, dict[int, int]] = {}
        for n, (name, side) in enumerate(zip(names, sides, strict=True)):
            at.setdefault(name, {})[side] = n
        of = lambda n: [f.to_numpy(zero_copy_only=False).astype("<i8") for f in lists[n].values.flatten()]
        us, vs = [np.zeros(0, "<i8")], [np.zeros(0, "<i8")]
        for both in at.values():
            a = of(both[1])
            u, v = compare(a, a, True) if alone[both[1]] else compare(a, of(both[-1]), False)
            us.append(u)
            vs.append(v)
        return pa.table({"u": pa.array(np.concatenate(us)), "v": pa.array(np.concatenate(vs))})

    return pairs.groupBy("bundle").applyInArrow(run, "u long, v long")


def half_ball(dims: int, radius: int) -> list[tuple[int, ...]]:
    """Integer steps of total size up to ``radius``, zero and one of each opposite pair."""
    steps = (o for o in itertools.product(range(-radius, radius + 1), repeat=dims) if sum(map(abs, o)) <= radius)
    return [o for o in steps if o >= (0,) * dims]


def quarter_counts(fp: Column) -> list[Column]:
    """Set bits in each 16 bits: two fingerprints differ in at least the sum of the differences of these counts."""
    return [F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long"))) for k in range(4)]


def fingerprint_components(base: DataFrame, radius: int = 2) -> DataFrame:
    """``base(doc_id, fp)`` with ``component_id``: the smallest doc_id reachable over links of ``radius`` or fewer bits.

    Equal fingerprints are one node, so copies are never compared with each other. Rows without doc_id take part and get
    their component's smallest doc_id, null if it has none.
    """
    nodes = cut(base.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    links = tile_links(nodes.withColumn("id", F.col("fp")), quarter_counts(F.col("fp")), half_ball(4, radius), radius, "forest")
    roots = connected_components(links).withColumnRenamed("node", "fp")
    placed = cut(nodes.join(roots, "fp", "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root")))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = placed.join(least, "root").select("fp", "n", "component_id")
    return join_hot(base, labels, "fp").select(*base.columns, "component_id")


def simhash_near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs(doc_id, text)``.

    Null and empty texts have fingerprint zero and link like any other; repeated rows share a node; extra columns are
    ignored. An empty table gives an empty result.
    """
    base = cut(fingerprints(docs, words))
    return fingerprint_components(base, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
