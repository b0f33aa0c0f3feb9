"""Removal of repeated multi-line chunks whose boundaries the content chooses."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, slices

#: Lines that the rolling hash sees, and the fewest lines of a chunk.
WINDOW, MIN_LINES = 2, 2
#: A line of so many words or more is a chunk of its own.
LONG_WORDS = 50
_BASE, _PRIME = 1_000_003, (1 << 61) - 1
_FLUSH = 4_000_000


def chunk_ends(lines: list[str], window: int = WINDOW) -> list[int]:
    """Ends (exclusive line numbers) of the chunks of ``lines``.

    A polynomial hash rolls over the hashes of the last ``window`` lines; a chunk ends where the hash is less than at the lines before
    and behind. So a boundary depends on the lines next to it alone, not on where the last one was: inside a passage that is copied
    elsewhere the boundaries are the same ones. Least values are never next to each other, so chunks have MIN_LINES lines or
    more. A line of LONG_WORDS words is a chunk whatever stands around it; short lines between two such may be left alone.
    """
    n = len(lines)
    hashes = [xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) for line in lines]
    out = pow(_BASE, window, _PRIME)
    rolled, at = 0, []
    for i, h in enumerate(hashes):
        rolled = (rolled * _BASE + h - (hashes[i - window] * out if i >= window else 0)) % _PRIME
        at.append(rolled)
    long = [len(line) >= 2 * LONG_WORDS - 1 and len(line.split()) >= LONG_WORDS for line in lines]
    ends = {i + 1 for i in range(1, n - 2) if at[i - 1] > at[i] <= at[i + 1]}
    for i in range(n):
        if long[i]:
            ends |= {i, i + 1}
    return sorted((ends | {n}) - {0}) if n else []


_CHUNKS = pa.schema([("doc_id", pa.int64()), ("crc", pa.int64()), ("place", pa.decimal128(38, 0)), ("first_line", pa.int32()), ("end_line", pa.int32()), ("digest", pa.binary()), ("body", pa.string())])


def chunks(docs: DataFrame) -> DataFrame:
    """Every chunk of two or more lines, or of one long one: its document, its place (which orders all chunks), lines, digest and bytes."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches(source):
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text, doc_id = text.as_py(), doc_id.as_py()
                if not text:
                    continue
                lines = text.split("\n")
                crc = zlib.crc32(text.encode("utf-8", "surrogatepass"))
                at = ((1 << 63) if doc_id is None else doc_id) * (1 << 32) + crc  # rows without doc_id come last
                first = 0
                for end in chunk_ends(lines):
                    if end - first >= MIN_LINES or len(lines[first].split()) >= LONG_WORDS:
                        body = "\n".join(lines[first:end])
                        rows.append((doc_id, crc, Decimal(at * (1 << 24) + first), first, end, xxhash.xxh3_128_digest(body.encode("utf-8", "surrogatepass")), body))
                        held += len(body)
                    first = end
                if held > _FLUSH or len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CHUNKS.types, strict=True)], schema=_CHUNKS)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CHUNKS.types, strict=True)], schema=_CHUNKS)

    kinds = "doc_id long, crc long, place decimal(38,0), first_line int, end_line int, digest binary, body string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kinds)


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` (its columns in their order) with repeated chunks cut out of ``text``, and what was cut.

    A chunk that occurs more than once, anywhere, stays where it comes first (least doc_id, then the earlier line) and
    goes elsewhere. Chunks with equal digests are compared byte by byte: they are grouped by digest and bytes together,
    and a digest that stands for different bytes removes nothing. ``__chunks_cut`` and ``__lines_cut`` count what went.

    Chunks have several lines, or are one line of LONG_WORDS words or more. Empty and null texts, and short texts of one line, have none and stay as they are. Rows that repeat doc_id
    and text are one document. Rows without doc_id come after all others. Extra columns pass through; an empty table
    gives an empty table.

    Copies are merged before the shuffle (partial aggregation by digest and bytes), so a passage that a third of the
    documents share reaches one row; the join that maps it back to its places is an ordinary one, which adaptive
    execution splits by size.
    """
    found = chunks(docs)
    same = found.groupBy("digest", "body").agg(F.min("place").alias("first_place"), F.count("*").alias("n"))
    known = same.groupBy("digest").agg(F.count("*").alias("variants"), F.sum("n").alias("n"), F.min("first_place").alias("first_place"))
    known = known.where("variants = 1 and n > 1").select("digest", "first_place")
    gone = found.select("doc_id", "crc", "place", "first_line", "end_line", "digest").join(known, "digest").where("place <> first_place")
    gone = gone.groupBy("doc_id", "crc").agg(F.collect_set(F.struct("first_line", "end_line")).alias("__cut"))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("crc").alias("__crc"), "__cut")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (crc == gone["__crc"]), "left").drop("__id", "__crc")
    text_at = docs.columns.index("text")
    names = docs.columns
    cut_at = len(names)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches(source) for part in slices(whole, text_at, _FLUSH)):
            columns = list(batch.columns)
            n_chunks, n_lines = [0] * batch.num_rows, [0] * batch.num_rows
            if columns[cut_at].null_count < batch.num_rows:
                own = columns[text_at].to_pylist()
                for i, cuts in enumerate(columns[cut_at].to_pylist()):
                    if cuts:
                        lines = own[i].split("\n")
                        kept, at = [], 0
                        for c in sorted(cuts, key=lambda c: c["first_line"]):
                            kept += lines[at : c["first_line"]]
                            at = c["end_line"]
                            n_lines[i] += at - c["first_line"]
                        own[i] = "\n".join(kept + lines[at:])
                        n_chunks[i] = len(cuts)
                columns[text_at] = pa.array(own, columns[text_at].type)
            columns[cut_at] = pa.array(n_chunks, pa.int32())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int32())], names=[*names, "__chunks_cut", "__lines_cut"])

    return joined.mapInArrow(run, docs.select(*docs.columns).schema.add("__chunks_cut", "integer").add("__lines_cut", "integer"))
