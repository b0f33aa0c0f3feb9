"""Byte-level BPE: ranked merges folded by higher-order functions over the byte arrays of distinct words."""

from __future__ import annotations

import base64
import heapq
import json
import re
import unicodedata
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, collect_garbage, unit_hash

#: Characters of text in a block, words of one row, characters of one batch, and rarer words that a task knows before it forgets them.
BLOCK_CHARS, WORDS_A_ROW, BATCH_CHARS, KNOWN_WORDS = 4_000_000, 512, 1_000_000, 120_000
#: Words that are folded once for the whole table: the most frequent of about so many sampled rows, of at most so many bytes.
COMMON_WORDS, SAMPLED_ROWS, COMMON_BYTES = 1 << 18, 20_000, 64
#: The fold takes time in the square of a word's length: longer words (in bytes) are merged by the same rule with a heap.
FOLDED_BYTES = 16_384
#: Bits of an id and of a place in a word; the rank of what has none, above all ids.
ID_BITS = 20
NONE = 1 << ID_BITS
#: Buckets of the literal rank map, and places in which the CRC-32 of no two bytes meet.
BUCKETS = 65_521
BYTE_PLACES = next(m for m in range(256, 1 << 20) if len({zlib.crc32(bytes([b])) % m for b in range(256)}) == 256)
_MARK = "\x00"


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file in the tiktoken library's format."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """``pattern``'s matches, white space being the Unicode property as in the tiktoken library's engine.

    For texts of Latin-1 characters alone its classes are spelled out for the standard library's faster engine; the matches are the same.
    """
    whole = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
    of = lambda kind: "".join(f"\\x{c:02x}" for c in range(256) if unicodedata.category(chr(c))[0] == kind)
    letters, numbers, spaces = of("L"), of("N"), "\\x09-\\x0d\\x20\\x85\\xa0"
    spelled = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    spelled = spelled.replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]")
    if re.search(r"\\[a-zA-Z]", spelled.replace(r"\x", "")):  # another pattern, with classes that are not spelled out
        return whole
    latin = re.compile(spelled).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return whole(text)
        return latin(text)

    return split


def merge_with_heap(word: bytes, ranks: dict[bytes, int], whole: bool = True) -> list[int]:
    """The ids of one word: the adjacent pair of least rank, the first of equals, is merged until none has a rank.

    A word that is a token is that one, unless ``whole`` is false.
    """
    if whole and word in ranks:
        return [ranks[word]]
    n = len(word)
    pieces: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 1) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, j = heapq.heappop(heap)
        if pieces[i] is None or after[i] != j or j >= n or pieces[j] is None or ranks.get(pieces[i] + pieces[j]) != r:
            continue
        pieces[i] += pieces[j]
        pieces[j] = None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (new := ranks.get(pieces[i] + pieces[after[i]])) is not None:
                heapq.heappush(heap, (new, i, after[i]))
        if before[i] >= 0 and (new := ranks.get(pieces[before[i]] + pieces[i])) is not None:
            heapq.heappush(heap, (new, before[i], i))
    return [ranks[p] for p in pieces if p is not None]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once: a fold over nothing that starts from ``value`` and ends in ``then``; it makes no array."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, then)


def rank_map(ranks: dict[bytes, int]) -> Column:
    """One literal struct: ``pairs``, buckets of the adjacent pairs of ids that have a rank, each with it; ``bytes``, the ids of single bytes."""
    pairs: list[list[int]] = [[] for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pair = left << ID_BITS | right
                pairs[pair % BUCKETS].append(pair << (ID_BITS + 1) | rank)
    ids = [-1] * BYTE_PLACES
    for byte in range(256):
        ids[zlib.crc32(bytes([byte])) % BYTE_PLACES] = ranks[bytes([byte])]
    literal = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    return F.struct(literal(pairs, "array<array<bigint>>").alias("pairs"), literal(ids, "array<bigint>").alias("bytes"))


def _rank(found: Column, left: Column, right: Column) -> Column:
    """The rank of two adjacent ids; NONE where they do not merge."""
    # array_position leaves its loop by an exception where it finds something, which takes far longer than these small buckets
    held = lambda pair: F.get(found["pairs"], (pair % F.lit(BUCKETS)).cast("int"))
    take = lambda pair: lambda had, x: F.when(F.shiftright(x, ID_BITS + 1) == pair, x.bitwiseAND(_long((1 << (ID_BITS + 1)) - 1))).otherwise(had)
    return _let(F.shiftleft(left, ID_BITS).bitwiseOR(right), lambda pair: F.coalesce(F.aggregate(held(pair), _long(NONE), take(pair)), _long(NONE)))


def _fold(word: Column, found: Column) -> Column:
    """The ids of one word by a fold over its bytes.

    The state is an array of longs, one for each piece: the rank of the piece with the next one, the place of its first byte, its id.
    The least is the pair to merge, the first of equals. A piece that merges with nothing stands at either end.
    """
    edge, rest = _long((1 << ID_BITS) - 1), F.lit(1 << 30)
    id_of = lambda x: x.bitwiseAND(_long((1 << ID_BITS) - 1))
    place = lambda x: x.bitwiseAND(_long(((1 << ID_BITS) - 1) << ID_BITS))
    ranked = lambda rank, piece: F.shiftleft(rank, 2 * ID_BITS).bitwiseOR(piece)

    def merge(state: Column, _: Column) -> Column:
        def at(least: Column) -> Column:
            new = F.shiftright(least, 2 * ID_BITS)  # a pair's rank is the id of what it becomes

            def joined(i: Column) -> Column:  # pieces i and i + 1, counted from 0, become one
                last = F.get(state, i - 1)
                before = ranked(_rank(found, id_of(last), new), place(last).bitwiseOR(id_of(last)))
                own = ranked(_rank(found, new, id_of(F.get(state, i + 2))), place(least).bitwiseOR(new))
                return F.flatten(F.array(F.slice(state, F.lit(1), i - 1), F.array(before, own), F.slice(state, i + 3, rest)))

            where = _let(place(least), lambda first: F.size(F.filter(state, lambda x: place(x) < first)))
            return F.when(least >= _long(NONE << (2 * ID_BITS)), state).otherwise(_let(where, joined))

        return _let(F.array_min(state), at)

    def whole(raw: Column) -> Column:
        n = F.octet_length(raw)
        byte = lambda j: F.get(found["bytes"], (F.crc32(F.substring(raw, j, F.lit(1))) % F.lit(BYTE_PLACES)).cast("int"))
        pieces = F.concat(F.array(edge), F.transform(F.sequence(F.lit(1), n), byte), F.array(edge))

        def start(p: Column) -> Column:
            piece = lambda j: F.shiftleft(j.cast("long"), ID_BITS).bitwiseOR(F.get(p, j))
            return F.transform(F.sequence(F.lit(0), n + 1), lambda j: ranked(_rank(found, F.get(p, j), F.get(p, j + 1)), piece(j)))

        return F.aggregate(F.sequence(F.lit(2), n), _let(pieces, start), merge, lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda x: id_of(x).cast("int")))

    return _let(word.cast("binary"), whole)


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def fold_words(words: Column, ranks: dict[bytes, int]) -> Column:
    """The ids of each word of an array of words that are not null or empty.

    A word that is itself a token is that token; the fold gives the same for all but those tokens that their own merges do not reach.
    """
    if max(ranks.values()) >= (1 << ID_BITS) - 1:
        raise ValueError(f"ids of more than {ID_BITS} bits")
    odd = [t for t in ranks if merge_with_heap(t, ranks, whole=False) != [ranks[t]]]
    folded = lambda found: lambda w: _fold(w, found)
    if odd:
        own = F.from_json(F.lit(json.dumps([[base64.b64encode(t).decode() for t in odd]])), "array<array<binary>>")
        ids = F.array(*[F.lit(ranks[t]) for t in odd])
        at = lambda w: F.array_position(F.get(own, F.lit(0)), w.cast("binary")).cast("int")
        folded = lambda found: lambda w: F.when(at(w) > 0, F.array(F.get(ids, at(w) - 1))).otherwise(_fold(w, found))
    return _let(rank_map(ranks), lambda found: F.transform(words, folded(found)))


def common_words(docs: DataFrame, ranks: dict[bytes, int], pattern: str, words: int = COMMON_WORDS, rows: int = SAMPLED_ROWS) -> bytes:
    """The most frequent words of about ``rows`` rows of ``docs(doc_id, text)`` and their ids, as an Arrow stream that ``opened`` reads.

    At most ``words`` words of at most COMMON_BYTES bytes whatever the table's size. They only save folds: no result depends on them.
    """
    share = rows / max(1, docs.count())
    sampled = docs.where(unit_hash("doc_id", 45) < share) if share < 1 else docs

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(pattern)
        counts: Counter[str] = Counter()

        def give() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for got in batches(source):
            for text in got.column(0):
                counts.update(w for w in split(text.as_py() or "") if len(w) <= COMMON_BYTES)
                if len(counts) > words:
                    yield give()
        yield give()

    counted = sampled.select(F.col("text").cast("string")).mapInArrow(count, "word string, n long").where(F.octet_length("word") <= COMMON_BYTES)
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(words)
    top = pa.concat_arrays(top.select("word").toArrow().column(0).chunks or [pa.array([], pa.string())])
    # the fold has a plan of its own: every plan that adaptive execution writes anew would spell out the literal ranks
    spark = docs.sparkSession
    if not len(top):
        return _stream(pa.table({"words": pa.array([], pa.list_(pa.string())), "ids": pa.array([], pa.list_(pa.list_(pa.int32())))}))
    ends = pa.array([*range(0, len(top), WORDS_A_ROW), len(top)], pa.int32())
    packed = spark.createDataFrame(pa.table({"words": pa.ListArray.from_arrays(ends, top)}))
    return _stream(packed.select("words", fold_words(F.col("words"), ranks).alias("ids")).toArrow())


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


#: The frequent words that this process has read last, by the name of their table.
_OPENED: dict[str, dict[str, bytes]] = {}


def opened(name: str, stream: Callable[[], bytes]) -> dict[str, bytes]:
    """The words of ``common_words`` with their ids as little-endian 32-bit integers, read once in a process."""
    if name not in _OPENED:
        _OPENED.clear()
        known: dict[str, bytes] = {}
        for batch in pa.ipc.open_stream(stream()):
            for words, ids in zip(batch.column(0), batch.column(1), strict=True):
                known.update(zip(words.as_py(), _split_ids(ids.values), strict=True))
        _OPENED[name] = known
    return _OPENED[name]


def _split_ids(lists: pa.ListArray) -> list[bytes]:
    raw = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes()
    ends = (np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)) * 4).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: tuple[str, ...] = ("doc_id",), sampled: DataFrame | None = None) -> DataFrame:
    """``(*keep, ids array<int>)`` for every row of ``docs(doc_id, text, ...)``, as the tiktoken library encodes it; ``keep`` names long columns.

    Each match of ``pattern`` is encoded separately and there are no special tokens. Null and empty texts have no ids;
    repeated rows and null doc_ids come out as they are; an empty table gives an empty result; other columns are ignored.
    Rows come out in the order in which they lie in their partitions.

    The frequent words of ``common_words`` are folded once. For the others there is no shuffle: a partition's texts are taken in blocks
    of BLOCK_CHARS; a block gives first its distinct words that are new to the task, whose merges Spark's higher-order functions fold, and then its texts, cut
    into words; the next step keeps the task's words, forgets them all beyond KNOWN_WORDS and writes each text's ids. Words longer than FOLDED_BYTES bytes are merged by
    the same rule with a heap. ``sampled`` has the same rows, where it is cheaper to read them than to make ``docs`` twice.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(common_words(docs if sampled is None else sampled, ranks, pattern)), uuid.uuid4().hex
    collect_garbage(docs.sparkSession)  # of the fold of the frequent words and of what ran before
    keys = [pa.field(k, pa.int64()) for k in keep]
    row = pa.schema([pa.field("kind", pa.int32()), *keys, pa.field("text", pa.string()), pa.field("words", pa.list_(pa.string()))])
    none = [None] * len(keep)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), row.types, strict=True)], schema=row)

    def cut_words(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = splitter(pattern), opened(name, lambda: shared.value)
        distinct: dict[str, None] = {}
        seen: set[str] = set()
        texts: list[tuple] = []
        held = 0

        def block() -> Iterator[pa.RecordBatch]:
            words = [w for w in distinct if len(w) <= FOLDED_BYTES // 4 or len(w.encode("utf-8", "surrogatepass")) <= FOLDED_BYTES]
            seen.update(words)
            distinct.clear()
            group, out, size, held = [], [], 0, 0
            for w in words:
                group.append(w)
                size += len(w)
                if len(group) == WORDS_A_ROW or size > 16 * WORDS_A_ROW * 8:
                    out.append((0, *none, None, group))
                    held += size
                    group, size = [], 0
                if held > BATCH_CHARS:
                    yield batch(out)
                    out, held = [], 0
            out += [(0, *none, None, group)] * bool(group)
            texts.reverse()
            while texts:
                out.append(texts.pop())
                held += len(out[-1][-2])
                if held > BATCH_CHARS:
                    yield batch(out)
                    out, held = [], 0
            if len(seen) > KNOWN_WORDS:
                seen.clear()
                out.append((2, *none, None, None))
            if out:
                yield batch(out)

        for got in batches(source):
            ids = [c.to_pylist() for c in got.columns[:-1]]
            for i, text in enumerate(got.column(got.num_columns - 1)):
                text = text.as_py() or ""
                words = split(text)
                distinct.update(dict.fromkeys(filterfalse(seen.__contains__, filterfalse(known.__contains__, words))))
                texts.append((1, *(c[i] for c in ids), _MARK.join(words), None) if _MARK not in text else (3, *(c[i] for c in ids), text, None))
                held += len(text)
                if held >= BLOCK_CHARS:
                    yield from block()
                    held = 0
        if texts:
            yield from block()

    def join_ids(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = splitter(pattern), opened(name, lambda: shared.value)
        added: list[str] = []

        def own(word: str) -> bytes:
            known[word] = ids = np.array(merge_with_heap(word.encode("utf-8", "surrogatepass"), ranks), dtype="<i4").tobytes()
            added.append(word)
            return ids

        for got in batches(source):
            kinds = got.column(0).to_pylist()
            named, encoded, sizes = [[] for _ in keep], [], []
            text_at = 1 + len(keep)
            for i, kind in enumerate(kinds):
                if kind == 0:
                    words = got.column(text_at + 1)[i].as_py()
                    known.update(zip(words, _split_ids(got.column(text_at + 2)[i].values), strict=True))
                    added += words
                elif kind == 2:  # enough words; what all tasks share stays
                    for word in added:
                        known.pop(word, None)
                    added.clear()
                else:
                    text = got.column(text_at)[i].as_py()
                    words = split(text) if kind == 3 else text.split(_MARK) if text else []
                    try:
                        joined = b"".join(map(known.__getitem__, words))
                    except KeyError:
                        joined = b"".join(known[w] if w in known else own(w) for w in words)
                    for k, values in enumerate(named):
                        values.append(got.column(1 + k)[i].as_py())
                    encoded.append(joined)
                    sizes.append(len(joined) // 4)
            if sizes:
                values = pa.Array.from_buffers(pa.int32(), sum(sizes), [None, pa.py_buffer(b"".join(encoded))])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("int32"))
                yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in named), pa.ListArray.from_arrays(offsets, values)], names=[*keep, "ids"])
        for word in added:  # the next task of this process starts with the shared words alone
            known.pop(word, None)

    typed = ", ".join(f"`{k}` long" for k in keep)
    cut = docs.select(*[F.col(k).cast("long").alias(k) for k in keep], F.col("text").cast("string").alias("text"))
    blocks = cut.mapInArrow(cut_words, f"kind int, {typed}, text string, words array<string>")
    return blocks.withColumn("ids", fold_words(F.col("words"), ranks)).mapInArrow(join_ids, f"{typed}, ids array<int>")


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of a column of ids: the binary pieces of a literal array, put together in order."""
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = base64.b64encode(token).decode()
    # a string of any bytes: array_join takes strings and puts their bytes together as they are
    vocabulary = F.from_json(F.lit(json.dumps(pieces)), "array<binary>")
    return _let(vocabulary, lambda v: F.array_join(F.transform(ids, lambda i: F.get(v, i).cast("string")), "").cast("binary"))


def digests(encoded: DataFrame, ranks: dict[bytes, int], keep_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of ``encoded(doc_id, ids)``; the second digest is of the decoded ids.

    The columns ``keep`` are kept beside them.
    """
    return encoded.select(
        "doc_id",
        *keep,
        *["ids"] * keep_ids,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids"), ranks), 256).alias("decoded_sha256"),
    )
