"""Byte-level BPE by folding ranked merges over the bytes of distinct words.

Texts are split into pieces by the tokenizer's pattern. A batch of texts is written as numbers of its own distinct pieces, bucketed by
batch; the distinct pieces go, packed, to parts of the hash range, where each is encoded once by Spark's higher-order
functions, with the ranks as one value; the parts send every batch the ids of its pieces. Texts themselves never move: only
a batch's word list does. Decoding concatenates the bytes of the tokens that the ids name.

A step of the fold copies the piece, so pieces over ``LONG`` bytes are merged by a heap of ranked pairs instead, in the same order.

Every rank file must hold all single bytes. Null and empty texts have no ids. Each input row is one output row. A very long text is a
batch of its own.
"""

from __future__ import annotations

import base64
import heapq
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, IntegerType, LongType, StructField, StructType,
)

from ..storage import materialise, new_folder
from .line_runs import bound
from .textarrays import binaries, concatenated

BUCKETS = 1 << 15
SPREAD, ID_LIMIT = 7919, 1 << 24
BATCH_BYTES = 1 << 25
LONG = 256


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[token] for token in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must count up from 0")
    return tokens


def rank_map(spark: SparkSession, tokens: list[bytes]) -> Column:
    """The ranks of a tokenizer as one value: ``single`` of the 256 bytes; of pairs of tokens whose bytes together are a token, ``keys``
    and the ranks ``found``, in short lists by hash, so that a look-up compares a few keys.

    It is read from a table of one row, as plain bytes. As a literal it would be an object per number in every plan that the driver holds.
    """
    ranks = {token: rank for rank, token in enumerate(tokens)}
    missing = [i for i in range(256) if bytes([i]) not in ranks]
    if missing or len(tokens) >= ID_LIMIT:
        raise ValueError(f"the ranks lack the single bytes {missing} or count {ID_LIMIT} or more")
    found = (
        (a * ID_LIMIT + b, rank) for rank, token in enumerate(tokens) for cut in range(1, len(token))
        if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None)
    pairs = np.fromiter(chain.from_iterable(found), dtype=np.int64).reshape(-1, 2)
    bucket = ((pairs[:, 0] // ID_LIMIT) * SPREAD + pairs[:, 0] % ID_LIMIT) % BUCKETS
    order = np.argsort(bucket, kind="stable")
    pairs, cuts = pairs[order], np.searchsorted(bucket[order], np.arange(BUCKETS + 1)).astype(np.int32)

    def one_row(values: np.ndarray, kind: pa.DataType) -> pa.Array:
        lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(values, kind))
        return pa.ListArray.from_arrays(pa.array([0, BUCKETS], pa.int32()), lists)

    single = pa.array([[ranks[bytes([i])] for i in range(256)]], pa.list_(pa.int32()))
    row = pa.table({"single": single, "keys": one_row(pairs[:, 0], pa.int64()), "found": one_row(pairs[:, 1], pa.int32())})
    stored = materialise(spark.createDataFrame(row), name="ranks")
    return stored.select(F.struct("single", "keys", "found").alias("ranks")).scalar()


def rank_of_pair(ranks: Column, a: Column, b: Column) -> Column:
    """The rank of two tokens' bytes together, or null."""
    a = a.cast("long")
    bucket = ((a * SPREAD + b) % BUCKETS).cast("int")
    return F.get(F.get(ranks["found"], bucket), (F.array_position(F.get(ranks["keys"], bucket), a * ID_LIMIT + b) - 1).cast("int"))


def merged(ranks: Column, piece: Column) -> Column:
    """Token ids of the bytes of ``piece`` after all ranked merges.

    The fold's state is the tokens so far and the ranks of neighbours taken together, which are the ids that merging gives. A
    step merges the leftmost pair of the lowest rank and looks up its two new neighbours; without a ranked pair the state stays.
    """
    n = F.octet_length(piece)
    none = F.array().cast("array<int>")
    one_by_one = F.split(F.decode(piece, "ISO-8859-1"), "")  # a character per byte
    single = F.transform(F.slice(one_by_one, F.lit(1), n), lambda byte: F.get(ranks["single"], F.ascii(byte)))

    def with_ranks(ids: Column) -> Column:
        pairs = F.zip_with(F.slice(ids, F.lit(1), n - 1), F.slice(ids, F.lit(2), n - 1), lambda a, b: rank_of_pair(ranks, a, b))
        return F.struct(ids.alias("ids"), F.when(n > 1, pairs).otherwise(none).alias("ranks"))

    def put(ids: Column, old: Column, low: Column, at: Column) -> Column:
        before, after = F.get(ids, at - 1), F.get(ids, at + 2)
        left = F.when(at > 0, F.array(rank_of_pair(ranks, before, low))).otherwise(none)
        right = F.when(after.isNotNull(), F.array(rank_of_pair(ranks, low, after))).otherwise(none)
        size = F.size(ids)
        return F.struct(
            F.concat(F.slice(ids, F.lit(1), at), F.array(low), F.slice(ids, at + 3, size)).alias("ids"),
            F.concat(F.slice(old, F.lit(1), F.greatest(at - 1, F.lit(0))), left, right, F.slice(old, at + 3, size)).alias("ranks"),
        )

    def step(state: Column, _: Column) -> Column:
        return bound(F.array_min(state["ranks"]), lambda low: F.when(low.isNull(), state).otherwise(
            bound((F.array_position(state["ranks"], low) - 1).cast("int"), lambda at: put(state["ids"], state["ranks"], low, at))))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), bound(single, with_ranks), step, lambda state: state["ids"])


def encoded_pieces(pieces: DataFrame, tokens: list[bytes]) -> DataFrame:
    """``pieces`` with the ids of each ``piece`` where they are null: those after its merges."""
    piece = F.col("piece").cast("binary")
    ranks = rank_map(pieces.sparkSession, tokens)
    # bound, so that the plan holds the map once; a column first, since a lambda may not name a subquery
    own = bound(F.col("_ranks"), lambda ranks: merged(ranks, piece))
    return pieces.withColumn("_ranks", ranks).withColumn("ids", F.when(F.col("ids").isNull(), own).otherwise(F.col("ids"))).drop("_ranks")


def heap_merged(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Token ids of a piece after all ranked merges: the leftmost pair of the lowest rank first, as in the fold.

    A heap holds the ranked pairs; a pair that a merge has changed is passed over when its turn comes. No token has over ``longest`` bytes.
    """
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # where the next and the previous token start
    ids = [ranks[piece[i:i + 1]] for i in range(n)]

    def pair(start: int) -> tuple[int, int, int] | None:
        """(rank, start, end) of a token and the next together."""
        middle = after[start]
        if middle >= n or after[middle] - start > longest:
            return None
        rank = ranks.get(piece[start:after[middle]])
        return None if rank is None else (rank, start, after[middle])

    pairs = [found for start in range(n - 1) if (found := pair(start))]
    heapq.heapify(pairs)
    while pairs:
        rank, start, end = heapq.heappop(pairs)
        middle = after[start]
        if ids[start] < 0 or middle >= n or after[middle] != end:
            continue
        ids[start], ids[middle], after[start] = rank, -1, end
        if end < n:
            before[end] = start
        for changed in (start, before[start]):
            if changed >= 0 and (found := pair(changed)):
                heapq.heappush(pairs, found)
    return [i for i in ids if i >= 0]


def white_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to white space; control characters count as such."""
    white = data <= 32
    for lead, size, tails in WHITE:
        at = np.flatnonzero(data == lead)
        at = at[at + size <= len(data)]
        tail = data[at + 1].astype(np.int64) if size == 2 else data[at + 1].astype(np.int64) << 8 | data[at + 2]
        at = at[np.isin(tail, tails)]
        for k in range(size):
            white[at + k] = True
    return white


# White space beyond ASCII in UTF-8: first byte, bytes, and the others as a number.
WHITE = [
    (0xC2, 2, [0x85, 0xA0]), (0xE1, 3, [0x9A80, 0xA08E]), (0xE3, 3, [0x8080]),
    (0xE2, 3, [*range(0x8080, 0x808B), 0x80A8, 0x80A9, 0x80AF, 0x819F]),
]


def stretch_starts(data: np.ndarray, offsets: np.ndarray, at_spaces: bool) -> np.ndarray:
    """Where texts start, and the spaces between two other characters: no piece reaches over these."""
    cuts = np.zeros(len(data) + 1, dtype=bool)
    if at_spaces and len(data) > 2:
        white = white_bytes(data)
        cuts[1:-2] = (data[1:-1] == 32) & ~white[:-2] & ~white[2:]
        ends = offsets[1:]
        cuts[ends[ends > 0] - 1] = False  # a space that ends a text
    cuts[offsets] = True
    cuts[len(data)] = False
    return np.flatnonzero(cuts)


def numbered_pieces(data: np.ndarray, offsets: np.ndarray, find, at_spaces: bool) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(piece numbers of all texts, each text's range in them, the pieces). The pattern runs once on each distinct stretch."""
    starts = stretch_starts(data, offsets, at_spaces)
    stretches = binaries(data, np.append(starts, len(data))).dictionary_encode()
    found = [find(stretch) for stretch in stretches.dictionary.cast(pa.string()).to_pylist()]
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    pieces = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
    own = pieces.indices.to_numpy(zero_copy_only=False).astype(np.uint32)
    numbers, lengths = take_lists(np.append(0, np.cumsum(sizes)), own, stretches.indices.to_numpy(zero_copy_only=False).astype(np.int64))
    ends = np.append(0, np.cumsum(lengths))
    return numbers, ends[np.searchsorted(starts, offsets)], [piece.encode() for piece in pieces.dictionary.to_pylist()]


def split_batches(docs: DataFrame, text: str, pattern: str, keep: list[str], parts: int, at_spaces: bool = True) -> DataFrame:
    """Texts as numbers of pieces, and each batch's distinct pieces by part of the hash range.

    Rows are (_origin, keep.., four planes of cells) or (_origin, _part, _numbers, _lengths, _bytes), with nulls in the other columns.
    ``at_spaces`` cuts texts before a space between two other characters. That holds for patterns whose pieces take white space only as
    one leading space or throughout.
    """
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = concatenated(batch.column(0).fill_null(""), np.uint8)
            first = 0
            while first < len(batch):
                last = max(int(np.searchsorted(offsets, offsets[first] + BATCH_BYTES, side="right")) - 1, first + 1)
                own = offsets[first:last + 1]
                numbers, ranges, pieces = numbered_pieces(data[own[0]:own[-1]], own - own[0], find, at_spaces)
                origin = task << 32 | made
                kept = [column.slice(first, last - first) for column in batch.columns[1:]]
                yield rows_of(last - first, origin, kept, planes(numbers, ranges, len(pieces)), [pa.nulls(last - first, pa.int32()), *(
                    pa.nulls(last - first, pa.binary()) for _ in LISTS[1:])])
                lists = word_lists(pieces, parts)
                n = len(lists[0])
                yield rows_of(n, origin, [pa.nulls(n, k.type) for k in kept], [pa.nulls(n, pa.binary()) for _ in CELLS], lists)
                first, made = last, made + 1

    def rows_of(n, origin, kept, cells, lists):
        return pa.RecordBatch.from_arrays([pa.array([origin] * n, pa.int64()), *kept, *cells, *lists], names=["_origin", *keep, *CELLS, *LISTS])

    schema = StructType([
        StructField("_origin", LongType()), *(StructField(c, docs.schema[c].dataType) for c in keep), *(StructField(c, BinaryType()) for c in CELLS),
        StructField("_part", IntegerType()), *(StructField(c, BinaryType()) for c in LISTS[1:]),
    ])
    return docs.select(F.col(text).alias("_split_text"), *keep).mapInArrow(split, schema)


LISTS = ["_part", "_numbers", "_lengths", "_bytes"]
CELLS = ["_low", "_middle", "_high", "_top"]  # bytes of the piece numbers; apart they compress best


def word_lists(pieces: list[bytes], parts: int) -> list[pa.Array]:
    """A batch's pieces by part: (part, their numbers, their lengths, their bytes)."""
    part = np.fromiter((zlib.crc32(piece) % parts for piece in pieces), dtype=np.int64, count=len(pieces))
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    some = np.flatnonzero(np.diff(cuts) > 0)
    bodies = [pieces[i] for i in order.tolist()]
    lengths = np.fromiter(map(len, bodies), dtype=np.uint32, count=len(bodies))
    return [
        pa.array(some.astype(np.int32)),
        pa.array([narrow(np.diff(order[cuts[p]:cuts[p + 1]], prepend=0)) for p in some], pa.binary()),
        pa.array([narrow(lengths[cuts[p]:cuts[p + 1]]) for p in some], pa.binary()),
        pa.array([zlib.compress(b"".join(bodies[cuts[p]:cuts[p + 1]]), 1) for p in some], pa.binary()),
    ]


def planes(numbers: np.ndarray, ranges: np.ndarray, limit: int) -> list[pa.Array]:
    """The texts' numbers by bytes, a binary column per byte; bytes above the largest number are left out."""
    by_byte = np.ascontiguousarray(numbers, dtype="<u4").view(np.uint8).reshape(-1, 4)
    none = pa.array([b""] * (len(ranges) - 1), pa.binary())
    return [binaries(np.ascontiguousarray(by_byte[:, i]), ranges) if i == 0 or limit > 1 << 8 * i else none for i in range(4)]


def joined_planes(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers of all texts, each text's range in them)."""
    low, ranges = concatenated(columns[0], np.uint8)
    numbers = low.astype(np.int64)
    for i, column in enumerate(columns[1:], 1):
        plane, _ = concatenated(column, np.uint8)
        if len(plane):
            numbers |= plane.astype(np.int64) << 8 * i
    return numbers, ranges


def narrow(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in the narrowest of 1, 2 or 4 bytes, which the first byte names."""
    most = int(values.max()) if len(values) else 0
    kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)


def cut_pieces(lengths: bytes, packed: bytes) -> list[bytes]:
    ends, body = np.cumsum(widened(lengths)).tolist(), zlib.decompress(packed)
    return [body[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905 - one start more than ends


def distinct_pieces(lists: DataFrame, tokens: list[bytes], long: int = LONG) -> DataFrame:
    """(part, piece, ids): the distinct pieces of all batches, with ids only where a piece is a token or has over ``long`` bytes."""
    spelled = lists.sparkSession.sparkContext.broadcast(tokens)  # the vocabulary

    def distinct(rows: pa.Table) -> pa.Table:
        found: set[bytes] = set()
        for lengths, body in zip(rows["_lengths"].to_pylist(), rows["_bytes"].to_pylist(), strict=True):
            found.update(cut_pieces(lengths, body))
        pieces = sorted(found)
        ranks = {token: rank for rank, token in enumerate(spelled.value)}
        longest = max(map(len, ranks))
        ids = [[ranks[p]] if p in ranks else heap_merged(p, ranks, longest) if len(p) > long else None for p in pieces]
        return pa.table({
            "part": pa.array(np.full(len(pieces), rows["_part"][0].as_py(), np.int32)), "piece": pa.array(pieces, pa.binary()).cast(pa.string()),
            "ids": pa.array(ids, pa.list_(pa.int32()))})

    return lists.select("_part", "_lengths", "_bytes").groupBy("_part").applyInArrow(distinct, "part int, piece string, ids array<int>")


def ids_of_batches(lists: DataFrame, known: DataFrame) -> DataFrame:
    """(batch, part, sizes, ids): for each batch the ids of its pieces, part by part."""
    def look_up(rows: pa.Table, known: pa.Table) -> pa.Table:
        places = {piece: i for i, piece in enumerate(known["piece"].cast(pa.binary()).to_pylist())}
        starts, values = flat_lists(known["ids"])
        sizes, ids = [], []
        for lengths, body in zip(rows["_lengths"].to_pylist(), rows["_bytes"].to_pylist(), strict=True):
            own = np.array([places[piece] for piece in cut_pieces(lengths, body)], dtype=np.int64)
            taken, n = take_lists(starts, values, own)
            sizes.append(narrow(n))
            ids.append(narrow(taken))
        return pa.table({"batch": rows["_origin"], "place": rows["_part"], "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(ids, pa.binary())})

    lists = lists.select("_origin", "_part", "_lengths", "_bytes")
    return lists.groupBy("_part").cogroup(known.groupBy("part")).applyInArrow(look_up, "batch bigint, place int, sizes binary, ids binary")


def flat_lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(where each list starts and the last ends, all values) of a list column."""
    values, starts = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    for part in column.chunks:
        offsets = part.offsets.to_numpy().astype(np.int64)
        values.append(part.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]])
        starts.append(offsets[1:] - offsets[0] + starts[-1][-1])
    return np.concatenate(starts), np.concatenate(values)


def take_lists(starts: np.ndarray, values: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of the lists ``which`` one after another, the length of each)."""
    lengths = np.diff(starts)[which]
    ends = np.cumsum(lengths)
    at = np.repeat(starts[which] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
    return values[at], lengths


@contextmanager
def short_plans(spark: SparkSession, length: int = 10_000):
    """Plan descriptions are cut meanwhile: each of the many that a query leaves would spell out the rank map."""
    setting = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(setting)
    spark.conf.set(setting, length)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None, at_spaces: bool = True) -> DataFrame:
    """The columns ``keep`` (default: all) of every row, its token ``ids`` and the bytes ``decoded`` from them."""
    spark = docs.sparkSession
    keep = list(docs.columns) if keep is None else keep
    names = [f"_k{i}" for i in range(len(keep))]  # whatever the columns are called
    docs = docs.select(F.col(text).alias("_text"), *(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)))
    tokens, parts = read_ranks(ranks_path), int(spark.conf.get("spark.sql.shuffle.partitions"))
    # bucketed by batch, so that the cells of a batch stay where they are when its ids come
    table = f"bpe_cells_{uuid.uuid4().hex}"
    split_batches(docs, "_text", pattern, names, parts, at_spaces).write.bucketBy(parts, "_origin").option("path", new_folder(spark, "cells")).option(
        "compression", "zstd").format("parquet").saveAsTable(table)
    split = spark.table(table)
    lists = split.filter(F.col("_part").isNotNull()).select("_origin", *LISTS)
    with short_plans(spark):
        known = materialise(encoded_pieces(distinct_pieces(lists, tokens), tokens), name="encoded-pieces")
    ids = ids_of_batches(lists, known)
    rows = split.select("_origin", *names, *CELLS, "_part", "_numbers")
    spelled = spark.sparkContext.broadcast(tokens)  # the vocabulary

    def put_together(texts: pa.Table, words: pa.Table) -> pa.Table:
        listed = texts.filter(pc.is_valid(texts["_part"])).sort_by("_part")
        texts, words = texts.filter(pc.is_null(texts["_part"])), words.sort_by("place")
        none = np.zeros(0, np.int64)
        numbers = np.concatenate([none, *(np.cumsum(widened(n)) for n in listed["_numbers"].to_pylist())])
        sizes, values = (np.concatenate([none, *map(widened, words[c].to_pylist())]) for c in ("sizes", "ids"))
        order = np.argsort(numbers, kind="stable")
        values, sizes = take_lists(np.append(0, np.cumsum(sizes)), values, order)
        cells, ranges = joined_planes([texts[c] for c in CELLS])
        ids, lengths = take_lists(np.append(0, np.cumsum(sizes)), values.astype(np.int32), cells)
        ends = np.append(0, np.cumsum(lengths))[ranges]
        return pa.Table.from_arrays(
            [*(texts[c] for c in names), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), spelled_out(spelled.value, ids, ends)],
            names=[*names, "ids", "decoded"])

    schema = StructType([*(StructField(n, docs.schema[n].dataType) for n in names), StructField("ids", ArrayType(IntegerType())),
                         StructField("decoded", BinaryType())])
    out = rows.groupBy("_origin").cogroup(ids.groupBy("batch")).applyInArrow(put_together, schema)
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), "ids", "decoded")


def spelled_out(tokens: list[bytes], ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of the tokens of each range of ``ids``, concatenated."""
    taken = pa.array(tokens, pa.large_binary()).take(pa.array(ids))
    body, starts = concatenated(taken, np.uint8)
    return binaries(body, starts[ends])


def decode(ids: Column, ranks_path: str) -> Column:
    """The bytes of token ids: their tokens, concatenated."""
    spelled = ",".join(f'"{base64.b64encode(token).decode()}"' for token in read_ranks(ranks_path))
    by_rank = F.from_json(F.lit(f"[{spelled}]"), "array<binary>")
    return F.aggregate(ids, F.lit(b""), lambda done, rank: F.concat(done, F.get(by_rank, rank)))
