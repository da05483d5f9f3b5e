"""Benchmark decontamination by latent semantic retrieval.

Documents are read as passages of ``PASSAGE`` words. Passages are TF-IDF vectors over hashed words, written once. A randomised singular
value decomposition of all of them takes two passes over these: random signed sums of passages span the range, and the passages' products
in that range give singular values and vectors. The latent space gives its directions equal weight. Windows that overlap by half are compared with the passages of the benchmark items in it; pairs above ``cosine`` are
candidates. In a window of ``PASSAGE`` words a word that repeats beside a short item outweighs it, so items of up to ``PASSAGE`` words are
also compared by windows of ``SHORT`` words. An item that stands whole in a document is a candidate whatever its cosine: its words but
the first and last, which punctuation may touch, are looked up by their hashes. A candidate is checked on the words: the longest common
subsequence of the item and the document around the window, as a share of the item, and the item's answer.

What comes to the driver or is broadcast has a fixed size (``2**BITS`` numbers by ``RANK + EXTRA``) or follows the benchmark. The
benchmark is a list of test items, so it is collected; it must be small against a task's memory.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased and without punctuation at the ends. Null and empty texts match nothing. Null ids are
kept as ids. Without an answer column an item's answer is its last ``ANSWER`` words.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from ..storage import materialise
from .textarrays import Chunk, Words, chunks, windows, words_of

BITS, RANK, EXTRA = 14, 96, 8
PASSAGE, STEP = 32, 16
SHORT, SHORT_STEP = 16, 8
SEED = 4  # words of a whole item that are looked up before the others are compared
COSINE, SHARE, ANSWERED_SHARE, ANSWER = 0.5, 0.75, 0.6, 6
BLOCK, GATHER = 1024, 1 << 14
EDGES = re.compile(r"^[^\w]+|[^\w]+$")


def columns_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def blocks_of(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each block of ``size`` words, its text): blocks do not cross texts; the last of a text may be shorter."""
    lengths = np.diff(offsets)
    counts = -(-lengths // size)
    owner = np.repeat(np.arange(len(lengths)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return offsets[:-1][owner] + place * size, owner


def entries_of(columns: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, column, times) of the words between ``starts``."""
    passage = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(columns))))
    both, times = np.unique(passage << BITS | columns, return_counts=True)
    return both >> BITS, both & ((1 << BITS) - 1), times


def passages(docs: DataFrame, text: str) -> DataFrame:
    """(first, columns, times) of the passages of each chunk of texts: where each passage's entries start, and the entries.

    Written once, since three passes read them: the words are cut and hashed a single time.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                words = words_of(chunk, lower=True)
                starts, _ = blocks_of(words.offsets, PASSAGE)
                if len(starts):
                    passage, columns, times = entries_of(columns_of(words.hashes), starts)
                    first = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
                    yield pa.RecordBatch.from_pydict({
                        name: pa.array([values.astype(kind).tobytes()], pa.binary())
                        for name, values, kind in (("first", first, np.uint32), ("columns", columns, np.uint16), ("times", times, np.uint8))})

    return materialise(docs.select(F.col(text).alias("_text")).mapInArrow(cut, "first binary, columns binary, times binary"), name="passages")


def read_passages(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first, columns, times) chunk by chunk."""
    for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
        first, columns, times = (np.frombuffer(data, kind) for data, kind in zip(row, (np.uint32, np.uint16, np.uint8), strict=True))
        yield first.astype(np.int64), columns.astype(np.int64), times


def passage_frequencies(cut: DataFrame) -> tuple[int, np.ndarray]:
    """(passages, in how many each column occurs)."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, dtype=np.int64), 0
        for batch in batches:
            for first, columns, _ in read_passages(batch):
                total += np.bincount(columns, minlength=1 << BITS)
                n += len(first)
        blocks = total.reshape(-1, BLOCK)
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(np.arange(-1, len(blocks)), pa.int32()),
            "sums": pa.array([np.array([n]).tobytes(), *(b.tobytes() for b in blocks)], pa.binary())})

    found = dict(summed(cut.mapInArrow(counted, "block int, sums binary"), np.int64).collect())
    if not found:
        return 0, np.zeros(1 << BITS, dtype=np.int64)
    n = int(np.frombuffer(found[-1], np.int64)[0])
    return n, np.concatenate([np.frombuffer(found[b], np.int64) for b in range((1 << BITS) // BLOCK)])


def summed(parts: DataFrame, dtype) -> DataFrame:
    """(block, sums): arrays of the same block added up."""
    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype) for x in rows["sums"].to_pylist())
        return pa.table({"block": rows["block"].slice(0, 1), "sums": pa.array([total.astype(dtype).tobytes()], pa.binary())})

    return parts.groupBy("block").applyInArrow(add, "block int, sums binary")


def unit_passages(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first entry of each passage, columns, values) chunk by chunk, each passage of length 1."""
    for batch in batches:
        for first, columns, times in read_passages(batch):
            value = (times * idf[columns]).astype(np.float32)
            norm = np.sqrt(np.maximum(np.add.reduceat(value * value, first), 1e-12))
            yield first, columns, value / np.repeat(norm, np.diff(np.append(first, len(columns))))


def gathered(table: np.ndarray, columns: np.ndarray, values: np.ndarray | None, first: np.ndarray) -> np.ndarray:
    """Sum of the columns' rows of ``table`` from each ``first`` to the next, a part at a time to stay in cache."""
    out = np.empty((len(first), table.shape[1]), dtype=np.float32)
    ends = np.append(first, len(columns))
    step = max(GATHER // max(len(columns) // max(len(first), 1), 1), 1)
    for a in range(0, len(first), step):
        b = min(a + step, len(first))
        rows = table[columns[ends[a]:ends[b]]]
        if values is not None:
            rows *= values[ends[a]:ends[b], None]
        out[a:b] = np.add.reduceat(rows, first[a:b] - ends[a], axis=0)
    return out


def latent_space(cut: DataFrame, idf: np.ndarray, seed: int = 11) -> np.ndarray:
    """One vector per column: idf times right singular vectors of the passage matrix, each over its singular value."""
    spark, width, size = cut.sparkSession, 1 << BITS, RANK + EXTRA
    weights = spark.sparkContext.broadcast(idf.astype(np.float32))

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dice = np.random.default_rng((seed, TaskContext.get().partitionId()))
        total = np.zeros(size * width, dtype=np.float32)
        for first, columns, values in unit_passages(batches, weights.value):
            counts = np.diff(np.append(first, len(columns)))
            row, sign = dice.integers(0, size, len(first)), dice.choice(np.array([-1, 1], np.float32), len(first))
            np.add.at(total, np.repeat(row, counts) * width + columns, values * np.repeat(sign, counts))
        rows = total.reshape(size, width)
        yield pa.RecordBatch.from_pydict({"block": pa.array(np.arange(size), pa.int32()), "sums": pa.array([r.tobytes() for r in rows], pa.binary())})

    found = dict(summed(cut.mapInArrow(ranged, "block int, sums binary"), np.float32).collect())
    if not found:
        return np.zeros((width, RANK), dtype=np.float32)
    basis, _ = np.linalg.qr(np.stack([np.frombuffer(found[b], np.float32) for b in range(size)]).T)
    del found
    shared = spark.sparkContext.broadcast(basis)

    def squared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for first, columns, values in unit_passages(batches, weights.value):
            inside = gathered(shared.value, columns, values, first)
            total += inside.T @ inside
        yield pa.RecordBatch.from_pydict({"block": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    product = np.frombuffer(summed(cut.mapInArrow(squared, "block int, sums binary"), np.float64).first()["sums"]).reshape(size, size)
    shared.destroy()
    weights.destroy()
    values, vectors = np.linalg.eigh(product)
    values, vectors = values[::-1][:RANK], vectors[:, ::-1][:, :RANK]
    singular = np.sqrt(np.maximum(values, 1e-9 * max(values[0], 1e-12)))
    return (basis @ (vectors / singular) * idf[:, None]).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def plain_words(text: str | None) -> list[str]:
    """Words without outer punctuation; words of punctuation alone go."""
    lower = re.sub(r"[A-Z]+", lambda m: m[0].lower(), text or "")
    return [w for w in (EDGES.sub("", w) for w in re.findall(r"[^\x20\x09-\x0d]+", lower)) if w]


def subsequence(item: list[str], words: list[str]) -> int:
    """Length of the longest common subsequence, one bit per word of the item (Hyyrö)."""
    masks: dict[str, int] = defaultdict(int)
    for i, word in enumerate(item):
        masks[word] |= 1 << i
    full = (1 << len(item)) - 1
    row = full
    for word in words:
        if mask := masks.get(word):
            both = row & mask
            row = (row + both | row - both) & full
    return len(item) - row.bit_count()


class Items:
    """The benchmark: words, answers, and latent passages."""

    def __init__(self, rows: list[tuple], space: np.ndarray):
        self.ids, self.words, self.answers, self.inner = [], [], [], []
        vectors, owner, short_vectors, short_owner = [], [], [], []
        for key, text, answer in rows:
            words = plain_words(text)
            if not words:
                continue
            number = len(self.ids)
            self.ids.append(key)
            self.words.append(words)
            self.answers.append(plain_words(answer) or words[-ANSWER:])
            chunk = next(chunks(pa.array([text], pa.string())))
            hashes = words_of(chunk, lower=True).hashes
            self.inner.append(hashes[1:-1] if len(hashes) > 2 else hashes)
            columns = columns_of(hashes)
            for start in passage_starts(len(columns), PASSAGE, STEP):
                vectors.append(space[columns[start:start + PASSAGE]].sum(axis=0))
                owner.append(number)
            if len(columns) <= PASSAGE:
                parts = [columns[start:start + SHORT] for start in passage_starts(len(columns), SHORT, SHORT_STEP)]
                for part in [columns, *parts] if len(parts) > 1 else parts:
                    short_vectors.append(space[part].sum(axis=0))
                    short_owner.append(number)
        self.vectors, self.owner = stacked(vectors, space), np.array(owner, dtype=np.int64)
        self.short_vectors, self.short_owner = stacked(short_vectors, space), np.array(short_owner, dtype=np.int64)
        self.sets = [set(words) for words in self.words]
        self.seeds = self._seeds()

    def _seeds(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By number of words: (ascending hashes of the first so many of ``inner``, their items)."""
        own: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for number, inner in enumerate(self.inner):
            size = min(len(inner), SEED)
            hashes, _ = windows(Words(inner, inner, inner, np.array([0, len(inner)])), size)
            own[size].append((int(hashes[0]), number))
        return {size: (np.array([h for h, _ in sorted(pairs)], np.uint64), np.array([i for _, i in sorted(pairs)])) for size, pairs in own.items()}


def passage_starts(words: int, size: int, step: int) -> range | list[int]:
    return range(0, words - size + step, step) if words > size else [0]


def stacked(vectors: list[np.ndarray], space: np.ndarray) -> np.ndarray:
    return unit(np.array(vectors, dtype=np.float32)) if vectors else np.zeros((0, space.shape[1]), np.float32)


def read_items(benchmark: DataFrame, key: str, text: str, answer: str | None) -> list[tuple]:
    extra = F.col(answer) if answer else F.lit(None).cast("string")
    return [tuple(row) for row in benchmark.select(F.col(key), F.col(text), extra).collect()]


def with_next(sums: np.ndarray, owner: np.ndarray, step: int) -> np.ndarray:
    """Each block's sums and those ``step`` blocks on, where that is the same text."""
    joined = sums.copy()
    joined[:-step] += np.where((owner[step:] == owner[:-step])[:, None], sums[step:], 0)
    return joined


def candidates(words: Words, space: np.ndarray, items: Items, cosine: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, first word, words, item, cosine) of windows near an item's passage, each window and item once."""
    starts, owner = blocks_of(words.offsets, SHORT_STEP)
    if not len(starts) or not len(items.owner):
        return
    first = starts - words.offsets[owner]
    short = with_next(gathered(space, columns_of(words.hashes), None, starts), owner, 1)
    wide = np.flatnonzero(first % STEP == 0)
    sizes = [(PASSAGE, wide, with_next(short, owner, 2)[wide], items.vectors, items.owner)]
    if len(items.short_owner):
        sizes.append((SHORT, np.arange(len(starts)), short, items.short_vectors, items.short_owner))
    for size, places, sums, vectors, numbers in sizes:
        near = unit(sums) @ vectors.T
        window, passage = np.nonzero(near >= cosine)
        best: dict[tuple[int, int], float] = {}
        for pair, value in zip(zip(places[window].tolist(), numbers[passage].tolist(), strict=True), near[window, passage].tolist(), strict=True):
            best[pair] = max(value, best.get(pair, value))
        for (place, item), value in best.items():
            yield int(owner[place]), int(first[place]), size, item, value


def whole_items(words: Words, space: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, first word, words, item, cosine) where all of an item's inner words stand in a row."""
    for size, (seeds, numbers) in items.seeds.items():
        hashes, inside = windows(words, size)
        low, high = np.searchsorted(seeds, hashes), np.searchsorted(seeds, hashes, side="right")
        for place in np.flatnonzero(inside & (high > low)).tolist():
            row = int(np.searchsorted(words.offsets, place, side="right")) - 1
            for item in numbers[low[place]:high[place]].tolist():
                inner = items.inner[item]
                if place + len(inner) > words.offsets[row + 1] or (words.hashes[place:place + len(inner)] != inner).any():
                    continue
                columns = columns_of(words.hashes[place:place + len(inner)])
                near = unit(space[columns].sum(axis=0)[None]) @ items.vectors[items.owner == item].T
                start = max(place - 1, int(words.offsets[row]))
                yield row, start - int(words.offsets[row]), len(inner) + 2, item, float(near.max())


def found_in(
    chunk: Chunk, words: Words, space: np.ndarray, items: Items, cosine: float, share: float, answered_share: float,
) -> dict[tuple[int, int], tuple[int, float, int, bool]]:
    """(common words, cosine, -first word, answered) of the best window, by text of the chunk and item."""
    best: dict[tuple[int, int], tuple[int, float, int, bool]] = {}

    def check(row: int, start: int, size: int, item: int, near: float) -> None:
        whole = items.words[item]
        low = words.offsets[row] + max(start - len(whole), 0)
        high = min(words.offsets[row] + start + size + len(whole), words.offsets[row + 1])
        around = plain_words(chunk.data[words.starts[low]:words.ends[high - 1]].tobytes().decode())
        if len(items.sets[item].intersection(around)) < answered_share * len(items.sets[item]) / 2:
            return
        common = subsequence(whole, around)
        answered = subsequence(items.answers[item], around) == len(items.answers[item])
        if common >= share * len(whole) or (answered and common >= answered_share * len(whole)):
            found = (common, near, -start, answered)
            if (row, item) not in best or found > best[row, item]:
                best[row, item] = found

    for window in candidates(words, space, items, cosine):
        check(*window)
    for row, start, size, item, near in whole_items(words, space, items):
        if (row, item) not in best:
            check(row, start, size, item, near)
    return best


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    answer: str | None = None, cosine: float = COSINE, share: float = SHARE, answered_share: float = ANSWERED_SHARE,
) -> DataFrame:
    """(key, item_key, first_word, cosine, common, item_words, answered) for each document and item that it leaks.

    A document leaks an item if ``share`` of the item's words are a common subsequence of item and document around a candidate window,
    or ``answered_share`` are and the item's answer is there too. The best window of a document and item is given.
    """
    spark = docs.sparkSession
    rows = read_items(benchmark, item_key, item_text, answer)
    cut = passages(docs, text)
    n, df = passage_frequencies(cut)
    space = latent_space(cut, np.log((1.0 + n) / (1.0 + df)))
    return matches(spark, docs, Items(rows, space), space, key, text, item_key, benchmark.schema[item_key].dataType, cosine, share, answered_share)


def matches(spark: SparkSession, docs, items: Items, space, key, text, item_key, item_type, cosine, share, answered_share) -> DataFrame:
    shared = spark.sparkContext.broadcast((items, space))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, space = shared.value
        for batch in batches:
            best: dict[tuple[int, int], tuple] = {}
            for chunk in chunks(batch.column(0)):
                found = found_in(chunk, words_of(chunk, lower=True), space, items, cosine, share, answered_share)
                best |= {(chunk.first + row, item): value for (row, item), value in found.items()}
            places = sorted(best)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array([row for row, _ in places], pa.int64())),
                 pa.array([items.ids[item] for _, item in places], item_arrow),
                 pa.array([-best[p][2] for p in places], pa.int64()), pa.array([best[p][1] for p in places], pa.float64()),
                 pa.array([best[p][0] for p in places], pa.int64()), pa.array([len(items.words[item]) for _, item in places], pa.int64()),
                 pa.array([best[p][3] for p in places], pa.bool_())],
                names=[key, item_key, "first_word", "cosine", "common", "item_words", "answered"])

    item_arrow = to_arrow_type(item_type)
    schema = StructType([
        StructField(key, docs.schema[key].dataType), StructField(item_key, item_type), StructField("first_word", LongType()),
        StructField("cosine", DoubleType()), StructField("common", LongType()), StructField("item_words", LongType()),
        StructField("answered", BooleanType()),
    ])
    return docs.select(F.col(text).alias("_text"), F.col(key).alias("_key")).mapInArrow(check, schema)
