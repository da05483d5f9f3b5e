"""Substring dedup with one FM-index per shard.

Words that a window of 20 words covers go if the window's words also start earlier: in a text of a smaller key, or before it in the same
text. ``repeats`` sends every stretch that can hold such a window to the shard of its anchor. A shard indexes its distinct
stretches: a Burrows-Wheeler transform in a wavelet matrix of bit vectors with block counts. Windows are streamed against it by
backward search, all at once, one word to the left per step; a window whose interval shrinks to its own occurrence
is dropped, and what is left after 20 words is a match. The interval's earliest occurrence stays.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged, compared by 64-bit hashes. Null texts have no words. Rows that repeat key and text are one
document; a null key comes before all others. Texts with the same key are ordered by their digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .repeats import Unit, keyed, merged_spans, repeated_windows, with_repeats
from .textarrays import chunks, words_of

WINDOW, GRAM = 20, 6


class BitVector:
    """Bits with their count before each block of 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=bool)
        padded[:len(bits)] = bits
        self.blocks = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.blocks).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.zeros = int(len(bits) - bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        block = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.blocks[block] & below)


class FMIndex:
    """Counts and places of patterns of at most ``depth`` symbols in a text of symbols from 1; 0 separates its parts."""

    def __init__(self, text: np.ndarray, depth: int):
        self.order = suffix_order(text, depth)
        last = text[self.order - 1]
        sigma = int(text.max()) + 1
        counts = np.bincount(text, minlength=sigma)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.bits = max(int(sigma - 1).bit_length(), 1)
        self.levels = []
        for bit in reversed(range(self.bits)):
            ones = (last >> bit & 1).astype(bool)
            self.levels.append(BitVector(ones))
            last = np.concatenate([last[~ones], last[ones]])
        self.begin = self._down(np.zeros(sigma, dtype=np.int64), np.arange(sigma))

    def _down(self, i: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for bit, level in zip(reversed(range(self.bits)), self.levels, strict=True):
            ones = level.rank(i)
            i = np.where(symbol >> bit & 1 == 1, level.zeros + ones, i - ones)
        return i

    def start(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with a symbol."""
        return self.first[symbol], self.first[symbol + 1]

    def left(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one symbol more in front."""
        both = self._down(np.concatenate([low, high]), np.concatenate([symbol, symbol]))
        shift = self.first[symbol] - self.begin[symbol]
        return both[:len(low)] + shift, both[len(low):] + shift


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` in order of the ``depth`` symbols from there, by doubling."""
    rank, width = text.astype(np.int64), 1
    while width < depth:
        step = min(width, depth - width)
        behind = np.zeros_like(rank)
        behind[:-step] = rank[step:] + 1
        rank = np.unique(rank * (rank.max() + 2) + behind, return_inverse=True)[1]
        width += step
    return np.argsort(rank, kind="stable")


def later_windows(segments: pa.Table, window: int = WINDOW) -> np.ndarray:
    """For every window of the segments whether its words also start earlier; segments come in order of their places."""
    bodies, n = segments["units"].to_pylist(), segments["n"].to_numpy().astype(np.int64)
    words = np.frombuffer(b"".join(bodies), dtype=np.uint64)
    sizes = n + window - 1
    symbols = np.unique(words, return_inverse=True)[1] + 1
    text = np.zeros(len(words) + len(n), dtype=np.int64)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    text[np.arange(len(words)) + np.repeat(np.arange(len(n)), sizes)] = symbols
    index = FMIndex(text, window)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    at, active = place, np.arange(len(place))
    low, high = index.start(text[at + window - 1])
    for k in range(window - 2, -1, -1):
        more = high - low > 1  # others have no occurrence but their own
        at, active, low, high = at[more], active[more], low[more], high[more]
        low, high = index.left(low, high, text[at + k])
    # the earliest place of each interval: segments come in order of documents and places, and so do their windows
    age = np.full(len(text) + 1, len(text), dtype=np.int64)
    age[place] = np.arange(len(place))
    aged = np.append(age[index.order], len(text))
    flags = np.zeros(len(place), dtype=bool)
    if len(active):
        ends = np.unique(np.stack([low, high], axis=1), axis=0)
        least = np.minimum.reduceat(aged, ends.reshape(-1))[::2]
        flags[active] = age[at] > least[np.searchsorted(ends[:, 0], low)]
    return flags


def whole_texts(rows: DataFrame) -> DataFrame:
    """(key, t, u, n_words, whole_sha256 of the words joined by one space) of every row."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, marks = [], []
            for chunk in chunks(batch.column(0)):
                for n, body in joined_words(chunk):
                    counts.append(n)
                    marks.append(hashlib.sha256(body).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(counts, pa.int64()), pa.array(marks, pa.string())], names=["key", "t", "u", "n_words", "whole_sha256"])

    schema = f"key {rows.schema['key'].dataType.simpleString()}, t bigint, u bigint, n_words bigint, whole_sha256 string"
    return rows.select("text", "key", "t", "u").mapInArrow(counted, schema)


def joined_words(chunk) -> Iterator[tuple[int, bytes]]:
    """(words, their bytes joined by one space) of each text."""
    found = words_of(chunk)
    body = chunk.data.tobytes()
    for i in range(len(chunk)):
        a, b = found.offsets[i], found.offsets[i + 1]
        text = body[chunk.offsets[i]:chunk.offsets[i + 1]]
        yield int(b - a), b" ".join(text.split(None))  # bytes.split takes the same six bytes as white space


def repeated_spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(t, u, text, spans): ascending word ranges to remove from the first document of each text that has any.

    ``rows`` is ``repeats.keyed``. Later documents of a text lose all words if they have a window at all.
    """
    unit = Unit(words=True, length=window, gram=gram)
    open_rows = materialise(with_repeats(rows, unit), name="repeat-texts")
    found = repeated_windows(open_rows, unit, lambda segments: later_windows(segments, window))
    found = found.groupBy("t", "u").agg(F.collect_list(F.struct("start", "n")).alias("windows"))
    texts = open_rows.select("t", "u", "text").dropDuplicates(["t", "u"]).join(found, ["t", "u"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for windows in batch.column(3).to_pylist():
                starts, ends = merged_spans(np.array([w["start"] for w in windows]), np.array([w["n"] for w in windows]), window)
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(starts, ends, strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, SPANS)], names=["t", "u", "text", "spans"])

    return texts.select("t", "u", "text", "windows").mapInArrow(merge, "t bigint, u bigint, text string, spans array<struct<start:int,end:int>>")


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of every row: the digest of the kept words joined by one space."""
    rows = keyed(docs, key, text)
    all_rows = materialise(whole_texts(rows), name="whole-texts")
    first = all_rows.groupBy("t", "u").agg(F.min("key").alias("first"), F.count(F.when(F.col("key").isNull(), 1)).alias("nulls"))
    first = first.select("t", "u", F.when(F.col("nulls") == 0, F.col("first")).alias("first"))
    cut = kept_words(repeated_spans(rows, window, gram))
    names = {"t": "_t", "u": "_u"}
    whole = all_rows.join(first, ["t", "u"]).join(
        cut.withColumnsRenamed(names), (F.col("t") == F.col("_t")) & (F.col("u") == F.col("_u")) & F.col("key").eqNullSafe(F.col("first")), "left")
    later = ~F.col("key").eqNullSafe(F.col("first")) & (F.col("n_words") >= window)
    return whole.select(
        F.col("key").alias(key), "n_words",
        F.when(later, F.col("n_words")).otherwise(F.coalesce("cut_words", F.lit(0))).cast("long").alias("n_removed"),
        F.when(later, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha256", "whole_sha256")).alias("kept_sha256"),
    )


def kept_words(spans: DataFrame) -> DataFrame:
    """(t, u, cut_words, cut_sha256) of texts with word spans to remove."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, marks = [], []
            for text, ranges in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = text.encode().split(None)
                keep = np.ones(len(words), dtype=bool)
                for span in ranges:
                    keep[span["start"]:span["end"]] = False
                counts.append(int(len(words) - keep.sum()))
                marks.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(keep)])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(marks, pa.string())],
                names=["t", "u", "cut_words", "cut_sha256"])

    return spans.select("t", "u", "text", "spans").mapInArrow(cut, "t bigint, u bigint, cut_words bigint, cut_sha256 string")
