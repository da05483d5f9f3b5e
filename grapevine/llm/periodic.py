"""Runs: the maximal stretches of words that repeat with a period, found by internal pattern matching.

Texts are read as numbers of words, many texts in one array. Prefix doubling sorts the suffixes and names every stretch of 1, 2, 4, ..
words, so the suffixes that start with a given block are one interval of the suffix array; a wavelet tree over the array tells the next
occurrence of the block after any place (range successor). A run of period q holds an aligned (dyadic) block of about q / 2 words
whose copy q words on is in the run too. So each block is looked for in the window of distances that its size serves. Occurrences
that overlap by half form a progression whose difference is the block's own period: it lies in a stretch of that period, and a longer
period that maps it to another such stretch maps start to start or end to end. A progression thus gives three candidates, however many
occurrences it has. A candidate is widened both ways by the names, and is a run if it is long enough; of the periods found for one
stretch the smallest counts.

Work is n log n in a text's words and no row leaves its task; a task holds about 300 bytes per word of ``CHUNK_WORDS`` words, or of one
text if that is longer. Names are exact, so nothing rests on hashes.

Words are ``[^\\x20\\x09-\\x0D]+``. Null, empty and white texts have no words and no runs. Each input row is one output row, whatever its
other columns, ids and repetitions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .line_runs import bound

MIN_LENGTH = 12
CHUNK_WORDS = 1 << 17
WORD = r"[^\x20\x09-\x0D]+"
RUN = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())])


class Suffixes:
    """The sorted suffixes of an array and names of its stretches.

    Every text ends in a number of its own, and no number occurs in two texts. ``names[k]`` gives each place the
    name of the ``2 ** k`` numbers from it: the first place that such suffixes take in sorted order.
    """

    def __init__(self, numbers: np.ndarray):
        n = len(numbers)
        order = np.argsort(numbers)
        own = numbers[order]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, n))
        name = np.empty(n, dtype=np.int64)
        name[order] = np.repeat(starts, sizes)
        self.names = [name]
        places = np.flatnonzero(np.repeat(sizes > 1, sizes))  # of suffixes that are not alone yet
        reach = 1
        while len(places):
            open_suffixes = order[places]
            key = name[open_suffixes] * (n + 1) + name[open_suffixes + reach]
            within = np.argsort(key)
            key, open_suffixes = key[within], open_suffixes[within]
            order[places] = open_suffixes
            first = np.append(True, key[1:] != key[:-1])
            starts = np.flatnonzero(first)
            sizes = np.diff(np.append(starts, len(key)))
            name = name.copy()
            name[open_suffixes] = np.repeat(places[starts], sizes)
            self.names.append(name)
            places = places[np.repeat(sizes > 1, sizes)]
            reach *= 2
        self.order = order

    def interval(self, level: int) -> np.ndarray:
        """How many suffixes share the name of each place."""
        return np.bincount(self.names[level], minlength=len(self.order))

    def common_after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers from ``a`` equal those from ``b``."""
        done = np.zeros(len(a), dtype=np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name = self.names[level]
            done += (name[a + done] == name[b + done]).astype(np.int64) << level
        return done

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers before ``a`` equal those before ``b``; a lies before b."""
        done = np.zeros(len(a), dtype=np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name, step = self.names[level], 1 << level
            at, to = a - done - step, b - done - step
            same = (at >= 0) & (name[np.maximum(at, 0)] == name[np.maximum(to, 0)])
            done += same.astype(np.int64) << level
        return done


class WaveletTree:
    """Bits of a list of numbers from the highest down, stably parted at each, to answer order queries over its ranges."""

    def __init__(self, values: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(max(int(values.max(initial=0)).bit_length(), 1) - 1, -1, -1):
            high = (values >> bit & 1).astype(bool)
            zeros_before = np.zeros(len(values) + 1, dtype=np.int32)
            np.cumsum(~high, out=zeros_before[1:])
            self.levels.append((bit, zeros_before, int(zeros_before[-1])))
            values = np.concatenate([values[~high], values[high]])

    def below(self, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many numbers of each range are under the range's limit, which no more bits than the numbers may need."""
        count = np.zeros(len(low), dtype=np.int64)
        for bit, zeros_before, zeros in self.levels:
            a, b = zeros_before[low].astype(np.int64), zeros_before[high].astype(np.int64)
            one = (limit >> bit & 1).astype(bool)
            count += np.where(one, b - a, 0)
            low, high = np.where(one, zeros + low - a, a), np.where(one, zeros + high - b, b)
        return count

    def ranked(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The number with so many smaller ones in each range."""
        value = np.zeros(len(low), dtype=np.int64)
        for bit, zeros_before, zeros in self.levels:
            a, b = zeros_before[low].astype(np.int64), zeros_before[high].astype(np.int64)
            one = rank >= b - a
            rank = np.where(one, rank - (b - a), rank)
            value |= one.astype(np.int64) << bit
            low, high = np.where(one, zeros + low - a, a), np.where(one, zeros + high - b, b)
        return value

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, none: int) -> np.ndarray:
        """The smallest number of each range that is not under ``least``, else ``none``."""
        inside = least < none
        rank = self.below(low, high, np.where(inside, least, 0))
        found = inside & (rank < high - low)
        out = np.full(len(low), none, dtype=np.int64)
        out[found] = self.ranked(low[found], high[found], rank[found])
        return out


def distance_windows(longest: int, min_length: int) -> list[tuple[int, int, int]]:
    """(level, least, most): which periods are found by blocks of ``2 ** level`` words.

    The first aligned block in a run of length m = max(min_length, 2q) starts less than its size B after the run does, so it
    and its copy q words on are inside if q + 2 * B - 1 <= m.
    """
    out: list[tuple[int, int, int]] = []
    period = 1
    while 2 * period <= longest:
        slack = max(min_length, 2 * period) - period
        level = max((slack + 1) // 2, 1).bit_length() - 1
        if 2 * period <= min_length:
            last = period
        else:  # as far as the same block serves
            last = max((4 << level) - 2, period)
        if out and out[-1][0] == level and out[-1][2] == period - 1:
            out[-1] = (level, out[-1][1], last)
        else:
            out.append((level, period, last))
        period = last + 1
    return out


def candidates(suffixes: Suffixes, tree: WaveletTree, level: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance): aligned blocks and the distances that their occurrences in the window suggest."""
    n, size, name = len(suffixes.order), 1 << level, suffixes.names[level]
    blocks = np.arange(0, n, size)
    counts = suffixes.interval(level)[name[blocks]]
    blocks, counts = blocks[counts > 1], counts[counts > 1]
    low = name[blocks].copy()
    high = low + counts
    after, limit = blocks + least, blocks + most
    places, distances = [], []
    while len(blocks):
        found = tree.successor(low, high, after, n)
        some = found <= np.minimum(limit, n - 1)
        blocks, low, high, found, limit = blocks[some], low[some], high[some], found[some], limit[some]
        places.append(blocks)
        distances.append(found - blocks)
        second = tree.successor(low, high, found + 1, n)
        gap = second - found
        after = found + 1
        row = np.flatnonzero((second < n) & (2 * gap <= size))
        if len(row):  # a progression: stretches of the block's own period around the block and around the occurrence
            own, far, step = blocks[row], found[row], gap[row]
            start = own - suffixes.common_before(own, own + step)
            end = own + step + suffixes.common_after(own, own + step)
            far_start = far - suffixes.common_before(far, far + step)
            far_end = far + step + suffixes.common_after(far, far + step)
            for distance in (far_start - start, far_end - end):
                fits = (distance >= least) & (distance <= most)
                places.append(own[fits])
                distances.append(distance[fits])
            after[row] = far_end - size + 1
    return np.concatenate(places, dtype=np.int64) if places else np.zeros(0, np.int64), (
        np.concatenate(distances, dtype=np.int64) if distances else np.zeros(0, np.int64))


def runs_of(numbers: np.ndarray, longest: int, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period. ``numbers`` are as ``Suffixes`` wants them; ``longest`` is the longest text."""
    suffixes = Suffixes(numbers)
    tree = WaveletTree(suffixes.order)
    starts, ends, periods = [], [], []
    for level, least, most in distance_windows(longest, min_length):
        if level >= len(suffixes.names):
            break
        place, period = candidates(suffixes, tree, level, least, most)
        inside = place + period < len(numbers)
        place, period = place[inside], period[inside]
        start = place - suffixes.common_before(place, place + period)
        end = place + period + suffixes.common_after(place, place + period)
        long = end - start >= np.maximum(min_length, 2 * period)
        starts.append(start[long])
        ends.append(end[long])
        periods.append(period[long])
    if not starts:
        return (np.zeros(0, np.int64),) * 3
    start, end, period = (np.concatenate(part) for part in (starts, ends, periods))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    smallest = np.ones(len(start), dtype=bool)
    smallest[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[smallest], end[smallest], period[smallest]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


class Numbers(dict):
    """Numbers words in order of their first look-up."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def runs_of_texts(texts: list[list[str]], min_length: int) -> tuple[list[list[tuple[int, int, int]]], list[np.ndarray]]:
    """((start, length, period) of every run, which words are kept) of each text, given as words."""
    numbers = Numbers()
    lengths = np.array([len(words) for words in texts], dtype=np.int64)
    flat = np.fromiter((numbers[word] for words in texts for word in words), dtype=np.int64, count=int(lengths.sum()))
    owner = np.repeat(np.arange(len(texts)), lengths)
    width = len(numbers) + 1
    # each text's words as numbers of its own, and a last number that no text has twice
    offsets = np.append(0, np.cumsum(lengths + 1))
    whole = np.empty(int(offsets[-1]), dtype=np.int64)
    whole[np.arange(len(flat)) + owner] = owner * width + flat
    whole[offsets[1:] - 1] = np.arange(len(texts)) * width + width - 1
    start, end, period = runs_of(whole, int(lengths.max(initial=0)), min_length)
    change = np.zeros(len(whole) + 1, dtype=np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    kept = np.cumsum(change[:-1]) == 0
    bounds = np.searchsorted(start, offsets)
    found, masks = [], []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        found.append(list(zip((start[a:b] - offsets[i]).tolist(), (end[a:b] - start[a:b]).tolist(), period[a:b].tolist(), strict=True)) if b > a else [])
        masks.append(kept[offsets[i]:offsets[i + 1] - 1])
    return found, masks


def word_chunks(texts: list[str | None], limit: int = CHUNK_WORDS) -> Iterator[list[list[str]]]:
    """The words of consecutive texts, about ``limit`` in all, one text at least."""
    find = re.compile(WORD).findall
    own, size = [], 0
    for text in texts:
        words = find(text or "")
        if own and size + len(words) > limit:
            yield own
            own, size = [], 0
        own.append(words)
        size += len(words) + 1
    if own:
        yield own


def find_runs(docs: DataFrame, text: str, keep: list[str], min_length: int = MIN_LENGTH) -> DataFrame:
    """The columns ``keep`` of every row, ``n_words``, its ``runs`` by start and period, and ``collapsed``: the words that are in no run
    after the run's first period, joined by one space.

    A run is a stretch of at least ``min_length`` words and two periods that no neighbouring word extends; period is its smallest.
    """
    schema = StructType([docs.schema[c] for c in keep] + [
        StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            counts, runs, collapsed = [], [], []
            for texts in word_chunks(batch.column(0).to_pylist()):
                own, masks = runs_of_texts(texts, min_length)
                for words, of_text, kept in zip(texts, own, masks, strict=True):
                    counts.append(len(words))
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in of_text])
                    if of_text:
                        words = [words[i] for i in np.flatnonzero(kept).tolist()]
                    collapsed.append(" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.string())],
                names=[*keep, "n_words", "runs", "collapsed"])

    return docs.select(F.col(text).alias("_read_text"), *keep).mapInArrow(found, schema)


def longest_run(runs: Column) -> Column:
    """The run of greatest length, ties by smallest start, then period; null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(F.size(runs) > 0, F.struct((-best["s"]).alias("start"), best["length"].alias("length"), (-best["p"]).alias("period")))


def with_planted_period(text: Column, key: Column) -> Column:
    """The text, for a tenth of the keys with its words from some place on replaced by repetitions of the first of them.

    With h = crc32 of the key as text and g = h / 10: if h % 10 = 0, each word i >= a = g % n becomes word a + (i - a) % p,
    p = 1 + (n - a) / (3 + g % 8). A null key changes nothing.
    """
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.greatest(F.size(words), F.lit(1)).cast("long")
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(words, lambda word, i: F.when(i >= a, F.get(words, a + (i - a) % p)).otherwise(word)), " ")

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)) & text.isNotNull(), bound(words, repeated)).otherwise(text)
