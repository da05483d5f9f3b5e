"""Where repeated stretches can be: what the two substring operators share.

A window is ``length`` units (words or bytes) in a row. Its anchor is the least hash among the grams (``gram`` units in a row) in it, so equal
windows have equal anchors, and consecutive windows mostly share one: a run. An anchor that only one run has cannot be in
a repeated window. The others are looked at, run by run: the units of a run (its segment) go to the shard of their
anchor, which holds every window that could equal one of them.

Texts are taken once each, by a digest of 128 bits; copies are left to the caller.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import materialise, release
from .line_runs import text_digest
from .signature_tree import numbered
from .textarrays import (
    Chunk, binaries, byte_grams, chunks, concatenated, mix, sliding_least, windows, words_of,
)

FLUSH_RUNS = 1 << 19
HOT_RUNS = 4096
HELD_SEGMENTS = 1 << 15
SHARDS = 8  # per shuffle partition: an index is built for one shard at a time
DIGEST = 16


@dataclass(frozen=True)
class Unit:
    """What windows are made of."""

    words: bool
    length: int
    gram: int

    def read(self, chunk: Chunk):
        """(gram hash at each unit, range of each text's units, units as fixed-width values)."""
        if self.words:
            found = words_of(chunk)
            return windows(found, self.gram)[0], found.offsets, found.hashes
        grams = byte_grams(chunk, self.gram)
        return np.append(grams, np.zeros(len(chunk.data) - len(grams), np.uint64)), chunk.offsets, chunk.data


def runs_of(unit: Unit, grams: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window in the text, windows, anchor, whether the anchor's gram occurs twice) of every run of windows."""
    least = sliding_least(grams, unit.length - unit.gram + 1)
    lengths = np.diff(offsets)
    counts = np.maximum(lengths - unit.length + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), counts)
    first = np.cumsum(counts) - counts
    place = np.arange(len(owner)) - np.repeat(first, counts)
    anchor = least[place + np.repeat(offsets[:-1], counts)]
    edge = np.ones(len(owner), dtype=bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(edge)
    owner, place, anchor, n = owner[at], place[at], anchor[at], np.diff(np.append(at, len(owner)))
    span = unit.length - unit.gram + 1  # grams in a window
    hits = np.zeros(len(at), dtype=np.int64)
    base = place + offsets[:-1][owner]
    for k in range(2 * span):
        inside = np.minimum(base + k, len(grams) - 1)
        hits += (grams[inside] == anchor) & (k < n - 1 + span)
    return owner, place, n, anchor, (n > span) | (hits > 1)


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, t, u): null texts empty, and their digest."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.withColumns({"t": text_digest(F.col("text"))["t"], "u": text_digest(F.col("text"))["u"]})


def digests(batch: pa.RecordBatch, t: int, u: int) -> np.ndarray:
    """The two halves of the digests as rows of 16 bytes."""
    pair = np.stack([batch.column(t).to_numpy(), batch.column(u).to_numpy()], axis=1).astype(np.int64)
    return np.ascontiguousarray(pair).view(np.uint8).reshape(-1, DIGEST)


def packed_runs(rows: DataFrame, unit: Unit, parts: int) -> DataFrame:
    """(part, texts, counts, starts, lengths, anchors): runs by part of the anchor's hash range, text by text, as packed arrays."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held, total = [], 0
        for batch in batches:
            names = digests(batch, 1, 2)
            fresh = np.array([not (k in seen or seen.add(k)) for k in map(bytes, names)], dtype=bool)
            for chunk in chunks(batch.column(0)):
                grams, offsets, _ = unit.read(chunk)
                owner, start, n, anchor, twice = runs_of(unit, grams, offsets)
                keep = fresh[chunk.first:chunk.last][owner]
                held.append((names[chunk.first:chunk.last][owner[keep]], start[keep], (n << 1 | twice)[keep], anchor[keep]))
                total += int(keep.sum())
                if total >= FLUSH_RUNS:
                    yield flush(held)
                    held, total = [], 0
        if total:
            yield flush(held)

    def flush(held):
        names, start, n, anchor = (np.concatenate([h[i] for h in held]) for i in range(4))
        part = (mix(anchor) >> np.uint64(40)).astype(np.int64) % parts
        order = np.argsort(part, kind="stable")
        part, names, start, n, anchor = part[order], names[order], start[order], n[order], anchor[order]
        edge = np.ones(len(part), dtype=bool)
        edge[1:] = (part[1:] != part[:-1]) | (names[1:] != names[:-1]).any(axis=1)
        at = np.flatnonzero(edge)
        counts = np.diff(np.append(at, len(part))).astype(np.uint32)
        cuts = np.searchsorted(part[at], np.arange(parts + 1))
        runs = np.append(at, len(part))[cuts]
        some = pa.array(np.flatnonzero(np.diff(cuts) > 0).astype(np.int32))
        arrays = [(np.ascontiguousarray(names[at]).reshape(-1), cuts * DIGEST), (counts, cuts), (start.astype(np.uint32), runs),
                  (n.astype(np.uint32), runs), (anchor, runs)]
        return pa.RecordBatch.from_arrays(
            [some, *(binaries(x, o).take(some) for x, o in arrays)], names=["part", "texts", "counts", "starts", "lengths", "anchors"])

    schema = "part int, texts binary, counts binary, starts binary, lengths binary, anchors binary"
    return rows.select("text", "t", "u").mapInArrow(pack, schema)


def repeated_runs(packed: DataFrame, buckets: int) -> DataFrame:
    """(t, u, runs): for each text its runs (start, n, anchor, hot) whose anchor another run has too.

    Parts pass them on packed by buckets of texts, and a bucket puts each text's runs together.
    """
    def repeated(rows: pa.Table) -> pa.Table:
        names, _ = concatenated(rows["texts"], np.dtype(f"V{DIGEST}"))
        counts, starts, lengths = (concatenated(rows[c], np.uint32)[0] for c in ("counts", "starts", "lengths"))
        anchors, _ = concatenated(rows["anchors"], np.uint64)
        first, number = numbered(names)
        owner = np.repeat(number, counts)
        order = np.lexsort((starts, owner, anchors))
        anchors, owner, starts, lengths = anchors[order], owner[order], starts[order], lengths[order]
        fresh = np.ones(len(anchors), dtype=bool)  # a text that two tasks sent counts once
        fresh[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1])
        anchors, owner, starts, lengths = anchors[fresh], owner[fresh], starts[fresh], lengths[fresh]
        edge = np.ones(len(anchors), dtype=bool)
        edge[1:] = anchors[1:] != anchors[:-1]
        at = np.flatnonzero(edge)
        n = np.diff(np.append(at, len(anchors)))
        times = np.repeat(n, n)
        keep = (times > 1) | (lengths & 1 == 1)  # a run may repeat windows of its own
        anchors, owner, starts, lengths, hot = anchors[keep], owner[keep], starts[keep], lengths[keep] >> 1, times[keep] > HOT_RUNS
        halves = np.frombuffer(names.tobytes(), dtype=np.uint64).reshape(-1, 2)[first]
        bucket = (halves[:, 0] % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((owner, bucket[owner]))
        owner, starts, lengths, anchors, hot = owner[order], starts[order], lengths[order], anchors[order], hot[order]
        at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        ends = np.append(at, len(owner))
        cuts = np.searchsorted(bucket[owner[at]], np.arange(buckets + 1))
        some = pa.array(np.flatnonzero(np.diff(cuts) > 0).astype(np.int32))
        own = np.frombuffer(names[first[owner[at]]].tobytes(), np.uint8)
        arrays = [(own, cuts * DIGEST), (np.diff(ends).astype(np.uint32), cuts), (starts, ends[cuts]), (lengths, ends[cuts]),
                  (anchors, ends[cuts]), (hot.astype(np.uint8), ends[cuts])]
        return pa.Table.from_arrays([some, *(binaries(x, o).take(some) for x, o in arrays)],
                                    names=["bucket", "texts", "counts", "starts", "lengths", "anchors", "hot"])

    def gathered(rows: pa.Table) -> pa.Table:
        names, _ = concatenated(rows["texts"], np.dtype(f"V{DIGEST}"))
        counts, starts, lengths = (concatenated(rows[c], np.uint32)[0] for c in ("counts", "starts", "lengths"))
        anchors, hot = concatenated(rows["anchors"], np.int64)[0], concatenated(rows["hot"], np.uint8)[0]
        first, number = numbered(names)
        owner = np.repeat(number, counts)
        order = np.lexsort((starts, owner))
        halves = np.frombuffer(names.tobytes(), dtype=np.int64).reshape(-1, 2)[first]
        offsets = np.append(0, np.cumsum(np.bincount(owner, minlength=len(first)))).astype(np.int32)
        runs = pa.StructArray.from_arrays(
            [pa.array(starts[order].astype(np.int32)), pa.array(lengths[order].astype(np.int32)), pa.array(anchors[order]),
             pa.array(hot[order].astype(bool))], names=["start", "n", "anchor", "hot"])
        return pa.Table.from_arrays(
            [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), runs)], names=["t", "u", "runs"])

    schema = "bucket int, texts binary, counts binary, starts binary, lengths binary, anchors binary, hot binary"
    buckets_of = packed.groupBy("part").applyInArrow(repeated, schema)
    return buckets_of.groupBy("bucket").applyInArrow(gathered, f"t bigint, u bigint, runs array<{RUN}>")


RUN = "struct<start:int,n:int,anchor:bigint,hot:boolean>"


def place_of_text() -> Column:
    """What a text's first row is dealt by: its copies have other keys, so they do not all go where it goes."""
    return F.xxhash64("t", "u", "key")


def same_text(t: str, u: str) -> Column:
    """Whether columns ``t``, ``u`` equal the digest, in a form that no join deals rows by."""
    return F.col("t").bitwiseXOR(F.col(t)).bitwiseOR(F.col("u").bitwiseXOR(F.col(u))) == 0


def with_repeats(rows: DataFrame, unit: Unit) -> DataFrame:
    """(key, text, t, u, place, runs) of the first row of each text that has runs with repeated anchors, dealt by ``place``.

    The runs are written first, so what led to them is gone before the texts move.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = materialise(repeated_runs(packed_runs(rows, unit, parts), parts), name="repeated-runs")
    release(spark)
    first = rows.select("key", "t", "u").groupBy("t", "u").agg(F.min("key").alias("key"))
    runs = runs.join(first, ["t", "u"]).select(
        F.col("t").alias("_t"), F.col("u").alias("_u"), place_of_text().alias("_place"), "runs")
    own = (F.col("place") == F.col("_place")) & same_text("_t", "_u")
    return rows.withColumn("place", place_of_text()).join(runs, own).drop("_t", "_u", "_place")


def segments(rows: DataFrame, unit: Unit) -> DataFrame:
    """(route, key, t, u, start, n, units, copies) of distinct segments, the first in order of (key, t, u, start).

    Copies are told apart from the first among ``HELD_SEGMENTS`` at a time; the shards do it for all. Rows without ``units`` are windows
    of later copies, neighbours in one row. A run of a hot anchor is
    cut into windows, and a window's route depends on its first and last gram, so that a frequent passage with different
    surroundings does not meet in one shard.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        best: dict[bytes, list] = {}
        later: list[tuple] = []
        for batch in batches:
            t, u, keys = (batch.column(i).to_pylist() for i in (1, 2, 3))
            lists = batch.column(4)
            ends, inner = lists.offsets.to_numpy(), lists.values
            starts, counts = (inner.field(f).to_numpy() for f in ("start", "n"))
            anchors, hot = inner.field("anchor").to_numpy().view(np.uint64), inner.field("hot").to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(0)):
                grams, offsets, units = unit.read(chunk)
                for i in range(len(chunk)):
                    row = chunk.first + i
                    if (t[row], u[row]) in done:
                        continue
                    done.add((t[row], u[row]))
                    own = (keys[row] is not None, keys[row], t[row], u[row])
                    if len(best) >= HELD_SEGMENTS or len(later) >= HELD_SEGMENTS:
                        yield from drained(best, later)
                        best, later = {}, []
                    for r in range(ends[row], ends[row + 1]):
                        base, n = offsets[i] + starts[r], int(counts[r])
                        cuts = [(0, n, int(anchors[r].view(np.int64)))]
                        if hot[r]:
                            last = grams[base + unit.length - unit.gram:][:n]
                            routes = mix(grams[base:base + n] ^ (last << np.uint64(1)) ^ anchors[r]).view(np.int64).tolist()
                            cuts = [(k, 1, route) for k, route in enumerate(routes)]
                        for k, size, route in cuts:
                            body = units[base + k:base + k + size + unit.length - 1].tobytes()
                            mark = hashlib.blake2b(body, digest_size=DIGEST).digest()
                            found = (own, int(starts[r]) + k, size, route)
                            if mark not in best:
                                best[mark] = [found, body, 1]
                                continue
                            held = best[mark]
                            held[2] += 1
                            if found < held[0]:
                                held[0], found = found, held[0]
                            later.append(found)
        yield from drained(best, later)

    def drained(best, later):
        yield from emit([(*head, body, copies) for head, body, copies in best.values()])
        yield from emit([(own, start, n, route, None, 0) for own, start, n, route in joined(sorted(later))])

    def joined(found: list[tuple]) -> Iterator[tuple]:
        held = None
        for own, start, n, route in found:
            if held and held[0] == own and held[1] + held[2] == start:
                held[2] += n
                continue
            if held:
                yield tuple(held)
            held = [own, start, n, route]
        if held:
            yield tuple(held)

    def emit(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(found), 1 << 14):
            own, start, n, route, body, copies = zip(*found[at:at + (1 << 14)], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(route, pa.int64()), pa.array([o[1] for o in own], key_type), pa.array([o[2] for o in own], pa.int64()),
                 pa.array([o[3] for o in own], pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()),
                 pa.array(body, pa.binary()), pa.array(copies, pa.int32())],
                names=["route", "key", "t", "u", "start", "n", "units", "copies"])

    key_type = to_arrow_type(rows.schema["key"].dataType)
    schema = f"route bigint, key {rows.schema['key'].dataType.simpleString()}, t bigint, u bigint, start int, n int, units binary, copies int"
    return rows.select("text", "t", "u", "key", "runs").mapInArrow(cut, schema)


def repeated_windows(rows: DataFrame, unit: Unit, shard) -> DataFrame:
    """(t, u, start, n, key): windows that ``shard`` finds repeated in a table of distinct segments, and those of later copies.

    ``shard`` maps a table of segments, in order of (key, t, u, start), to one boolean per window, segment by segment; a segment
    of ``copies`` over 1 was found more than once.
    """
    parts = SHARDS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [("key", "ascending"), ("t", "ascending"), ("u", "ascending"), ("start", "ascending")]
    key = rows.schema["key"].dataType
    result = RESULT.append(pa.field("key", to_arrow_type(key)))
    names = result.names

    def found(table: pa.Table) -> pa.Table:
        whole = pc.is_valid(table["units"])
        later = table.filter(pc.invert(whole)).select(names)
        table = table.filter(whole)
        out = [later]
        if len(table):
            table = table.sort_by(order)
            if table["key"].null_count:  # null keys come first
                null = pc.is_null(table["key"])
                table = pa.concat_tables([table.filter(null), table.filter(pc.invert(null))])
            first: dict[bytes, int] = {}
            copies = np.zeros(len(table), dtype=np.int64)
            for i, (body, n) in enumerate(zip(table["units"].to_pylist(), table["copies"].to_pylist(), strict=True)):
                copies[first.setdefault(body, i)] += n
            chosen = np.array(sorted(first.values()))
            again = np.setdiff1d(np.arange(len(table)), chosen)
            out.append(table.take(again).select(names))
            segments = table.take(chosen).set_column(table.schema.get_field_index("copies"), "copies", pa.array(copies[chosen]))
            flags = shard(segments)
            n = segments["n"].to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            hit = np.flatnonzero(flags)
            edge = np.ones(len(hit), dtype=bool)
            edge[1:] = (np.diff(hit) != 1) | (owner[hit][1:] != owner[hit][:-1])
            at = np.flatnonzero(edge)
            rows = segments.take(owner[hit[at]])
            starts = rows["start"].to_numpy() + place[hit[at]]
            out.append(pa.table({"t": rows["t"], "u": rows["u"], "start": pa.array(starts.astype(np.int32)),
                                 "n": pa.array(np.diff(np.append(at, len(hit))).astype(np.int32)), "key": rows["key"]}))
        return pa.concat_tables(x.cast(result) for x in out)

    rows = segments(rows, unit).withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(parts)))
    return rows.groupBy("shard").applyInArrow(found, f"t bigint, u bigint, start int, n int, key {key.simpleString()}")


RESULT = pa.schema([("t", pa.int64()), ("u", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


def merged_spans(starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending (starts, ends) of the units that windows cover; spans neither touch nor overlap."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order].astype(np.int64), (starts + counts + length - 1)[order].astype(np.int64)
    reach = np.maximum.accumulate(ends)
    edge = np.ones(len(starts), dtype=bool)
    edge[1:] = starts[1:] > reach[:-1]
    at = np.flatnonzero(edge)
    return starts[at], reach[np.append(at[1:], len(starts)) - 1]
