"""N-gram Jaccard join over signature trees.

Documents are sets of word shingles; two link when ``100 * shared >= percent * union``. No link between different texts is lost:

1. Texts with the same set are one class. Each class sends its shingle hashes, packed in arrays, to parts of the hash range, where
   the classes that have a shingle are counted. Only shingles of two classes or more go on.
2. A class can link only if enough of its shingles are shared. Of those that can, the shared shingles are ordered from rare to frequent;
   linked classes share one of the first ``n - least overlap + 1`` (prefix filter). Classes with such a shingle in common are
   one forest.
3. A forest is cut into blocks by set size and hash, of at most ``BLOCK`` classes on average. A signature tree over a block has nodes
   with the OR of their members' token bitmaps and their size range. The trees of two blocks are walked together; a pair of nodes is
   left when its largest possible overlap is too small for its smallest sizes, or when both lie in one component already. What
   is left at the leaves is compared exactly.

Sets are compared by hashes of 48 bits and more. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A text with fewer words than a shingle
has one shingle, all its words; null, empty and white texts have an empty set and link with nothing. A row with a null id is compared
like any other, but has no id to give: a component's id is the smallest id in it that is not null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..storage import materialise
from .components import components
from .textarrays import binaries, chunks, concatenated, shingle_sets, words_of

SHINGLE, PERCENT = 5, 75
BLOCK = 1000
FAN = 8
BITS = 2048
CLASS, SHORT = 16, 6
PART_TOKENS = 1 << 21
BAND = 0.1


def least_overlap(n, percent: int):
    """The least number of shared shingles a set of ``n`` must have to link with any set."""
    return -(-(n * percent) // 100)


def class_keys(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """128-bit digests of sorted sets."""
    return [hashlib.blake2b(values[a:b].tobytes(), digest_size=CLASS).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def document_sets(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, n, class) of every row."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys = [], []
            for chunk in chunks(batch.column(0)):
                values, offsets = shingle_sets(words_of(chunk, lower=True), size)
                counts.append(np.diff(offsets))
                keys += class_keys(values, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(keys, pa.binary())],
                names=["key", "n", "class"],
            )

    schema = StructType([StructField("key", docs.schema[key].dataType), StructField("n", LongType()), StructField("class", BinaryType())])
    return docs.select(F.col(text).alias("_text"), F.col(key).alias("_key")).mapInArrow(sets, schema)


def packed_shingles(docs: DataFrame, text: str, size: int, parts: int) -> DataFrame:
    """(part, classes, sizes, counts, tokens): shingles in one part of the hash range, class by class, as packed arrays.

    A task sends a class once, however many copies it reads. Tokens are what is left of the hash inside the part.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held, total = [], 0
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                values, offsets = shingle_sets(words_of(chunk, lower=True), size)
                keys = class_keys(values, offsets)
                fresh = np.array([a < b and not (k in seen or seen.add(k)) for k, a, b in zip(keys, offsets[:-1], offsets[1:], strict=True)], bool)
                if not fresh.any():
                    continue
                lengths = np.diff(offsets)
                held.append((values[np.repeat(fresh, lengths)], lengths[fresh], b"".join(k for k, f in zip(keys, fresh, strict=True) if f)))
                total += int(lengths[fresh].sum())
                if total >= PART_TOKENS:
                    yield flush(held)
                    held, total = [], 0
        if held:
            yield flush(held)

    def flush(held):
        values = np.concatenate([v for v, _, _ in held])
        sizes = np.concatenate([n for _, n, _ in held])
        keys = np.frombuffer(b"".join(k for _, _, k in held), dtype=np.uint8).reshape(len(sizes), CLASS)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        part = (values & np.uint64(0xFFFF)).astype(np.int64) % parts
        order = np.argsort(part, kind="stable")
        part, owner, values = part[order], owner[order], values[order]
        edge = np.ones(len(part), dtype=bool)  # a class's first token in a part
        edge[1:] = (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(edge)
        counts = np.diff(np.append(at, len(part))).astype(np.uint32)
        cuts = np.searchsorted(part[at], np.arange(parts + 1))
        tokens = np.append(at, len(part))[cuts]
        classes = keys[owner[at]]
        some = np.flatnonzero(np.diff(cuts) > 0)
        rows = [
            pa.array(some.astype(np.int32)), *(
                binaries(x, o).take(pa.array(some)) for x, o in (
                    (np.ascontiguousarray(classes).reshape(-1), cuts * CLASS), (sizes[owner[at]].astype(np.uint32), cuts), (counts, cuts), (short_bytes(values), tokens * SHORT)))
        ]
        return pa.RecordBatch.from_arrays(rows, names=["part", "classes", "sizes", "counts", "tokens"])

    schema = "part int, classes binary, sizes binary, counts binary, tokens binary"
    return docs.select(F.col(text).alias("_text")).mapInArrow(pack, schema)


def shared_shingles(packed: DataFrame, buckets: int) -> DataFrame:
    """(bucket, classes, sizes, counts, tokens, ranks): each class's shingles that another class has too.

    Ranks are floor(log2(classes that have the shingle)). Classes are dealt to buckets by their digest and packed as before.
    """
    def shared(rows: pa.Table) -> pa.Table:
        keys, _ = concatenated(rows["classes"], np.dtype(f"V{CLASS}"))
        sizes, _ = concatenated(rows["sizes"], np.uint32)
        counts, _ = concatenated(rows["counts"], np.uint32)
        tokens = long_tokens(concatenated(rows["tokens"], np.uint8)[0])
        # one number per class; a class that several tasks sent counts once
        first, number = numbered(keys)
        owner = np.repeat(number, counts)
        order = np.lexsort((owner, tokens))
        tokens, owner = tokens[order], owner[order]
        fresh = np.ones(len(tokens), dtype=bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        tokens, owner = tokens[fresh], owner[fresh]
        edge = np.ones(len(tokens), dtype=bool)
        edge[1:] = tokens[1:] != tokens[:-1]
        at = np.flatnonzero(edge)
        df = np.diff(np.append(at, len(tokens)))
        keep = np.repeat(df >= 2, df)
        rank = np.repeat(np.floor(np.log2(np.maximum(df, 1))).astype(np.uint8), df)[keep]
        tokens, owner = tokens[keep], owner[keep]
        halves = np.frombuffer(keys.tobytes(), dtype=np.uint64).reshape(-1, 2)[first]
        bucket = (halves[:, 0] % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((owner, bucket[owner]))
        tokens, owner, rank = tokens[order], owner[order], rank[order]
        at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        ends = np.append(at, len(owner))
        cuts = np.searchsorted(bucket[owner[at]], np.arange(buckets + 1))
        some = pa.array(np.flatnonzero(np.diff(cuts) > 0).astype(np.int32))
        names = np.frombuffer(keys[first[owner[at]]].tobytes(), np.uint8)
        arrays = [(names, cuts * CLASS), (sizes[first[owner[at]]], cuts), (np.diff(ends).astype(np.uint32), cuts),
                  (tokens, ends[cuts]), (rank, ends[cuts])]
        return pa.Table.from_arrays([some, *(binaries(x, o).take(some) for x, o in arrays)],
                                    names=["bucket", "classes", "sizes", "counts", "tokens", "ranks"])

    return packed.groupBy("part").applyInArrow(shared, "bucket int, classes binary, sizes binary, counts binary, tokens binary, ranks binary")


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct 128-bit key, for every key the number of its distinct one)."""
    halves = np.frombuffer(keys.tobytes(), dtype=np.uint64).reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    edge = np.ones(len(order), dtype=bool)
    edge[1:] = (halves[order][1:] != halves[order][:-1]).any(axis=1)
    number = np.zeros(len(order), dtype=np.uint32)
    number[order] = np.cumsum(edge) - 1
    return order[edge], number


def short_bytes(hashes: np.ndarray) -> np.ndarray:
    """The upper 48 bits of hashes, six bytes each. With the part, which the lower bits choose, they stand for the hash."""
    return np.ascontiguousarray(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, 8 - SHORT:]).reshape(-1)


def long_tokens(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // SHORT, 8), dtype=np.uint8)
    out[:, :SHORT] = data.reshape(-1, SHORT)
    return out.view(np.uint64).reshape(-1)


def candidates(shared: DataFrame, percent: int) -> DataFrame:
    """(class, n, tokens, prefix): classes that share enough to link, all their shared shingles and their prefix."""
    def gather(rows: pa.Table) -> pa.Table:
        keys, _ = concatenated(rows["classes"], np.dtype(f"V{CLASS}"))
        sizes, counts = (concatenated(rows[c], np.uint32)[0].astype(np.int64) for c in ("sizes", "counts"))
        tokens, ranks = concatenated(rows["tokens"], np.uint64)[0], concatenated(rows["ranks"], np.uint8)[0]
        first, number = numbered(keys)
        owner = np.repeat(number, counts)
        total = np.bincount(owner, minlength=len(first))
        n = sizes[first]
        enough = total * 100 >= n * percent
        keep = enough[owner]
        tokens, ranks, owner = tokens[keep], ranks[keep], owner[keep]
        order = np.lexsort((tokens, ranks, owner))
        some = np.flatnonzero(enough)
        ends = np.append(0, np.cumsum(total[some]))
        length = np.where(enough, total - least_overlap(n, percent) + 1, 0)
        place = np.arange(len(owner)) - np.repeat(ends[:-1], total[some])
        in_prefix = place < np.repeat(length[some], total[some])
        starts = np.append(0, np.cumsum(np.minimum(length, total)[some])).astype(np.int32)
        prefix = pa.ListArray.from_arrays(pa.array(starts), pa.array(tokens[order][in_prefix].view(np.int64)))
        by_token = np.lexsort((tokens, owner))
        names = np.frombuffer(keys[first[some]].tobytes(), np.uint8)
        return pa.Table.from_arrays(
            [binaries(names, np.arange(len(some) + 1) * CLASS), pa.array(n[some]), binaries(tokens[by_token], ends), prefix],
            names=["class", "n", "tokens", "prefix"])

    return shared.groupBy("bucket").applyInArrow(gather, "class binary, n bigint, tokens binary, prefix array<bigint>")


class Tree:
    """A signature tree over sets: levels of nodes with OR of bitmaps, least and largest size, and most tokens that bits hide."""

    def __init__(self, tokens: list[np.ndarray], sizes: np.ndarray, bits: int = BITS):
        least = np.array([t[:3].tolist() + [0] * (3 - len(t[:3])) for t in tokens], dtype=np.uint64).reshape(len(tokens), 3)
        order = np.lexsort((least[:, 2], least[:, 1], least[:, 0]))  # alike sets begin alike
        self.members = order
        bitmap = np.zeros((len(tokens), bits // 64), dtype=np.uint64)
        owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        every = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        bit = (every * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits.bit_length() + 1)
        np.bitwise_or.at(bitmap, (owner, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
        counts = np.array([len(t) for t in tokens])
        hidden = counts - np.bitwise_count(bitmap).sum(axis=1)
        self.levels = [(bitmap[order], sizes[order], sizes[order], hidden[order])]
        while len(self.levels[-1][0]) > 1:
            bitmap, low, high, hidden = self.levels[-1]
            cuts = np.arange(0, len(low), FAN)
            self.levels.append((
                np.bitwise_or.reduceat(bitmap, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts),
                np.maximum.reduceat(hidden, cuts),
            ))


def possible(one, two, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the nodes ``a`` of a level and ``b`` of another may hold a linked pair."""
    keep = np.zeros(len(a), dtype=bool)
    for at in range(0, len(a), 1 << 14):
        i, j = a[at:at + (1 << 14)], b[at:at + (1 << 14)]
        common = np.bitwise_count(one[0][i] & two[0][j]).sum(axis=1, dtype=np.int64)
        most = np.minimum(common + np.minimum(one[3][i], two[3][j]), np.minimum(one[2][i], two[2][j]))
        keep[at:at + (1 << 14)] = most * (100 + percent) >= percent * (one[1][i] + two[1][j])
    return keep


def leaf_pairs(one: Tree, two: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets that no pair of nodes above them rules out; ``one`` may be ``two``."""
    same = one is two
    x, y = len(one.levels) - 1, len(two.levels) - 1
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(a):
        keep = possible(one.levels[x], two.levels[y], a, b, percent)
        a, b = a[keep], b[keep]
        if x == 0 and y == 0:
            break
        if x >= y:
            a, b, x = *opened(a, b, len(one.levels[x - 1][0])), x - 1
            if same:
                b, a, y = *opened(b, a, len(one.levels[y - 1][0])), y - 1
                half = a <= b
                a, b = a[half], b[half]
        else:
            b, a, y = *opened(b, a, len(two.levels[y - 1][0])), y - 1
    if same:
        a, b = a[a < b], b[a < b]
    return one.members[a], two.members[b]


def opened(parents: np.ndarray, others: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pair with the parent's children in its place."""
    children = (parents[:, None] * FAN + np.arange(FAN)).reshape(-1)
    others = np.repeat(others, FAN)
    inside = children < n
    return children[inside], others[inside]


class Groups:
    """Components of numbered sets."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def unite(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)


def linked(a: np.ndarray, b: np.ndarray, n: int, m: int, percent: int) -> bool:
    """Exact test on the sorted shared shingles of two sets of ``n`` and ``m``."""
    if min(len(a), len(b)) * (100 + percent) < percent * (n + m):
        return False
    at = np.searchsorted(b, a)
    shared = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    return shared * (100 + percent) >= percent * (n + m)


def join_blocks(tokens: list[np.ndarray], sizes: np.ndarray, second: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(set, first set of its component) within a block, or over the sets of two blocks (``second`` tells which are of the other)."""
    groups = Groups(len(tokens))
    order = np.arange(len(tokens))
    if second.any() and not second.all():
        ours, theirs = order[~second], order[second]
        a, b = leaf_pairs(Tree([tokens[i] for i in ours], sizes[ours]), Tree([tokens[i] for i in theirs], sizes[theirs]), percent)
        a, b = ours[a], theirs[b]
    else:
        tree = Tree(tokens, sizes)
        for i, j in zip(tree.members[:-1], tree.members[1:], strict=True):  # neighbours first: most links join what is joined already
            if linked(tokens[i], tokens[j], sizes[i], sizes[j], percent):
                groups.unite(int(i), int(j))
        a, b = leaf_pairs(tree, tree, percent)
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        if groups.root(i) != groups.root(j) and linked(tokens[i], tokens[j], sizes[i], sizes[j], percent):
            groups.unite(i, j)
    return [(i, groups.root(i)) for i in range(len(tokens)) if groups.root(i) != i]


def links_within(rows: DataFrame, percent: int, by: list[str]) -> DataFrame:
    """(class, other): links that connect the classes of each group; rows hold (by.., class, n, tokens, second)."""
    def joined(table: pa.Table) -> pa.Table:
        keys = table["class"].to_pylist()
        tokens = [np.frombuffer(t, dtype=np.uint64) for t in table["tokens"].to_pylist()]
        second = table["second"].to_numpy().astype(bool)
        pairs = join_blocks(tokens, table["n"].to_numpy(), second, percent)
        return pa.Table.from_arrays(
            [pa.array([keys[i] for i, _ in pairs], pa.binary()), pa.array([keys[j] for _, j in pairs], pa.binary())], names=["a", "b"])

    # dealt by all of ``by``: what came before may have left a forest's blocks in one task
    return rows.repartition(*by).groupBy(*by).applyInArrow(joined, "a binary, b binary")


def class_components(docs: DataFrame, text: str, size: int, percent: int, block: int = BLOCK) -> DataFrame:
    """(class, component): components of linked classes; classes without a link have no row."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = materialise(candidates(shared_shingles(packed_shingles(docs, text, size, parts), parts), percent), name="jaccard-candidates")
    # forests: classes that share a prefix shingle, by way of the shingle's smallest class
    prefixes = found.select("class", F.explode("prefix").alias("token"))
    leaders = prefixes.groupBy("token").agg(F.min("class").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    edges = prefixes.join(leaders, "token").filter(F.col("class") != F.col("leader")).select(F.col("class").alias("a"), F.col("leader").alias("b")).distinct()
    forest = components(edges)
    # blocks of a forest: size bands, cut by hash where a band is large
    rows = found.select("class", "n", "tokens").join(forest.withColumnsRenamed({"node": "class", "component": "forest"}), "class")
    rows = rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / BAND).cast("int"))
    cuts = rows.groupBy("forest", "band").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("cuts"))
    rows = rows.join(cuts, ["forest", "band"]).withColumn("cut", F.pmod(F.xxhash64("class"), F.col("cuts")).cast("int")).drop("cuts")
    rows = materialise(rows, name="jaccard-blocks")
    # a forest of few classes is one block; larger ones are joined block by block
    sizes = rows.groupBy("forest").agg(F.count(F.lit(1)).alias("members"))
    rows = rows.join(sizes, "forest")
    whole = rows.filter(F.col("members") <= block).withColumns({"band": F.lit(0), "cut": F.lit(0)})
    cut = rows.filter(F.col("members") > block)
    inside = links_within(
        whole.unionByName(cut).select("forest", "band", "cut", "class", "n", "tokens", F.lit(False).alias("second")), percent, ["forest", "band", "cut"])
    inside = materialise(inside, name="jaccard-links")
    # classes of different components in different blocks of a forest
    known = components(inside)
    open_rows = cut.join(known.withColumnsRenamed({"node": "class"}), "class", "left")
    open_rows = materialise(open_rows.withColumn("component", F.coalesce("component", "class")).select(
        "forest", "band", "cut", "class", "n", "tokens", "component"), name="jaccard-open")
    across = links_across(open_rows, percent)
    return components(inside.unionByName(across))


def links_across(rows: DataFrame, percent: int) -> DataFrame:
    """Links between blocks of a forest, for pairs of blocks whose sizes can link and that are not all one component already."""
    blocks = rows.groupBy("forest", "band", "cut").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    reach = int(np.ceil(np.log(100 / percent) / BAND)) + 1
    one = blocks.select("forest", "band", "cut", "low", "high", "c0", "c1")
    two = one.select(*[F.col(c).alias(f"{c}_2") for c in one.columns])
    near = one.withColumn("band_2", F.explode(F.sequence(F.col("band"), F.col("band") + reach))).join(
        two.withColumnRenamed("forest_2", "forest"), ["forest", "band_2"])
    pairs = near.filter(
        ((F.col("band") < F.col("band_2")) | (F.col("cut") < F.col("cut_2")))
        & (F.least("high", "high_2") * 100 >= F.greatest("low", "low_2") * percent)
        & ~((F.col("c0") == F.col("c1")) & (F.col("c0_2") == F.col("c1_2")) & (F.col("c0") == F.col("c0_2")))
    ).select("forest", "band", "cut", "band_2", "cut_2")
    pair = ["forest", "band", "cut", "band_2", "cut_2"]
    left = rows.join(pairs, ["forest", "band", "cut"]).select(*pair, "class", "n", "tokens", F.lit(False).alias("second"))
    right = rows.withColumnsRenamed({"band": "band_2", "cut": "cut_2"}).join(pairs, ["forest", "band_2", "cut_2"]).select(
        *pair, "class", "n", "tokens", F.lit(True).alias("second"))
    return links_within(left.unionByName(right), percent, pair)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n, component) of every row: the size of its set and the smallest key that links reach.

    Rows with an empty set are components of their own. Rows that repeat a key are linked by it only if their sets are.
    """
    rows = materialise(document_sets(docs, key, text, size), name="document-sets")
    linked_classes = materialise(class_components(docs, text, size, percent), name="class-components")
    own = rows.filter("n > 0").groupBy("class").agg(F.min("key").alias("least"))
    own = own.join(linked_classes.withColumnsRenamed({"node": "class"}), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = own.groupBy("component").agg(F.min("least").alias("smallest"))
    names = own.join(least, "component").select("class", "smallest")
    out = rows.join(names, "class", "left")
    return out.select(
        F.col("key").alias(key), "n",
        F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("key")).alias("component"),
    )
