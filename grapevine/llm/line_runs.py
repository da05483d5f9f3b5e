"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without outer white space and with A-Z lower-cased; an empty key is no key. ``LineRuns`` keeps
(key hash, number of documents) in runs that are bucketed and sorted by hash. A batch is counted, merge-anti-joined with the
keys that already reached the threshold, and added as a run of level 0; ``fan_out`` runs of a level are compacted
into one run of the next. Buckets of all runs line up, so the anti-join does not move a run again; compaction deals its rows anew.

Documents are distinct ids; rows with a null id count as none, and lose lines as others do. Texts are counted once each with the number
of ids that have no other text, before lines are exploded; ids with several texts are counted by line and id. A null or empty text
is one empty line.
All steps are DataFrame operations.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, new_folder

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), use)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z as a-z. ``lower`` does it for text without other letters, at a fraction of the cost."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def key_hash(key: Column) -> Column:
    """128 bits as two numbers; null for an empty key."""
    return F.when(F.length(key) > 0, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")))


def text_digest(text: Column) -> Column:
    """128 bits of a text, equal for null and empty texts."""
    whole = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(whole).alias("t"), F.xxhash64(F.lit(1), whole).alias("u"))


class LineRuns:
    """Levelled runs of (a, b, n_docs); ``closed`` holds the keys that reached ``threshold`` documents."""

    def __init__(self, spark: SparkSession, threshold: int = 10, fan_out: int = 2, buckets: int | None = None):
        self.spark, self.threshold, self.fan_out = spark, threshold, fan_out
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.made = 0
        self.levels: dict[int, list[str]] = {}
        self.closed: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        """One sorted run. Its files go to the shared folder; the catalog only knows the buckets."""
        table = f"{self.name}_{self.made}"
        self.made += 1
        (
            rows.repartition(self.buckets, "a").sortWithinPartitions("a", "b").write.format("parquet")
            .option("path", new_folder(self.spark, "run")).bucketBy(self.buckets, "a").sortBy("a", "b").saveAsTable(table)
        )
        return table

    def _all(self, tables: list[str]) -> DataFrame | None:
        rows = None
        for table in tables:
            own = self.spark.table(table)
            rows = own if rows is None else rows.unionByName(own)
        return rows

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows (a, b, ..) of ``batch`` whose key no run holds yet."""
        for table in [*self.closed, *(t for level in self.levels.values() for t in level)]:
            batch = batch.join(self.spark.table(table).select("a", "b"), ["a", "b"], "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        """Add (a, b, n_docs), one row or more per key."""
        counts = batch.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"))
        for table in self.closed:
            counts = counts.join(self.spark.table(table).select("a", "b"), ["a", "b"], "left_anti")
        self.levels.setdefault(0, []).append(self._write(counts))
        level = 0
        while len(self.levels.get(level, [])) >= self.fan_out:
            self._compact([level], level + 1)
            level += 1

    def _compact(self, levels: list[int], into: int) -> None:
        tables = [table for level in levels for table in self.levels.pop(level, [])]
        # dealt by both columns: Spark 4.1 takes a union of bucketed runs as dealt by "a" and leaves a key in two rows
        totals = self._all(tables).repartition(self.buckets, "a", "b").groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"))
        for table in self.closed:
            totals = totals.join(self.spark.table(table).select("a", "b"), ["a", "b"], "left_anti")
        merged = self._write(totals)
        rows = self.spark.table(merged)
        self.closed.append(self._write(rows.filter(F.col("n_docs") >= self.threshold)))
        self.levels.setdefault(into, []).append(merged)
        for table in tables:
            self.spark.sql(f"DROP TABLE {table}")

    def repeated(self) -> DataFrame:
        """Keys (a, b) found in ``threshold`` documents or more, after a last compaction."""
        if any(self.levels.values()):
            self._compact(sorted(self.levels), max(self.levels) + 1)
        rows = self._all(self.closed)
        return rows.select("a", "b") if rows is not None else self.spark.createDataFrame([], "a bigint, b bigint")

    def drop(self) -> None:
        """Forget the runs; the files stay in the shared folder for whoever still reads them."""
        for table in [*self.closed, *(t for level in self.levels.values() for t in level)]:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.closed, self.levels = [], {}


def ids_of_texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Distinct (id, t, u) of rows with an id."""
    digest = text_digest(F.col(text))
    rows = docs.filter(F.col(key).isNotNull())
    return rows.select(F.col(key).alias("id"), digest["t"].alias("t"), digest["u"].alias("u")).distinct()


def texts_with_keys(docs: DataFrame, text: str, batches: int, by_id: DataFrame) -> DataFrame:
    """Distinct texts (t, u, copies, keys, batch): the ids with this text alone, and the key hash of every line, in order."""
    keys = F.transform(lines_of(F.col(text)), lambda line: bound(line_key(line), key_hash))
    alone = by_id.filter(F.col("n") == 1).groupBy("d.t", "d.u").agg(F.count(F.lit(1)).alias("copies"))
    return (
        docs.select(text_digest(F.col(text)).alias("_d"), keys.alias("keys")).select("_d.t", "_d.u", "keys")
        .unionByName(alone, allowMissingColumns=True)
        .groupBy("t", "u").agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("copies"), F.any_value("keys", F.lit(True)).alias("keys"))
        .withColumn("batch", F.pmod(F.col("u"), F.lit(batches)).cast("int"))
    )


def distinct_keys(keys: Column) -> Column:
    return F.explode(F.array_distinct(F.filter(keys, lambda k: k.isNotNull())))


def repeated_line_spots(docs: DataFrame, text: str = "text", min_docs: int = 10, batches: int = 4, key: str = "doc_id") -> DataFrame:
    """(t, u, spots) of distinct texts: ascending places of the lines whose key is in ``min_docs`` documents or more."""
    spark = docs.sparkSession
    pairs = ids_of_texts(docs, text, key)
    by_id = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "u")).alias("d"))
    by_id = materialise(by_id, name="ids")
    table = materialise(texts_with_keys(docs, text, batches, by_id), name="line-keys")
    runs = LineRuns(spark, min_docs)
    for batch in range(batches):
        own = table.filter((F.col("batch") == batch) & (F.col("copies") > 0))
        keys = own.select("copies", distinct_keys(F.col("keys")).alias("k"))
        runs.add(keys.select("k.a", "k.b", F.col("copies").alias("n_docs")))
    several = by_id.filter(F.col("n") > 1).select("id")
    if not several.isEmpty():
        found = pairs.join(several, "id", "left_semi").join(table.select("t", "u", "keys"), ["t", "u"])
        lines = found.select("id", distinct_keys(F.col("keys")).alias("k")).select("id", "k.a", "k.b").distinct()
        runs.add(lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_docs")))
    repeated = materialise(runs.repeated().distinct(), name="repeated-lines")
    runs.drop()
    lines = table.select("t", "u", F.posexplode("keys").alias("at", "k")).select("t", "u", "at", "k.a", "k.b")
    hit = lines.filter(F.col("a").isNotNull()).join(repeated, ["a", "b"], "left_semi").select("t", "u", "at")
    spots = hit.groupBy("t", "u").agg(F.array_sort(F.collect_list("at")).alias("spots"))
    return spots


def drop_repeated_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, batches: int = 4, key: str = "doc_id") -> DataFrame:
    """``docs`` with two more columns: ``_kept`` (kept lines joined by \\n) and ``_dropped`` (how many lines went).

    Every row is kept, texts without lines left become empty. An empty table gives an empty table.
    """
    # written first: the join then reads two plain exchanges, and a text with very many copies can be split
    spots = materialise(repeated_line_spots(docs, text, min_docs, batches, key), name="repeated-spots")
    spots = spots.withColumnsRenamed({"t": "_t", "u": "_u", "spots": "_spots"})
    digest = text_digest(F.col(text))
    rows = docs.withColumns({"_t": digest["t"], "_u": digest["u"]}).join(spots, ["_t", "_u"], "left")
    lines = lines_of(F.col(text))
    return rows.withColumns({
        "_kept": F.when(F.col("_spots").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(without(lines, F.col("_spots"))),
        "_dropped": F.coalesce(F.size("_spots"), F.lit(0)).cast("long"),
    }).drop("_t", "_u", "_spots")


def without(lines: Column, spots: Column) -> Column:
    """Lines at other places than the ascending ``spots``, joined by \\n: the stretches between spots, one slice each."""
    def joined(own: Column) -> Column:
        before = F.concat(F.array(F.lit(-1)), spots)
        after = F.concat(spots, F.array(F.size(own)))
        stretches = F.zip_with(before, after, lambda b, a: F.when(a - b > 1, F.slice(own, b + 2, a - b - 1)).otherwise(
            F.slice(own, F.lit(1), F.lit(0))))
        return F.array_join(F.flatten(stretches), "\n")

    return bound(lines, joined)
