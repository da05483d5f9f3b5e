"""Threshold-scaled sketches of documents.

A sketch holds every hash of a word shingle below a fixed fraction of the hash range. Its size follows the document, so
sketches of very unequal documents estimate containment, and the sketch of a union is the union of sketches.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A text of fewer words than a shingle has one shingle, all its words; null, empty
and white texts have none. Everything is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialise
from .line_runs import WHITE, bound

SHINGLE = 5
FRACTION_BITS = 3  # one hash in 2**3 stays


def sketch(text: Column, size: int = SHINGLE, fraction_bits: int = FRACTION_BITS) -> Column:
    """Ascending distinct shingle hashes whose first ``fraction_bits`` bits are 0."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+", -1)

    def kept(hashes: Column) -> Column:
        # a missing word at the end of a short text does not change the hash
        starts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - size, F.lit(0)))
        shingles = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))
        low = F.filter(shingles, lambda h: F.shiftrightunsigned(h, 64 - fraction_bits) == 0)
        return F.array_sort(F.array_distinct(low))

    return F.when(F.length(trimmed) == 0, F.array().cast("array<bigint>")).otherwise(
        bound(F.transform(words, lambda w: F.xxhash64(w)), kept)
    )


def whole_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprint(text: Column, own_sketch: Column) -> Column:
    """The sketch as text: a hash of the whole text, then the kept shingle hashes in hexadecimal."""
    return F.concat_ws(":", F.hex(whole_hash(text)), F.array_join(F.transform(own_sketch, lambda h: F.hex(h)), ","))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Estimated Jaccard similarity of two sketches; 1 for the ``same`` text, else 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(same, F.lit(1.0)).when(union > 0, shared / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; 0 if the sketch of ``a`` is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def merged(sketches: Column) -> Column:
    """The sketch of a group of documents, from a column of sketches (an aggregate)."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(sketches))))


def following(ids: DataFrame, key: str) -> DataFrame:
    """(key, next key): each distinct key's next one in descending order; the smallest is followed by the largest.

    Keys are range-partitioned and written, ``lead`` runs inside a range, and only the two ends of each range
    meet in one task to close the gaps.
    """
    blocks = materialise(
        ids.repartitionByRange(F.col(key).desc()).withColumn("_block", F.spark_partition_id()), name="ordered-keys"
    )
    inside = blocks.withColumn("_next", F.lead(key).over(Window.partitionBy("_block").orderBy(F.col(key).desc())))
    ends = blocks.groupBy("_block").agg(F.max(key).alias("_first"))
    whole = Window.orderBy("_block")
    gaps = ends.select(
        "_block", F.coalesce(F.lead("_first").over(whole), F.max("_first").over(Window.partitionBy(F.lit(0)))).alias("_gap")
    )
    return inside.join(gaps, "_block").select(key, F.coalesce("_next", "_gap").alias("_next"), *[c for c in ids.columns if c != key])


def with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", share: int = 3) -> DataFrame:
    """Every row with its sketch and the edited text: the last floor(n / share) code points give way to the first as many of the
    next document in descending order of keys.

    Columns: key, text, n_chars, sketch, edited, next_sketch, next_hash (of the whole text). Null texts are empty. Rows of one key share the next
    document, which for a repeated key is the one with the greatest start. A row with a null key has no next document:
    edited, next_sketch and next_hash are null.
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # both joins read these very rows, so that one exchange of the texts serves both
    keyed = rows.filter(F.col("_key").isNotNull()).withColumn("_sketch", sketch(F.col("_text")))
    ids = rows.filter(F.col("_key").isNotNull()).groupBy("_key").agg((F.max(F.length("_text")) / share).cast("int").alias("_need"))
    pairs = following(ids, "_key").select(F.col("_key").alias("_to"), F.col("_next").alias("_key"), "_need")
    start = F.struct(
        F.expr("substring(_text, 1, _need)").alias("head"), F.col("_sketch").alias("sketch"), whole_hash(F.col("_text")).alias("whole")
    )
    heads = keyed.join(pairs, "_key").groupBy(F.col("_to").alias("_key")).agg(F.max(start).alias("_n"))
    cut = F.floor(F.length("_text") / share).cast("int")
    edited = F.expr("concat(substring(_text, 1, _n_chars - _cut), substring(_n.head, 1, _cut))")
    done = keyed.join(heads, "_key", "left").withColumns({"_n_chars": F.length("_text"), "_cut": cut}).select(
        "_key", "_text", "_sketch", F.when(F.col("_n").isNotNull(), edited).alias("edited"), F.col("_n.sketch").alias("next_sketch"),
        F.col("_n.whole").alias("next_hash"),
    )
    alone = rows.filter(F.col("_key").isNull()).withColumn("_sketch", sketch(F.col("_text")))
    return done.unionByName(alone, allowMissingColumns=True).select(
        F.col("_key").alias("key"), F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"), F.col("_sketch").alias("sketch"),
        "edited", "next_sketch", "next_hash",
    )
