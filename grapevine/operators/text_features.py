"""Character n-gram TF-IDF per language."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..storage import in_slices, materialise, new_folder, spread
from .positions import first_n

GRAMS = "gram array<string>, tf array<int>"
CODED = "gram array<bigint>, tf array<int>"
CODE = 21  # bits of a character's code, which is one more than its code point
SPACE = ord(" ") + 1


def _word_grams(word: str, longest: int) -> Iterator[str]:
    """The 1..longest character pieces of a word that has one space on each side."""
    padded = f" {word} "
    return (padded[start : start + size] for size in range(1, longest + 1) for start in range(len(padded) - size + 1))


def _counted_words(texts: Sequence[str | None], longest: int) -> pa.Array:
    """Counts of pieces of any length, word by word."""
    counted = []
    for text in texts:
        counts: Counter[str] = Counter()
        for word, n in Counter((text or "").lower().split()).items():
            for gram in _word_grams(word, longest):
                counts[gram] += n
        counted.append({"gram": list(counts), "tf": list(counts.values())})
    return pa.array(counted, pa.struct([("gram", pa.list_(pa.string())), ("tf", pa.list_(pa.int32()))]))


def _counted(texts: Sequence[str | None], longest: int, spelled: bool = True) -> pa.Array:
    """Counts of pieces whose codes fit into one number, for all texts at once."""
    codes, counts, ends = _char_grams(texts, longest)
    grams, ends = pa.array(codes), pa.array(ends.astype(np.int32))
    if spelled:
        known = grams.dictionary_encode()
        grams = _spelled(known.dictionary, longest).take(known.indices)
    lists = [pa.ListArray.from_arrays(ends, values) for values in (grams, pa.array(counts.astype(np.int32)))]
    return pa.StructArray.from_arrays(lists, names=["gram", "tf"])


def _padded(text: str | None) -> str:
    """The words in lower case with one space on each side; only between two words are there two spaces in a row."""
    words = (text or "").lower().split()
    return f" {'  '.join(words)} " if words else ""


def _char_grams(texts: Sequence[str | None], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, how often, where the grams of each text begin and end). A gram is one number, of ``CODE`` bits per character from the
    first on, so numbers have the order of the strings.

    A piece without two spaces in a row lies within a padded word; texts follow one another like words.
    """
    padded = [_padded(text) for text in texts]
    ends = np.cumsum([len(p) for p in padded], dtype=np.int64)
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), dtype=np.uint32).astype(np.int64) + 1
    between = np.append((codes[1:] == SPACE) & (codes[:-1] == SPACE), True)[:len(codes)]
    keys = np.zeros((longest, len(codes)), dtype=np.int64)  # 0: no piece of this length starts here
    piece, inside = codes, np.ones(len(codes), dtype=bool)
    for size in range(longest):
        keys[size] = np.where(inside, piece << CODE * (longest - 1 - size), 0)
        inside = inside & ~np.append(between[size:], np.ones(size, dtype=bool))[:len(codes)]
        piece = (piece << CODE) + np.append(codes[size + 1:], np.zeros(size + 1, dtype=np.int64))[:len(codes)]
    grams, counts, sizes = [], [], []
    for start, end in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
        own = np.sort(keys[:, start:end], axis=None)
        own = own[np.searchsorted(own, 1):]
        at = np.flatnonzero(np.append(True, own[1:] != own[:-1])[:len(own)])
        grams.append(own[at])
        counts.append(np.diff(np.append(at, len(own))))
        sizes.append(len(at))
    return np.concatenate(grams), np.concatenate(counts), np.append(0, np.cumsum(sizes))


def _spelled(grams: pa.Array, longest: int) -> pa.Array:
    """The pieces as strings."""
    shifts = np.arange(longest - 1, -1, -1) * CODE
    codes = (grams.to_numpy()[:, None] >> shifts) & ((1 << CODE) - 1)
    there = codes > 0
    codes = codes - 1
    width = (1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)) * there
    body = codes[there].astype(np.uint32).tobytes().decode("utf-32-le").encode()
    offsets = np.append(0, np.cumsum(width.sum(axis=1))).astype(np.int32)
    return pa.StringArray.from_buffers(len(grams), pa.py_buffer(offsets), pa.py_buffer(body))


def char_gram_counts(rows: DataFrame, text: str, longest: int = 3, name: str = "grams", spelled: bool = True) -> DataFrame:
    """Add the n-gram counts of the whole text: two arrays (gram, tf) of equal length.

    Grams are strings, or numbers in the order of the strings where they need not be ``spelled`` (up to three characters).
    Counting stays inside the row. Exploding first would shuffle some twenty times the size of the text only
    to bring the pieces of one review together again.
    """

    packed = longest * CODE < 64
    if not (spelled or packed):
        raise ValueError("grams of more than three characters have no number")

    @F.arrow_udf(GRAMS if spelled else CODED)
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in in_slices(batches):
            own = texts.to_pylist()
            yield _counted(own, longest, spelled) if packed else _counted_words(own, longest)

    return spread(rows).withColumn(name, count(F.col(text)))


def vocabulary(
    counted: DataFrame, language: str, min_rows: int = 2, max_terms: int = 200_000, grams: str = "grams"
) -> DataFrame:
    """(language, gram, df, total, idf): terms in at least ``min_rows`` rows, the most frequent ``max_terms``.

    idf = ln((1 + N) / (1 + df)) + 1 with N rows of that language. Equal totals keep the smaller gram. Counts are
    combined before the shuffle, so what moves is one row per term and input partition. The terms are cut by the total of the
    last one that fits, found from how many terms have which total; only terms with that very total are ranked.
    """
    terms = (
        counted.select(language, F.inline(F.arrays_zip(f"{grams}.gram", f"{grams}.tf")).alias("gram", "tf"))
        .groupBy(language, "gram")
        .agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
        .where(F.col("df") >= min_rows)
    )
    terms = materialise(terms, name="terms")
    falling = Window.partitionBy(language).orderBy(F.desc("total")).rowsBetween(Window.unboundedPreceding, 0)
    upto = terms.groupBy(language, "total").agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(falling))
    room = upto.select(language, "total", "_n", (max_terms - F.col("_upto") + F.col("_n")).alias("_room"))
    placed = terms.join(room.where(F.col("_room") > 0), [language, "total"])
    whole = placed.where(F.col("_room") >= F.col("_n"))
    last = first_n(placed.where(F.col("_room") < F.col("_n")), [language], [F.asc("gram")], F.col("_room"), [F.col("gram")])
    kept = whole.unionByName(last).drop("_room", "_n")
    sizes = counted.groupBy(language).agg(F.count("*").alias("_rows"))
    idf = F.log((1 + F.col("_rows")) / (1 + F.col("df"))) + 1
    return kept.join(sizes, language).select(language, "gram", "df", "total", idf.alias("idf"))


def numbered_terms(terms: DataFrame, language: str) -> DataFrame:
    """(language, gram, idf, index): grams of a language are numbered from 0 in ascending order. Written, as joins read it again.

    A language has at most the ``max_terms`` of its vocabulary.
    """
    index = F.row_number().over(Window.partitionBy(language).orderBy("gram")) - 1
    return materialise(terms.select(language, "gram", "idf", index.alias("index")), name="terms")


def tfidf_weights(
    counted: DataFrame, terms: DataFrame, language: str, grams: str = "grams", name: str = "tfidf"
) -> DataFrame:
    """Add (indices, weights): 1 + ln(tf) times idf, scaled to length 1, over the terms of the row's language.

    Indices number the grams of a language in ascending order. Rows get a number for the time being and are written; their grams meet the
    term table in a join on language and gram, and come together again by row. A gram that most rows have is one row of
    the term table, so where that table is too large to be copied to every task the join's crowded partitions are split. No term passes the driver.
    """
    rows = materialise(counted.withColumn("_row", F.monotonically_increasing_id()), name="counted")
    known = numbered_terms(terms, language).withColumnRenamed(language, "_language")
    pieces = rows.select("_row", F.col(language).alias("_lang"), F.inline(F.arrays_zip(f"{grams}.gram", f"{grams}.tf")).alias("gram", "tf"))
    found = pieces.join(known, (pieces["gram"] == known["gram"]) & pieces["_lang"].eqNullSafe(known["_language"]))
    weight = (1 + F.log("tf")) * F.col("idf")
    weighed = found.select("_row", F.struct("index", weight.alias("weight")).alias("term")).groupBy("_row").agg(F.sort_array(F.collect_list("term")).alias("_terms"))
    length = F.sqrt(F.aggregate("_terms", F.lit(0.0), lambda total, t: total + t["weight"] * t["weight"]))
    # the length is bound once per row: as a column it would be worked out again inside the function, for every term
    weights = F.get(F.transform(F.array(length), lambda whole: F.transform("_terms", lambda t: t["weight"] / whole)), F.lit(0))
    scaled = weighed.select(
        F.col("_row").alias("_at"), F.struct(F.col("_terms.index").alias("indices"), weights.alias("weights")).alias(name))
    none = F.struct(F.array().cast("array<int>").alias("indices"), F.array().cast("array<double>").alias("weights"))
    joined = rows.join(scaled, F.col("_row") == F.col("_at"), "left")
    return joined.withColumn(name, F.coalesce(F.col(name), none)).drop("_row", "_at")


def with_vectors(rows: DataFrame, indices: Column, values: Column, size: int, name: str = "features") -> DataFrame:
    """Add sparse ML vectors of ascending ``indices``.

    Their parts are written as Parquet, and read back as vectors: no function is called per row.
    """
    kind = VectorUDT()
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), indices.alias("indices"), values.alias("values"))
    folder = new_folder(rows.sparkSession, "vectors")
    rows.withColumn(name, parts).write.parquet(folder)
    schema = StructType([*(field for field in rows.schema if field.name != name), StructField(name, kind)])
    return rows.sparkSession.read.schema(schema).parquet(folder)
