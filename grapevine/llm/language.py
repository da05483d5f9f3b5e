"""Language proportions of documents by expectation-maximisation.

A model holds, per language, the likelihood of hashed character trigrams (letters lower-cased, other characters one blank). A
document is a mixture: EM estimates the share of each language, first over all languages, then over the likeliest one, two, ..
languages while the penalised likelihood (Bayesian information criterion) improves.

Statistics are counted over all learning rows with one pass and one sum per language; the model is ``2**BITS`` numbers per
language. Null texts and texts without a letter are ``und`` with score 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .textarrays import mix

BITS = 13
CHUNK_CHARS, CHUNK_TEXTS = 1 << 19, 128
ROUNDS = 8
UNDETERMINED = "und"
BLANK = 32


def folded(code: int) -> int:
    """A letter's lower case, a blank for anything else."""
    letter = chr(code)
    return ord(letter.lower()[0]) if letter.isalpha() else BLANK


FOLDED = np.array([folded(code) for code in range(1 << 16)], dtype=np.uint32)


def text_chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Runs of at most ``CHUNK_TEXTS`` texts and about ``limit`` characters, one text at least."""
    own, size = [], 0
    for text in texts:
        if own and (size + len(text or "") > limit or len(own) == CHUNK_TEXTS):
            yield own
            own, size = [], 0
        own.append(text or "")
        size += len(text or "")
    if own:
        yield own


def trigram_counts(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashed trigrams text by text, how often, each text's range). A text without letters has none."""
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(text) for text in texts], dtype=np.int64)
    plain = FOLDED[np.minimum(raw, len(FOLDED) - 1)]
    for code in np.unique(raw[raw >= len(FOLDED)]):
        plain[raw == code] = folded(int(code))
    # one blank before each word and after the last: blanks after blanks go, texts meet at blanks of their own
    owner = np.repeat(np.arange(len(texts)), lengths + 2)
    codes = np.full(len(owner), BLANK, dtype=np.uint32)
    codes[np.arange(len(plain)) + 2 * np.repeat(np.arange(len(texts)), lengths) + 1] = plain
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != BLANK) | (codes[:-1] != BLANK) | (owner[1:] != owner[:-1])
    codes, owner = codes[keep].astype(np.uint64), owner[keep]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    grams = mix(codes[:-2] | codes[1:-1] << np.uint64(21) | codes[2:] << np.uint64(42)) >> np.uint64(64 - bits)
    inside = owner[:-2] == owner[2:]
    cells = np.bincount(owner[:-2][inside] << bits | grams[inside].astype(np.int64), minlength=len(texts) << bits)
    both = np.flatnonzero(cells)
    return both & ((1 << bits) - 1), cells[both], np.searchsorted(both >> bits, np.arange(len(texts) + 1))


def learn(rows: DataFrame, text: str, language: str, bits: int = BITS) -> dict:
    """Trigram likelihoods per language over all rows with a language: {"languages": [..], "table": languages x 2**bits}.

    Each task sums its counts per language; a row per task and language of ``2**bits`` counts is what is shuffled.
    """
    width = 1 << bits

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            for own in text_chunks(texts):
                columns, counts, offsets = trigram_counts(own, bits)
                labels = names[at:at + len(own)]
                at += len(own)
                for name in set(labels):
                    mine = np.repeat(np.array([label == name for label in labels]), np.diff(offsets))
                    sums = np.bincount(columns[mine], counts[mine], minlength=width)
                    totals[name] = totals[name] + sums if name in totals else sums
        yield pa.RecordBatch.from_pydict({
            "language": pa.array(list(totals), pa.string()),
            "counts": pa.array([list(t.astype(np.int64)) for t in totals.values()], pa.list_(pa.int64())),
        })

    parts = rows.filter(F.col(language).isNotNull()).select(text, language).mapInArrow(counted, "language string, counts array<bigint>")
    sums = (
        parts.select("language", F.posexplode("counts").alias("at", "n")).filter("n > 0")
        .groupBy("language", "at").agg(F.sum("n").alias("n"))
        .groupBy("language").agg(F.collect_list(F.struct("at", "n")).alias("counts"))
    )
    found = sorted(sums.collect(), key=lambda row: row["language"])  # at most 2**bits counts per language
    table = np.full((len(found), width), 0.5)
    for row, own in zip(table, found, strict=True):
        for cell in own["counts"]:
            row[cell["at"]] += cell["n"]
    return {"languages": [row["language"] for row in found], "table": table / table.sum(axis=1, keepdims=True)}


def mixtures(columns, counts, offsets, table: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(share of each language in each text, selected languages): EM on all texts of a chunk at once.

    In each step the likelihood of a gram is split over the languages in proportion to share x likelihood. A text's set takes the next
    likeliest language while that betters 2 * log likelihood - (languages - 1) * log(grams).
    """
    n, k = len(offsets) - 1, len(table)
    lengths = np.diff(offsets)
    counts = counts.astype(np.float32)
    likely = table.astype(np.float32)[:, columns]
    least = np.float32(1e-30)

    class Part:
        """The grams of some texts."""

        def __init__(self, texts):
            self.texts = texts
            grams = slice(None) if len(texts) == n else np.repeat(np.isin(np.arange(n), texts), lengths)
            self.counts, self.likely, own = counts[grams], likely[:, grams], lengths[texts]
            self.owner, self.some = np.repeat(np.arange(len(texts)), own), own > 0
            self.starts = (np.cumsum(own) - own)[self.some]
            self.total = np.maximum(self.summed(self.counts), 1.0)

        def summed(self, values):
            out = np.zeros(values.shape[:-1] + (len(self.texts),), dtype=np.float32)
            if len(self.starts):
                out[..., self.some] = np.add.reduceat(values, self.starts, axis=-1)
            return out

        def climbed(self, share, times):
            for _ in range(times):
                pull = share[:, self.owner] * self.likely
                pull *= self.counts / np.maximum(pull.sum(axis=0), least)
                share = self.summed(pull) / self.total
                share /= np.maximum(share.sum(axis=0), least)
            return share

        def criterion(self, share, size):
            likelihood = (share[:, self.owner] * self.likely).sum(axis=0)
            return 2 * self.summed(self.counts * np.log(np.maximum(likelihood, least))) - (size - 1) * np.log(self.total)

    part = Part(np.arange(n))
    whole = part.climbed(np.full((k, n), 1.0 / k, dtype=np.float32), rounds)
    rank = np.argsort(np.argsort(-whole, axis=0, kind="stable"), axis=0)
    share = (rank == 0).astype(np.float32)
    best = part.criterion(share, 1)
    for size in range(2, k + 1):
        open_texts = part.texts
        trial = whole[:, open_texts] * (rank[:, open_texts] < size)
        trial = part.climbed(trial / np.maximum(trial.sum(axis=0), least), 3)
        now = part.criterion(trial, size)
        better = now > best[open_texts]
        if not better.any():
            break
        kept = open_texts[better]
        share[:, kept], best[kept] = trial[:, better], now[better]
        part = Part(kept)
    return share.T, share.T > 0


def predict(docs: DataFrame, text: str, model: dict, keep: list[str], rounds: int = ROUNDS) -> DataFrame:
    """The columns ``keep`` of every row, ``lang_pred``, its share as ``score``, and all shares as ``languages``/``shares``."""
    model = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits numbers per language

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, grid = model.value["languages"], model.value["table"]
        bits = int(grid.shape[1]).bit_length() - 1
        for batch in batches:
            best, scores, sets, shares = [], [], [], []
            for own in text_chunks(batch.column(0).to_pylist()):
                columns, counts, offsets = trigram_counts(own, bits)
                if not names:
                    found = np.zeros((len(own), 0))
                    alive = found.astype(bool)
                else:
                    found, alive = mixtures(columns, counts, offsets, grid, rounds)
                for i, row in enumerate(found):
                    known = offsets[i + 1] > offsets[i] and len(names) > 0
                    top = int(row.argmax()) if known else -1
                    best.append(names[top] if known else UNDETERMINED)
                    scores.append(float(min(row[top], 1.0)) if known else 0.0)
                    sets.append([names[j] for j in np.flatnonzero(alive[i])] if known else [])
                    shares.append([float(row[j]) for j in np.flatnonzero(alive[i])] if known else [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(best, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                names=[*keep, "lang_pred", "score", "languages", "shares"],
            )

    schema = StructType([docs.schema[c] for c in keep] + [
        StructField("lang_pred", StringType()), StructField("score", DoubleType()),
        StructField("languages", ArrayType(StringType())), StructField("shares", ArrayType(DoubleType())),
    ])
    return docs.select(F.col(text).alias("_read_text"), *keep).mapInArrow(predicted, schema)
