"""A cache of answers by key, kept as sorted-out runs: appended often, read by a few keys, the last answer wins.

An append writes one run, cut by a hash of the key into folders of buckets. ``FAN`` runs of a level are merged into one of the next, with
the last answer per key, so that a cache of n runs is read from at most ``FAN`` runs per level. A run's folder says which appends it
holds (``level=1/first=0/last=7``); a run whose appends another of a higher level holds is passed over, so a merge that
dies before it removes what it merged changes nothing.

A look-up reads only the buckets that the asked keys fall into.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import latest_per_key
from ..storage import delete, folders

FAN, BUCKETS = 8, 32


@dataclass(frozen=True, order=True)
class Run:
    """Which appends a run holds, and where it lies."""

    first: int
    last: int
    level: int

    @property
    def name(self) -> str:
        return f"level={self.level}/first={self.first}/last={self.last}"

    def holds(self, other: Run) -> bool:
        return self.level > other.level and self.first <= other.first and other.last <= self.last


class KeyedCache:
    """The cache under ``folder``; ``schema`` names its fields, among them ``key``. One writer appends at a time."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str = "key", buckets: int = BUCKETS, fan: int = FAN):
        self.spark, self.folder, self.key, self.buckets, self.fan = spark, folder.rstrip("/"), key, buckets, fan
        self.schema = f"{schema}, seq bigint, bucket int"
        self.columns = spark.createDataFrame([], schema).columns

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def runs(self) -> list[Run]:
        """The runs that count, oldest first."""
        found = []
        for path in folders(self.spark, f"{self.folder}/level=*/first=*/last=*/_SUCCESS"):  # whole runs only
            level, first, last = (int(part.split("=")[1]) for part in path.split("/")[-4:-1])
            found.append(Run(first, last, level))
        return sorted(run for run in found if not any(other.holds(run) for other in found))

    def _read(self, runs: list[Run]) -> DataFrame:
        out = self.spark.createDataFrame([], self.schema)
        for run in runs:
            out = out.unionByName(self.spark.read.schema(self.schema).parquet(f"{self.folder}/{run.name}"))
        return out

    def _write(self, rows: DataFrame, run: Run) -> None:
        rows.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{run.name}")

    def append(self, records: DataFrame) -> None:
        """Add answers as the newest run; of a key's answers in one append the last by all fields counts. Rows without a key are left out."""
        runs = self.runs()
        number = runs[-1].last + 1 if runs else 0
        rows = records.select(*self.columns).where(F.col(self.key).isNotNull()).withColumns(
            {"seq": F.lit(number).cast("bigint"), "bucket": self._bucket(F.col(self.key))})
        self._write(rows, Run(number, number, 0))
        self._merge()

    def _merge(self) -> None:
        runs = self.runs()
        level = 0
        while True:
            mine = [run for run in runs if run.level == level][:self.fan]
            if len(mine) < self.fan:
                if not any(run.level > level for run in runs):
                    return
                level += 1
                continue
            merged = Run(mine[0].first, mine[-1].last, level + 1)
            self._write(latest_per_key(self._read(mine), self.key, "seq"), merged)
            for run in mine:
                delete(self.spark, f"{self.folder}/{run.name}")
            runs = self.runs()

    def latest(self, keys: DataFrame | None = None, key: str | None = None) -> DataFrame:
        """The last answer of every key, or of the keys in a column of ``keys``; then only their buckets are read."""
        rows = self._read(self.runs())
        if keys is not None:
            asked = keys.select(F.col(key or self.key).cast("string").alias("_asked")).where("_asked IS NOT NULL").distinct()
            wanted = [r[0] for r in asked.select(self._bucket(F.col("_asked"))).distinct().collect()]  # at most ``buckets``
            rows = rows.where(F.col("bucket").isin(wanted)).join(asked, F.col(self.key).cast("string") == F.col("_asked"), "left_semi")
        return latest_per_key(rows, self.key, "seq").select(*self.columns)

    def pending(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose key has no answer yet; rows without a key are pending."""
        known = self.latest(rows, key).select(F.col(self.key).cast("string").alias("_known"))
        return rows.join(known, F.col(key).cast("string") == F.col("_known"), "left_anti")
