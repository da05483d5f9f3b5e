"""Weekly counts and alerts over a stream of dated events, and streaming ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..fixed import LOOKBACK_WEEKS, MIN_COUNT, WINDOW, Z_THRESHOLD
from ..functions.numbers import week_index
from ..operators import trends as t
from ..sources.cache import KeyedCache
from ..storage import delete, exists, folders, materialise

WEEK = "7 days"
MONDAY = "4 days"  # windows align to the epoch, a Thursday


def stream_weekly_counts(
    events: DataFrame, ts: str, group: str, lateness: str = WEEK, start: str = MONDAY
) -> DataFrame:
    """Tumbling 7-day counts per group. Events later than ``lateness`` behind the newest one may be dropped.

    State is one counter per open week and group; a hot group is combined before the shuffle.
    """
    timed = events.where(F.col(group).isNotNull()).select(
        F.col(ts).cast("timestamp").alias("ts"), F.col(group).alias("group")
    )
    counts = timed.withWatermark("ts", lateness).groupBy(F.window("ts", WEEK, startTime=start), "group").count()
    return counts.select(F.to_date("window.start").alias("week_start"), "group", "count")


def _counts(spark: SparkSession, folder: str) -> KeyedCache:
    return KeyedCache(spark, f"{folder}/counts", "key string, week_start date, `group` string, `count` bigint")


def run_weekly_counts(counts: DataFrame, folder: str) -> StreamingQuery:
    """Keep the newest count of every (week, group) in ``folder``/counts.

    Each micro-batch is a run of a keyed cache, so runs are merged as they grow in number, and a batch that is run again after a failure
    puts the same counts on top of themselves.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        key = F.concat_ws("|", F.col("week_start").cast("string"), "group")
        _counts(batch.sparkSession, folder).append(batch.withColumn("key", key))

    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def current_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The newest count per (week, group)."""
    return _counts(spark, folder).latest().drop("key")


def closed_week_alerts(
    counts: DataFrame,
    origin: Column,
    n_weeks: Column,
    window: int = WINDOW,
    z_threshold: float = Z_THRESHOLD,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """z-rule alerts on stored weekly counts (week_start, group, count)."""
    cells = counts.select("group", week_index(F.col("week_start"), origin).alias("week"), "count")
    flags = t.detect_spikes(cells, n_weeks, window=window, z_threshold=z_threshold, min_count=min_count)
    found = t.with_week_start(flags.where("flag_z"), origin)
    return found.select("group", "week_start", "count", "prev_week", "wow_delta", "baseline_mean", "z")


TRAILING = "week_start date, `group` string, `count` bigint, first date, last date"
ALERTS = (
    "`group` string, week_start date, `count` bigint, prev_week bigint, wow_delta bigint, "
    "baseline_mean double, z double"
)


def run_alerts(
    counts: DataFrame,
    folder: str,
    window: int = WINDOW,
    lookback: int = LOOKBACK_WEEKS,
    z_threshold: float = Z_THRESHOLD,
    min_count: int = MIN_COUNT,
) -> StreamingQuery:
    """Alert once per (group, week) as weeks close.

    ``counts`` is a ``stream_weekly_counts`` result; in append mode a week arrives when the watermark has
    passed it. What later weeks need of the past is carried from batch to batch as one table: the closed counts of the trailing
    weeks, and the first and last week of all. So a batch reads that table and its own rows, however long the stream has run. A
    batch that is run again starts from the table of the batch before it and writes the same. Alerts that were sent
    before are left out.
    """
    kept, sent = f"{folder}/trailing", f"{folder}/alerts"

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = sorted(int(path.rsplit("=", 1)[1]) for path in folders(spark, f"{kept}/batch=*"))
        earlier = [number for number in known if number < batch_id]
        trailing = spark.read.schema(TRAILING).parquet(f"{kept}/batch={earlier[-1]}") if earlier else spark.createDataFrame([], TRAILING)
        fresh = materialise(batch.select("week_start", "group", "count"), name="closed-weeks")  # read several times below
        newest, last = fresh.agg(F.min("week_start"), F.max("week_start")).first()
        if newest is None:
            return
        first, before = trailing.agg(F.min("first"), F.max("last")).first()
        first, last = min(first or newest, newest), max(before or last, last)
        weeks = max((last - newest).days // 7 + 1, lookback) + window
        total = (last - first).days // 7 + 1
        skip = max(total - weeks, 0)
        origin = F.date_add(F.lit(first), 7 * skip)
        closed = trailing.where("week_start IS NOT NULL").select("week_start", "group", "count").unionByName(fresh)
        recent = closed.where(F.col("week_start") >= origin)
        found = closed_week_alerts(recent, origin, F.lit(total - skip), window, z_threshold, min_count)
        sent_before = read_alerts(spark, folder).where((F.col("batch") < batch_id) & (F.col("week_start") >= origin))
        found.join(sent_before, ["group", "week_start"], "left_anti").write.mode("overwrite").parquet(f"{sent}/batch={batch_id}")
        oldest = F.date_sub(F.lit(last), 7 * (lookback + window))
        edges = spark.createDataFrame([(first, last)], "first date, last date")  # kept also when no week is recent
        rows = closed.where(F.col("week_start") >= oldest).unionByName(edges, allowMissingColumns=True)
        rows.select("week_start", "group", "count", "first", "last").write.mode("overwrite").parquet(f"{kept}/batch={batch_id}")
        for number in earlier[:-1]:
            delete(spark, f"{kept}/batch={number}")

    return (
        counts.writeStream.outputMode("append")
        .foreachBatch(step)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def read_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """All alerts sent so far."""
    schema = f"{ALERTS}, batch bigint"
    path = f"{folder}/alerts"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def stream_ingest(events: DataFrame, id_column: str, ts: str, lateness: str = "1 day") -> DataFrame:
    """Arriving rows with repeated ids dropped while an id is within ``lateness`` of its first sighting."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([id_column])


def run_ingest(rows: DataFrame, folder: str) -> StreamingQuery:
    """Append to ``folder``/rows, exactly once per arriving file."""
    return (
        rows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
