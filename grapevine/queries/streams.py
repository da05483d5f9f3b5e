"""Queries: the streaming jobs, run to the end of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_folder
from ..streaming import weekly as w
from .registry import query

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
ORDERS = "o_orderkey bigint, o_orderdate timestamp_ntz, o_orderstatus string, o_orderpriority string"


def _stream(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    # written as a pattern: a streaming source then takes a single file as well as a folder of files
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


@query(
    """SELECT date_trunc('week', ts)::DATE::VARCHAR AS week_start, event_type AS "group", count(*) AS count FROM events GROUP BY ALL"""
)
def stream_weekly_counts(spark, folder):
    home = new_folder(spark, "stream-counts")
    counts = w.stream_weekly_counts(_stream(spark, folder, "events", EVENTS), "ts", "event_type")
    w.run_weekly_counts(counts, home).awaitTermination()
    return w.current_counts(spark, home).withColumn("week_start", F.col("week_start").cast("string"))


# weeks that the watermark (newest day minus seven) has passed
@query(
    """WITH n AS (SELECT o_orderstatus AS g, date_trunc('week', o_orderdate)::DATE AS d FROM orders WHERE substr(o_orderpriority, 1, 1) <= '2'),
closed AS (SELECT max(o_orderdate)::TIMESTAMP - INTERVAL 7 DAY AS mark FROM orders WHERE substr(o_orderpriority, 1, 1) <= '2'),
wk AS (SELECT g, d, count(*) AS c FROM n, closed WHERE d + INTERVAL 7 DAY <= mark GROUP BY ALL),
hz AS (SELECT min(d) AS a, max(d) AS b FROM wk),
gr AS (SELECT g, a, unnest(range(0, date_diff('day', a, b) // 7 + 1))::INTEGER AS i FROM (SELECT DISTINCT g FROM wk), hz),
dn AS (SELECT gr.g, (a + i * 7)::DATE AS d, i, coalesce(c, 0) AS c FROM gr LEFT JOIN wk ON wk.g = gr.g AND wk.d = (a + i * 7)::DATE),
sc AS (SELECT *, avg(c) OVER b AS mu, stddev_samp(c) OVER b AS sd, lag(c) OVER (PARTITION BY g ORDER BY i) AS p FROM dn
  WINDOW b AS (PARTITION BY g ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))
SELECT g AS "group", d::VARCHAR AS week_start, c AS count, p AS prev_week, c - p AS wow_delta,
  round_even((c - mu) / greatest(sd, sqrt(greatest(mu, 1.0::DOUBLE))), 2) AS z
FROM sc WHERE i >= 4 AND c >= 8 AND (c - mu) / greatest(sd, sqrt(greatest(mu, 1.0::DOUBLE))) >= 3.5"""
)
def stream_alerts(spark, folder):
    home = new_folder(spark, "stream-alerts")
    orders = _stream(spark, folder, "orders", ORDERS).where("substring(o_orderpriority, 1, 1) <= '2'")
    w.run_alerts(w.stream_weekly_counts(orders, "o_orderdate", "o_orderstatus"), home).awaitTermination()
    alerts = w.read_alerts(spark, home).withColumn("week_start", F.col("week_start").cast("string"))
    return alerts.select("group", "week_start", "count", "prev_week", "wow_delta", "z")


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def stream_ingest(spark, folder):
    home = new_folder(spark, "stream-ingest")
    events = _stream(spark, folder, "events", EVENTS)
    repeated = events.select("event_id", "ts", "event_type", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
    w.run_ingest(w.stream_ingest(repeated, "event_id", "ts"), home).awaitTermination()
    rows = spark.read.schema("event_id bigint, ts timestamp, event_type string").parquet(f"{home}/rows")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))
