"""The streaming operators, run over a finished stream, and the same windows in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import sightings as S
from . import views as V
from .base import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("", "SELECT (epoch_us(date_trunc('day', ts)) / 1000000)::BIGINT AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def sighting_windows(spark, sf):
    """The operator over a bounded table: a watermark has no effect there."""
    out = S.windowed(V.table(spark, sf, "events").select("ts", "event_type", "value"))
    return out.select(F.unix_seconds("window.start").alias("start_s"), "event_type", "n", "value")


@query("", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s, ts FROM g) SELECT user_id, (epoch_us(min(ts)) // 1000000)::BIGINT AS start_s, count(*) AS n FROM s GROUP BY user_id, s")
def sighting_bursts(spark, sf):
    out = S.bursts(V.table(spark, sf, "events").select("ts", "user_id"))
    return out.select("user_id", F.unix_seconds("session_window.start").alias("start_s"), "n")
