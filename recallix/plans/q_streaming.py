"""Queries over windows of time, the batch form of the streaming operators (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.scratch import new_path
from ..streaming import wal
from .registry import query


@query("t1_subscriber_poll", "SELECT event_id, lsn FROM ev WHERE lsn > 300 AND lsn <= 364")
def t1(t):
    return wal.poll(t.ev.select("event_id", "lsn"), 300, 64)


@query("t2_visible_watermark", "SELECT coalesce(min(lsn) FILTER (k % 97 = 0) - 1, max(lsn)) AS watermark FROM ev")
def t2(t):
    return wal.visible_watermark(t.ev.select("lsn"), t.ev.where("k % 97 != 0").select("lsn"))


@query("t4_bounded_read", "SELECT event_id FROM ev WHERE lsn <= 5100")
def t4(t):
    return wal.read_at(t.ev, "bounded", 5000, 100).select("event_id")


@query("t5_idempotent_replay", "SELECT event_id, lsn FROM ev")
def t5(t):
    twice = t.ev.unionByName(t.ev.withColumn("lsn", F.col("lsn") + 10_000_000))
    return twice.groupBy("event_id").agg(F.min("lsn").alias("lsn"))


@query("t6_every_tenth_state", "SELECT agent_id, unnest(range(10, n + 1, 10)) AS at FROM (SELECT agent_id, count(*) AS n FROM ev GROUP BY agent_id)")
def t6(t):
    """The log as a stream; each agent's count is state that outlives a micro-batch."""
    source, out = new_path(t.spark, "counted-log"), new_path(t.spark, "marks")
    t.ev.select("agent_id", "lsn").write.parquet(source)
    stream = t.spark.readStream.schema("agent_id string, lsn long").option("maxFilesPerTrigger", 16).parquet(source)
    marks = wal.every_nth(stream, 10).writeStream.format("parquet").outputMode("append")
    marks.option("path", out).option("checkpointLocation", new_path(t.spark, "marks-state")).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("agent_id string, at long").parquet(out)


@query("t7_retry_dead_letters", "SELECT event_id, least(k % 5 + 1, 3) AS attempts, CASE WHEN k % 5 < 3 THEN 'visible' ELSE 'dead_letter' END AS outcome FROM ev")
def t7(t):
    """Projections that fail up to four times, of which three are tried."""
    done = wal.project_with_retry(t.ev.select("event_id", "k"), lambda rows, n: rows.withColumn("ok", F.col("k") % 5 < n), 3, 0.01)
    return done.select("event_id", "attempts", "outcome")


@query("t9_micro_batches", "SELECT (lsn - 1) // 32 AS batch, count(*) AS n, min(lsn) AS first_lsn, max(lsn) AS last_lsn FROM ev GROUP BY batch")
def t9(t):
    return wal.micro_batches(t.ev.select("lsn"))


@query("t8_shard_keys", "SELECT CAST(crc32_shard AS BIGINT) AS shard, count(*) AS n FROM (SELECT CAST('0x' || substr(md5(tenant_id || '|' || agent_id || '|' || session_id), 1, 8) AS BIGINT) % 16 AS crc32_shard FROM ev) GROUP BY 1")
def t8(t):
    shard = F.conv(F.substring(F.md5(F.concat_ws("|", "tenant_id", "agent_id", "session_id")), 1, 8), 16, 10).cast("long") % 16
    return t.ev.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("t10_sliding_rate", "SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 10 SECOND, ts) - to_seconds(10 * i) AS start FROM events, (SELECT unnest(range(0, 6)) AS i)) GROUP BY start")
def t10(t):
    return wal.sliding_rate(t.events)


@query("t_tumbling_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL")
def t_tumbling(t):
    return wal.tumbling(t.events)


@query("t_session_window", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def t_session(t):
    return wal.sessions(t.events)
