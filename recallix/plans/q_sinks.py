"""Queries of the sinks, logs and cold tables: each writes what its operator writes and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.retrieval import knn, tfidf
from ..sources import files
from ..sources.scratch import new_path, stored
from ..streaming import wal
from .q_retrieval import _TFIDF
from .registry import query


@query("s1_ingest_events", "SELECT event_id, agent_id, event_type, importance FROM ev")
def s1(t):
    """Events as JSON lines, read with the fixed schema."""
    path = new_path(t.spark, "events-json")
    t.ev.select("event_id", "agent_id", "event_type", "importance").write.json(path)
    return files.read_events(t.spark, path).select("event_id", "agent_id", "event_type", "importance")


@query("s2_ingest_vectors", "SELECT 'seg_' || label AS segment_id, 'vec_' || vec_id AS object_id, len(embedding) AS width FROM embeddings WHERE label IN (1, 2)")
def s2(t):
    """Vectors with object ids into named segments; a read of some segments touches their folders only."""
    path = new_path(t.spark, "segments")
    t.embeddings.select(F.concat(F.lit("seg_"), "label").alias("segment_id"), F.concat(F.lit("vec_"), "vec_id").alias("object_id"), "embedding").write.partitionBy("segment_id").parquet(path)
    return t.spark.read.parquet(path).where(F.col("segment_id").isin("seg_1", "seg_2")).select("segment_id", "object_id", F.size("embedding").cast("long").alias("width"))


@query("s4_assemble_documents", "SELECT conv_id AS batch_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id")
def s4(t):
    """Upload parts out of order, some twice; batches divisible by 3 lack a part and aren't assembled."""
    total = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    c = t.conversations.join(total, "conv_id").select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("idx"), (F.col("n") + F.when(F.col("conv_id") % 3 == 0, 1).otherwise(0)).alias("total"), "text")
    return files.assemble_documents(c.unionByName(c.where("idx % 2 = 0")))


@query("s15_log_stream", "SELECT event_id, event_type FROM ev WHERE event_type IN ('tool_call', 'tool_result')")
def s15(t):
    """The log as a stream of JSON lines: a subscriber's filter runs on it, and what it passes on is read back."""
    source, out = new_path(t.spark, "log-json"), new_path(t.spark, "subscribed")
    t.ev.select("event_id", "event_type").write.json(source)
    passed = files.read_events(t.spark, source, stream=True).where(F.col("event_type").isin("tool_call", "tool_result")).select("event_id", "event_type")
    passed.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(t.spark, "subscriber-state")).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("event_id string, event_type string").parquet(out)


@query("s16_list_cold_objects", "SELECT memory_id, namespace FROM doc WHERE namespace IN (SELECT namespace FROM doc GROUP BY namespace ORDER BY namespace LIMIT 3)")
def s16(t):
    """Archived objects under some prefixes: folders of a partitioned table, pruned before any file is read."""
    path = new_path(t.spark, "cold")
    t.doc.select("memory_id", "namespace").write.partitionBy("namespace").parquet(path)
    wanted = [r[0] for r in t.doc.select("namespace").distinct().orderBy("namespace").limit(3).collect()]
    return t.spark.read.schema("memory_id string, namespace string").parquet(path).where(F.col("namespace").isin(*wanted))


@query("k1_append_log", "SELECT event_id, 100 + row_number() OVER (ORDER BY ts, event_id) AS lsn FROM ev")
def k1(t):
    """Sequence numbers go on from the last one of the log, here 100."""
    return files.with_lsn(t.ev.select("event_id", "ts"), 100, ["ts", "event_id"]).select("event_id", "lsn")


@query("k2_canonical_projection", "SELECT event_id, 'mem_' || event_id AS memory_id FROM ev WHERE k <> 13 UNION ALL SELECT event_id, NULL FROM ev WHERE k = 13")
def k2(t):
    """The log as a stream, projected by micro-batches; replays add nothing, rejected events are dead letters."""
    source, out = new_path(t.spark, "stream"), new_path(t.spark, "projected")
    rows = t.ev.drop("causal_refs").withColumn("causal_refs", F.array().cast("array<string>"))
    rows.unionByName(rows.where("n % 10 = 0")).write.parquet(source)
    wal.project(t.spark.readStream.schema(rows.schema).parquet(source), new_path(t.spark, "stream-state"), out, F.col("k") != 13).awaitTermination()
    good = t.spark.read.parquet(f"{out}/events").select("event_id", F.concat(F.lit("mem_"), "event_id").alias("memory_id"))
    return good.unionByName(t.spark.read.parquet(f"{out}/dead_letters").select("event_id", F.lit(None).cast("string").alias("memory_id")).distinct())


@query("k8_dataset_purge", "SELECT memory_id FROM memory WHERE NOT (dataset_name = 'ds_1' AND NOT is_active)")
def k8(t):
    """A hard delete of a dataset's inactive rows: the table that stays is written beside the old one."""
    stay, _ = files.purge(t.memory.select("memory_id", "dataset_name", "is_active"), (F.col("dataset_name") == "ds_1") & ~F.col("is_active"), {}, "memory_id")
    return stored(stay).select("memory_id")


@query("k9_purge_cascade", "SELECT 'edge' AS kind, count(*) AS n FROM edge WHERE src NOT IN (SELECT memory_id FROM memory WHERE k % 7 = 3) UNION ALL SELECT 'policy', count(*) FROM policy WHERE object_id NOT IN (SELECT memory_id FROM memory WHERE k % 7 = 3) UNION ALL SELECT 'memory', count(*) FROM memory WHERE k % 7 <> 3")
def k9(t):
    stay, rest = files.purge(t.memory, F.col("k") % 7 == 3, {"edge": (t.edge, "src"), "policy": (t.policy, "object_id")}, "memory_id")
    count = lambda name, df: df.agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("n"))
    return count("memory", stay).unionByName(count("edge", rest["edge"])).unionByName(count("policy", rest["policy"]))


@query("k13_archive_memory", "SELECT memory_id, CASE WHEN lifecycle_state = 'archived' THEN 'cold' ELSE 'warm' END AS tier FROM memory")
def k13(t):
    """Archived rows move to the cold tier, a partition of its own, and leave the warm one."""
    path = new_path(t.spark, "tiers")
    t.memory.select("memory_id", "content", F.when(F.col("lifecycle_state") == "archived", "cold").otherwise("warm").alias("tier")).write.partitionBy("tier").parquet(path)
    return t.spark.read.parquet(path).select("memory_id", "tier")


@query("k14_snapshot_export", "SELECT memory_id, version, importance FROM memory")
def k14(t):
    path = new_path(t.spark, "snapshot")
    files.export_snapshot(t.memory.select("memory_id", "version", "importance"), path)
    return t.spark.read.parquet(path)


@query("k15_append_policy", "SELECT object_id, count(*) AS n, max(seq) AS last FROM policy GROUP BY object_id")
def k15(t):
    """The policy log is only ever appended to: two appends hold what one table did."""
    path = new_path(t.spark, "policy-log")
    files.append(t.policy.where("seq % 2 = 0"), path)
    files.append(t.policy.where("seq % 2 = 1"), path)
    return t.spark.read.parquet(path).groupBy("object_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))


@query("k16_append_audit", "SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS n FROM ev WHERE event_type = 'tool_call' GROUP BY day")
def k16(t):
    path = new_path(t.spark, "audit-log")
    files.append(t.ev.where("event_type = 'tool_call'").select("event_id", F.date_format("ts", "yyyyMMdd").alias("day")), path, ["day"])
    return t.spark.read.schema("event_id string, day string").parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("k17_delete_by_shard", "SELECT memory_id FROM memory WHERE k % 5 <> 2")
def k17(t):
    """Deletes meet their rows by key: both sides are dealt by it, and only keys of the deletes go."""
    gone = t.memory.where("k % 5 = 2").select("memory_id")
    return t.memory.select("memory_id").join(gone, "memory_id", "left_anti")


@query("f21_applied_filters", "SELECT agent_id, 'tenant,workspace' || CASE WHEN min(k) < 5 THEN ',quarantine' ELSE '' END AS filters FROM memory GROUP BY agent_id")
def f21(t):
    tokens = F.array(F.lit("tenant"), F.lit("workspace"), F.when(F.min("k") < 5, "quarantine"))
    return t.memory.groupBy("agent_id").agg(F.array_join(tokens, ",").alias("filters"))


@query("f23_sanitise_response", "SELECT memory_id, content FROM memory")
def f23(t):
    """Debug fields don't leave the service; the rest of a response does."""
    debug = {"debug_score", "trace_ref"}
    rows = t.memory.select("memory_id", "content", F.col("k").alias("debug_score"), F.col("lsn").alias("trace_ref"))
    return rows.drop(*(c for c in rows.columns if c in debug))


@query("p13_within_distance", "SELECT c_custkey, s_suppkey FROM customer, supplier WHERE c_custkey % 50 = 0 AND sqrt((c_custkey % 100 - s_suppkey % 100) * (c_custkey % 100 - s_suppkey % 100) + (c_nationkey - s_nationkey) * (c_nationkey - s_nationkey)) <= 2")
def p13(t):
    """Points within a distance: cells of that width meet their neighbours by an equi-join, then the distance decides."""
    a = t.customer.where("c_custkey % 50 = 0").select("c_custkey", (F.col("c_custkey") % 100).alias("x"), F.col("c_nationkey").alias("y"))
    b = t.supplier.select("s_suppkey", (F.col("s_suppkey") % 100).alias("u"), F.col("s_nationkey").alias("v"))
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    near = a.withColumn("i", F.explode(F.transform(steps, lambda s: F.floor(F.col("x") / 2) + s))).withColumn("j", F.explode(F.transform(steps, lambda s: F.floor(F.col("y") / 2) + s)))
    met = near.join(b.withColumns({"i": F.floor(F.col("u") / 2), "j": F.floor(F.col("v") / 2)}), ["i", "j"])
    return met.where(F.sqrt((F.col("x") - F.col("u")) ** 2 + (F.col("y") - F.col("v")) ** 2) <= 2).select("c_custkey", "s_suppkey")


@query("r44_requery_fields", "SELECT memory_id, content FROM memory QUALIFY row_number() OVER (ORDER BY importance DESC, memory_id) <= 20")
def r44(t):
    """Late materialisation: ranks come from narrow rows, the winners' fields from a join after the cut."""
    best = t.memory.select("memory_id", "importance").orderBy(F.col("importance").desc(), "memory_id").limit(20).select("memory_id")
    return t.memory.select("memory_id", "content").join(F.broadcast(best), "memory_id", "left_semi")


@query("r46_search_iterator", "SELECT memory_id, importance FROM memory WHERE importance < 0.7 OR (importance = 0.7 AND memory_id > 'mem_evt_5') ORDER BY importance DESC, memory_id LIMIT 25")
def r46(t):
    """The next page starts below the last one's bound: a filter and a partial sort, whatever the page's number."""
    after = (F.col("importance") < 0.7) | ((F.col("importance") == 0.7) & (F.col("memory_id") > "mem_evt_5"))
    return t.memory.where(after).orderBy(F.col("importance").desc(), "memory_id").limit(25).select("memory_id", "importance")


@query("x2_reindex_cold", "SELECT memory_id, count(*) AS buckets FROM (SELECT DISTINCT memory_id, bucket FROM vt) GROUP BY memory_id", _TFIDF)
def x2(t):
    """Archived rows are embedded again from their content, or their summary where it is empty."""
    text = F.coalesce(F.when(F.trim("content") != "", F.col("content")), F.col("summary"))
    return tfidf(t.doc.select("memory_id", text.alias("text")).where("text is not null"), "memory_id", "text").groupBy(F.col("object_id").alias("memory_id")).agg(F.countDistinct("bucket").alias("buckets"))


@query("x15_serial_batch", "SELECT query_id, object_id, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS object_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE rank <= 5")
def x15(t):
    """The batch search a block of queries at a time, which must equal the whole one."""
    return knn(t.embeddings, t.embeddings.where("vec_id % 100 = 0"), 5, "ip", max_query_bytes=4 * 64 * 8).select("query_id", "object_id", "rank")


@query("t3_late_projections", "SELECT event_id FROM ev WHERE k > 60")
def t3(t):
    """Rows that became visible later than the deadline of a minute after they were accepted."""
    shown = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("k") * 1_000_000)
    return wal.breaches(t.ev.select("event_id", F.col("ts").cast("timestamp").alias("accepted_at"), shown.alias("visible_at")), 60).select("event_id")
