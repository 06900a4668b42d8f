"""Canonical tables of the engine derived from the raw tables, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" is always a parameter; the queries take this one.
NOW = "2024-02-01 00:00:00"
QUERY = "the eron of thion"


class Tables:
    """Raw and canonical tables of one folder, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.raw(name)

    @cached_property
    def ev(self) -> DataFrame:
        """The log: one row for each event, in order of lsn."""
        n, k = F.col("n"), F.col("k")
        e = self.raw("events").select(F.col("event_id").alias("n"), "ts", "user_id", F.col("event_type").alias("raw_type"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
        kind = F.create_map(*(F.lit(x) for x in ("click", "user_message", "view", "tool_call", "purchase", "tool_result", "signup", "state_update", "error", "critique_generated")))
        refs = F.when((n % 5 == 0) & (n >= 7), F.array(F.concat(F.lit("evt_"), n - 7), F.concat(F.lit("evt_"), n - 3))).otherwise(F.array().cast("array<string>"))
        return e.select(
            "n", "k", "ts", "user_id", "value",
            F.concat(F.lit("evt_"), n).alias("event_id"), (n + 1).alias("lsn"),
            F.concat(F.lit("agent_"), "user_id").alias("agent_id"),
            F.concat(F.lit("sess_"), "user_id", F.lit("_"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
            F.concat(F.lit("ws_"), F.col("user_id") % 4).alias("workspace_id"),
            F.concat(F.lit("tenant_"), F.col("user_id") % 2).alias("tenant_id"),
            kind[F.col("raw_type")].alias("event_type"),
            F.least(F.col("value") / 200.0, F.lit(1.0)).alias("importance"), (k / 100.0).alias("confidence"),
            F.when((n % 3 == 0) & (n >= 1), F.concat(F.lit("evt_"), n - 1)).otherwise("").alias("parent_event_id"),
            refs.alias("causal_refs"),
            F.element_at(F.array(*(F.lit(v) for v in ("private", "session", "workspace", "public", ""))), (k % 5 + 1).cast("int")).alias("visibility"),
            (n % 7 + 1).alias("version"),
            F.concat(F.lit("Value "), F.round(F.col("value") * 100).cast("long"), F.lit(" by agent "), "user_id", F.lit(" as "), kind[F.col("raw_type")]).alias("text"),
            F.when(k % 10 == 0, "preference_constraint").when(k % 10 == 1, "profile").when(k % 10 == 2, "factual").otherwise("").alias("payload_memory_type"),
        )

    @cached_property
    def memory(self) -> DataFrame:
        from ..operators.materialize import memory_type

        n, k = F.col("n"), F.col("k")
        states = ("active", "reinforced", "stale", "archived", "quarantined", "candidate", "compressed", "hidden")
        tags = F.filter(F.array(F.when(k == 13, "quarantine"), F.when(k % 11 == 0, "noise"), F.when(k % 17 == 0, "unverified"), F.when(k % 3 == 0, "reviewed")), lambda t: t.isNotNull())
        return self.ev.select(
            "n", "k", "event_id", F.concat(F.lit("mem_"), "event_id").alias("memory_id"), memory_type(F.col("payload_memory_type"), F.col("event_type")).alias("memory_type"),
            "agent_id", "session_id", "workspace_id", "tenant_id", F.col("text").alias("content"), F.concat(F.col("event_type"), F.lit(" note")).alias("summary"),
            "importance", "confidence", ((n % 10 + 1) / 10.0).alias("freshness"), (n % 4).alias("level"), "version", "lsn",
            F.when(k % 4 == 0, k * 86400).otherwise(0).cast("long").alias("ttl"), F.col("ts").alias("valid_from"),
            F.when(n % 6 == 0, F.col("ts") + F.expr("INTERVAL '10' DAY")).alias("valid_to"),
            (n % 9 != 0).alias("is_active"), F.element_at(F.array(*(F.lit(s) for s in states)), (n % 8 + 1).cast("int")).alias("lifecycle_state"),
            tags.alias("policy_tags"), F.filter(F.array("event_id", "parent_event_id"), lambda x: x != "").alias("source_event_ids"),
            F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("ds_"), k % 3)).alias("dataset_name"), F.concat(F.lit("file_"), k % 5, F.lit(".txt")).alias("source_file_name"),
            F.date_format("ts", "yyyyMMdd").alias("import_batch_id"), "visibility",
        )

    @cached_property
    def policy(self) -> DataFrame:
        """One or two decisions on some memories; seq is the order of the log."""
        n, k = F.col("n"), F.col("k")
        rows = self.ev.where(n % 4 == 0).select("n", "k", F.concat(F.lit("mem_"), "event_id").alias("object_id"), F.explode(F.when(n % 8 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("turn"))
        turn = F.col("turn")
        return rows.select(
            "object_id", (n * 2 + turn).alias("seq"), F.concat(F.lit("pol_"), F.lpad((n * 2 + turn).cast("string"), 9, "0")).alias("policy_event_id"),
            ((k + turn * 3) % 10 / 10.0).alias("salience_weight"), F.when((k + turn) % 6 == 0, 0.9).otherwise(0.0).alias("confidence_override"),
            ((k + turn) % 12 == 0).alias("quarantine_flag"), F.when((k + turn) % 5 == 0, k * 3600).otherwise(0).cast("long").alias("ttl"),
            F.element_at(F.array(F.lit("verified"), F.lit("retracted"), F.lit("")), ((k + turn) % 3 + 1).cast("int")).alias("verified_state"),
        )

    @cached_property
    def edge(self) -> DataFrame:
        """Memory to memory: a chain of every third, a tree by halving, and what the derivations add."""
        n, k = F.col("n"), F.col("k")
        mem = lambda x: F.concat(F.lit("mem_evt_"), x.cast("long"))
        chain = self.ev.where((n % 3 == 0) & (n >= 1)).select(mem(n).alias("src"), mem(n - 1).alias("dst"), F.lit("derived_from").alias("edge_type"), "n", "k", "ts")
        tree = self.ev.where(n >= 1).select(mem(n).alias("src"), mem(F.floor(n / 2)).alias("dst"), F.lit("projected_from").alias("edge_type"), "n", "k", "ts")
        return chain.unionByName(tree).select(
            F.concat(F.lit("edge_"), "src", F.lit("_"), "edge_type", F.lit("_"), "dst").alias("edge_id"), "src", "dst", "edge_type", ((k + 1) / 100.0).alias("weight"),
            F.concat(F.lit("evt_"), "n").alias("provenance_ref"), F.when(n % 10 == 0, F.col("ts") + F.expr("INTERVAL '5' DAY")).alias("expires_at"),
        )

    @cached_property
    def doc(self) -> DataFrame:
        """Documents as archived memories."""
        d = self.raw("documents").alias("d").join(self.raw("labels").withColumnRenamed("doc_id", "lab_id"), F.col("doc_id") == F.col("lab_id"), "left")
        return d.select("doc_id", F.concat(F.lit("mem_"), "doc_id").alias("memory_id"), F.col("text").alias("content"), F.concat(F.col("lang"), F.lit(" page of "), "source").alias("summary"), F.col("lang").alias("dataset_name"), F.col("source").alias("namespace"), "n_chars", (F.col("n_chars") % 97 / 96.0).alias("importance"), (F.col("doc_id") % 50 / 49.0).alias("confidence"), (F.col("doc_id") % 11 / 10.0).alias("freshness"), (F.col("doc_id") % 13 + 1).alias("version"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("quarantine"), F.col("quality"))

    @cached_property
    def agent(self) -> DataFrame:
        return self.raw("customer").select(F.concat(F.lit("agent_"), "c_custkey").alias("agent_id"), F.lower("c_mktsegment").alias("role"), F.concat(F.lit("ws_"), F.col("c_nationkey") % 4).alias("workspace_id"), F.concat(F.lit("tenant_"), F.col("c_nationkey") % 2).alias("tenant_id"))

    @cached_property
    def contract(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.raw("nation").select(F.concat(F.lit("contract_"), n).alias("contract_id"), F.when(n % 3 == 0, F.concat(F.lit("ws_"), n % 4)).otherwise("").alias("workspace_id"), F.array(F.concat(F.lit("agent_"), n), F.concat(F.lit("agent_"), n + 25)).alias("read_agents"), F.array(F.when(n % 2 == 0, "building").otherwise("machinery")).alias("read_roles"), F.when(n % 5 == 0, F.lit("*")).when(n % 5 == 1, F.concat(F.lit("agent:agent_"), n, F.lit("; role:automobile"))).otherwise("").alias("read_acl"))


#: The same tables for DuckDB, in the order of their use.
PRELUDE = """
ev AS (
  SELECT *, 'Value ' || CAST(round(value * 100) AS BIGINT) || ' by agent ' || user_id || ' as ' || event_type AS text FROM (
  SELECT event_id AS n, k, ts, user_id, value, 'evt_' || event_id AS event_id, event_id + 1 AS lsn, 'agent_' || user_id AS agent_id,
    'sess_' || user_id || '_' || strftime(ts, '%Y%m%d') AS session_id, 'ws_' || user_id % 4 AS workspace_id, 'tenant_' || user_id % 2 AS tenant_id,
    CASE event_type WHEN 'click' THEN 'user_message' WHEN 'view' THEN 'tool_call' WHEN 'purchase' THEN 'tool_result' WHEN 'signup' THEN 'state_update' WHEN 'error' THEN 'critique_generated' END AS event_type,
    least(value / 200.0::DOUBLE, 1.0::DOUBLE) AS importance, k / 100.0::DOUBLE AS confidence,
    CASE WHEN event_id % 3 = 0 AND event_id >= 1 THEN 'evt_' || (event_id - 1) ELSE '' END AS parent_event_id,
    CASE WHEN event_id % 5 = 0 AND event_id >= 7 THEN ['evt_' || (event_id - 7), 'evt_' || (event_id - 3)] ELSE CAST([] AS VARCHAR[]) END AS causal_refs,
    ['private', 'session', 'workspace', 'public', ''][k % 5 + 1] AS visibility, event_id % 7 + 1 AS version,
    CASE k % 10 WHEN 0 THEN 'preference_constraint' WHEN 1 THEN 'profile' WHEN 2 THEN 'factual' ELSE '' END AS payload_memory_type
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))
), memory AS (
  SELECT n, k, event_id, 'mem_' || event_id AS memory_id,
    CASE WHEN payload_memory_type <> '' THEN payload_memory_type WHEN event_type IN ('user_message', 'assistant_message') THEN 'episodic' WHEN event_type IN ('critique_generated', 'reflection') THEN 'reflective' WHEN event_type = 'plan_updated' THEN 'procedural' WHEN event_type = 'tool_result_returned' THEN 'factual' ELSE 'episodic' END AS memory_type,
    agent_id, session_id, workspace_id, tenant_id, text AS content, event_type || ' note' AS summary, importance, confidence, (n % 10 + 1) / 10.0::DOUBLE AS freshness, n % 4 AS level, version, lsn,
    CAST(CASE WHEN k % 4 = 0 THEN k * 86400 ELSE 0 END AS BIGINT) AS ttl, ts AS valid_from, CASE WHEN n % 6 = 0 THEN ts + INTERVAL 10 DAY END AS valid_to,
    n % 9 <> 0 AS is_active, ['active', 'reinforced', 'stale', 'archived', 'quarantined', 'candidate', 'compressed', 'hidden'][n % 8 + 1] AS lifecycle_state,
    list_filter([CASE WHEN k = 13 THEN 'quarantine' END, CASE WHEN k % 11 = 0 THEN 'noise' END, CASE WHEN k % 17 = 0 THEN 'unverified' END, CASE WHEN k % 3 = 0 THEN 'reviewed' END], lambda t: t IS NOT NULL) AS policy_tags,
    list_filter([event_id, parent_event_id], lambda x: x <> '') AS source_event_ids, CASE WHEN k % 7 = 0 THEN '' ELSE 'ds_' || k % 3 END AS dataset_name, 'file_' || k % 5 || '.txt' AS source_file_name,
    strftime(ts, '%Y%m%d') AS import_batch_id, visibility
  FROM ev
), policy AS (
  SELECT 'mem_' || event_id AS object_id, n * 2 + turn AS seq, 'pol_' || lpad(CAST(n * 2 + turn AS VARCHAR), 9, '0') AS policy_event_id, (k + turn * 3) % 10 / 10.0::DOUBLE AS salience_weight,
    CASE WHEN (k + turn) % 6 = 0 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS confidence_override, (k + turn) % 12 = 0 AS quarantine_flag, CAST(CASE WHEN (k + turn) % 5 = 0 THEN k * 3600 ELSE 0 END AS BIGINT) AS ttl,
    ['verified', 'retracted', ''][(k + turn) % 3 + 1] AS verified_state
  FROM (SELECT *, unnest(CASE WHEN n % 8 = 0 THEN [0, 1] ELSE [0] END) AS turn FROM ev WHERE n % 4 = 0)
), edge AS (
  SELECT 'edge_' || src || '_' || edge_type || '_' || dst AS edge_id, src, dst, edge_type, (k + 1) / 100.0::DOUBLE AS weight, 'evt_' || n AS provenance_ref, CASE WHEN n % 10 = 0 THEN ts + INTERVAL 5 DAY END AS expires_at
  FROM (SELECT 'mem_evt_' || n AS src, 'mem_evt_' || (n - 1) AS dst, 'derived_from' AS edge_type, n, k, ts FROM ev WHERE n % 3 = 0 AND n >= 1
        UNION ALL SELECT 'mem_evt_' || n, 'mem_evt_' || (n // 2), 'projected_from', n, k, ts FROM ev WHERE n >= 1)
), doc AS (
  SELECT d.doc_id, 'mem_' || d.doc_id AS memory_id, d.text AS content, d.lang || ' page of ' || d.source AS summary, d.lang AS dataset_name, d.source AS namespace, d.n_chars, d.n_chars % 97 / 96.0::DOUBLE AS importance,
    d.doc_id % 50 / 49.0::DOUBLE AS confidence, d.doc_id % 11 / 10.0::DOUBLE AS freshness, d.doc_id % 13 + 1 AS version, coalesce(l.toxic = 1, false) AS quarantine, l.quality
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
), agent AS (
  SELECT 'agent_' || c_custkey AS agent_id, lower(c_mktsegment) AS role, 'ws_' || c_nationkey % 4 AS workspace_id, 'tenant_' || c_nationkey % 2 AS tenant_id FROM customer
), contract AS (
  SELECT 'contract_' || n_nationkey AS contract_id, CASE WHEN n_nationkey % 3 = 0 THEN 'ws_' || n_nationkey % 4 ELSE '' END AS workspace_id, ['agent_' || n_nationkey, 'agent_' || (n_nationkey + 25)] AS read_agents,
    [CASE WHEN n_nationkey % 2 = 0 THEN 'building' ELSE 'machinery' END] AS read_roles, CASE n_nationkey % 5 WHEN 0 THEN '*' WHEN 1 THEN 'agent:agent_' || n_nationkey || '; role:automobile' ELSE '' END AS read_acl FROM nation
)"""


def sql(select: str, ctes: str = "") -> str:
    """A query over the canonical tables for DuckDB."""
    return f"WITH RECURSIVE {PRELUDE.strip()}{', ' + ctes if ctes else ''}\n{select}"
