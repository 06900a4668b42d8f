"""Queries over scans, mutations and materialization (S, K, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import object_type
from ..operators import filters, graph
from ..operators import materialize as mz
from .registry import query

_T = "TIMESTAMP '2024-01-20 00:00:00'"


@query("s3_chunk_text", "SELECT doc_id, CAST(c AS BIGINT) AS chunk_no, CAST(c * 360 AS BIGINT) AS start, md5(substr(text, CAST(c * 360 + 1 AS BIGINT), 400)) AS chunk_md5 FROM (SELECT *, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(length(text) - 1 - 40, 0) // 360 + 1 END)) AS c FROM documents)")
def s3(t):
    return mz.fixed_chunks(t.documents, "doc_id", "text").select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("start").cast("long").alias("start"), F.md5("chunk").alias("chunk_md5"))


@query("s5_wal_scan", "SELECT event_id, lsn FROM ev WHERE lsn >= 501")
def s5(t):
    return t.ev.where("lsn >= 501").select("event_id", "lsn")


@query("s6_list_memories", "SELECT memory_id, session_id, importance FROM memory WHERE agent_id = 'agent_7'")
def s6(t):
    return t.memory.where(filters.equal_when_set(agent_id="agent_7", session_id="")).select("memory_id", "session_id", "importance")


@query("s7_list_events", "SELECT event_id, event_type, lsn FROM ev WHERE agent_id = 'agent_3'")
def s7(t):
    return t.ev.where(filters.equal_when_set(agent_id="agent_3")).select("event_id", "event_type", "lsn")


@query("s8_list_states", "SELECT event_id, 'value' AS state_key, CAST(k AS VARCHAR) AS state_value FROM ev WHERE event_type = 'state_update'")
def s8(t):
    return mz.states(t.ev).where("state_key = 'value'").select("event_id", "state_key", "state_value")


@query("s9_list_artifacts", "SELECT 'art_' || event_id AS artifact_id, session_id, event_type AS artifact_type FROM ev WHERE event_type IN ('tool_call', 'tool_result')")
def s9(t):
    return mz.artifacts(t.ev).select("artifact_id", "session_id", "artifact_type")


@query("s10_agent_list", "SELECT agent_id, role, workspace_id FROM agent WHERE role = 'building' AND workspace_id = 'ws_1'")
def s10(t):
    return t.agent.where(filters.equal_when_set(role="building", workspace_id="ws_1", tenant_id="")).select("agent_id", "role", "workspace_id")


_SEED = "SELECT memory_id AS id FROM memory WHERE agent_id = 'agent_5'"


def _seeds(t):
    return t.memory.where("agent_id = 'agent_5'").select(F.col("memory_id").alias("id"))


@query("s11_bulk_edges", f"SELECT DISTINCT edge_id, src, dst FROM edge WHERE src IN ({_SEED}) OR dst IN ({_SEED})")
def s11(t):
    return graph.bulk_edges(_seeds(t), t.edge).select("edge_id", "src", "dst")


@query("s12_edges_from", f"SELECT edge_id, src, dst FROM edge WHERE src IN ({_SEED})")
def s12(t):
    return t.edge.join(_seeds(t).withColumnRenamed("id", "src"), "src", "left_semi").select("edge_id", "src", "dst")


@query("s13_edges_to", f"SELECT edge_id, src, dst FROM edge WHERE dst IN ({_SEED})")
def s13(t):
    return t.edge.join(_seeds(t).withColumnRenamed("id", "dst"), "dst", "left_semi").select("edge_id", "src", "dst")


@query("k3_put_memory", "SELECT agent_id, memory_id, version, lsn FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY version DESC, lsn DESC) AS r FROM memory) WHERE r = 1")
def k3(t):
    return mz.latest_per_key(t.memory, ["agent_id"], ["version", "lsn"]).select("agent_id", "memory_id", "version", "lsn")


_M4 = """m4 AS (
  SELECT 'edge_mem_' || event_id || '_event' AS edge_id, 'mem_' || event_id AS src, 'memory' AS src_type, 'caused_by' AS edge_type, event_id AS dst, 'event' AS dst_type, 1.0::DOUBLE AS weight, event_id AS provenance_ref FROM ev
  UNION ALL SELECT 'edge_mem_' || event_id || '_belongs_to_session_' || session_id, 'mem_' || event_id, 'memory', 'belongs_to_session', session_id, 'session', 1.0, event_id FROM ev
  UNION ALL SELECT 'edge_mem_' || event_id || '_owned_by_agent_' || agent_id, 'mem_' || event_id, 'memory', 'owned_by_agent', agent_id, 'agent', 1.0, event_id FROM ev
  UNION ALL SELECT 'edge_mem_' || event_id || '_causal_' || i, 'mem_' || event_id, 'memory', 'derived_from', causal_refs[i + 1], 'event', 0.8, event_id FROM (SELECT *, unnest(range(0, len(causal_refs))) AS i FROM ev)
), m5 AS (
  SELECT 'edge_' || memory_id || '_belongs_to_session_' || session_id AS edge_id, memory_id AS src, 'memory' AS src_type, 'belongs_to_session' AS edge_type, session_id AS dst, 'session' AS dst_type, 1.0::DOUBLE AS weight, event_id AS provenance_ref FROM memory
  UNION ALL SELECT 'edge_' || memory_id || '_owned_by_agent_' || agent_id, memory_id, 'memory', 'owned_by_agent', agent_id, 'agent', 1.0, event_id FROM memory
  UNION ALL SELECT 'edge_' || memory_id || '_derived_from_' || s, memory_id, 'memory', 'derived_from', s, 'event', 1.0, event_id FROM (SELECT *, unnest(source_event_ids) AS s FROM memory)
)"""


@query("k4_merge_edges", "SELECT edge_id, max(src) AS src, max(dst) AS dst, max(edge_type) AS edge_type, max(weight) AS weight FROM (SELECT * FROM m4 UNION ALL SELECT * FROM m5) GROUP BY edge_id", _M4)
def k4(t):
    return mz.merge_edges(mz.memory_base_edges(t.memory), mz.derived_edges(t.ev)).select("edge_id", "src", "dst", "edge_type", "weight")


@query("k5_delete_edges_by_object", f"SELECT edge_id FROM edge WHERE src NOT IN ({_SEED}) AND dst NOT IN ({_SEED})")
def k5(t):
    return filters.without_denied(t.edge, _seeds(t)).select("edge_id")


@query("k6_prune_expired_edges", f"SELECT edge_id, expires_at FROM edge WHERE expires_at IS NULL OR expires_at > {_T}")
def k6(t):
    return t.edge.where("expires_at is null or expires_at > timestamp_ntz '2024-01-20 00:00:00'").select("edge_id", "expires_at")


_MATCH = "(workspace_id = 'ws_1' AND source_file_name LIKE 'file_%' AND CASE WHEN dataset_name <> '' THEN dataset_name = 'ds_1' ELSE regexp_matches(content, '(^|[^A-Za-z0-9_])dataset_name:ds_1($|[^A-Za-z0-9_.-])') END)"


@query("k7_dataset_delete", f"SELECT memory_id, is_active AND NOT {_MATCH} AS is_active, CASE WHEN {_MATCH} THEN 'deleted_logically' ELSE lifecycle_state END AS lifecycle_state FROM memory")
def k7(t):
    hit = filters.dataset_match("ws_1", dataset="ds_1", prefix="file_")
    return t.memory.select("memory_id", (F.col("is_active") & ~hit).alias("is_active"), F.when(hit, "deleted_logically").otherwise(F.col("lifecycle_state")).alias("lifecycle_state"))


@query("k10_dataset_match", f"SELECT memory_id FROM memory WHERE {_MATCH}")
def k10(t):
    return t.memory.where(filters.dataset_match("ws_1", dataset="ds_1", prefix="file_")).select("memory_id")


@query("k11_admin_rollback", f"SELECT memory_id, is_active AND version <= 4 AS is_active, CASE WHEN version > 4 THEN {_T} ELSE valid_to END AS valid_to FROM memory")
def k11(t):
    late = F.col("version") > 4
    return t.memory.select("memory_id", (F.col("is_active") & ~late).alias("is_active"), F.when(late, F.expr("timestamp_ntz '2024-01-20 00:00:00'")).otherwise(F.col("valid_to")).alias("valid_to"))


@query("k12_mark_stale", "SELECT memory_id, is_active AND importance >= 0.1 AS is_active, CASE WHEN importance < 0.1 THEN 'stale' ELSE lifecycle_state END AS lifecycle_state FROM memory")
def k12(t):
    low = F.col("importance") < 0.1
    return t.memory.select("memory_id", (F.col("is_active") & ~low).alias("is_active"), F.when(low, "stale").otherwise(F.col("lifecycle_state")).alias("lifecycle_state"))


@query("k19_partial_upsert", "SELECT o.memory_id, coalesce(n.importance, o.importance) AS importance, coalesce(n.content, o.content) AS content FROM memory o LEFT JOIN (SELECT memory_id, confidence AS importance, CASE WHEN k % 2 = 0 THEN upper(content) END AS content FROM memory WHERE level = 2) n ON o.memory_id = n.memory_id")
def k19(t):
    new = t.memory.where("level = 2").select("memory_id", F.col("confidence").alias("new_importance"), F.when(F.col("k") % 2 == 0, F.upper("content")).alias("new_content"))
    return t.memory.join(new, "memory_id", "left").select("memory_id", F.coalesce("new_importance", "importance").alias("importance"), F.coalesce("new_content", "content").alias("content"))


_VIS = "CASE WHEN visibility <> '' THEN visibility WHEN session_id <> '' THEN 'session' ELSE 'workspace' END"


@query("m1_normalise_event", f"SELECT event_id, {_VIS} AS visibility, importance, CAST(octet_length(encode(text)) AS BIGINT) AS payload_bytes, sha256(text) AS payload_hash FROM ev")
def m1(t):
    return mz.normalise(t.ev).select("event_id", "visibility", "importance", "payload_bytes", "payload_hash")


@query("m2_materialize_event", "SELECT memory_id, memory_type, session_id, version, 'ws_' || CAST(substr(agent_id, 7) AS BIGINT) % 4 AS scope, array_to_string(source_event_ids, ',') AS sources FROM memory")
def m2(t):
    return t.memory.select("memory_id", "memory_type", "session_id", "version", F.col("workspace_id").alias("scope"), F.array_join("source_event_ids", ",").alias("sources"))


@query("m3_resolve_memory_type", "SELECT memory_type, count(*) AS n FROM memory GROUP BY memory_type")
def m3(t):
    return t.ev.groupBy(mz.memory_type(F.col("payload_memory_type"), F.col("event_type")).alias("memory_type")).agg(F.count(F.lit(1)).alias("n"))


@query("m4_derive_edges", "SELECT * FROM m4", _M4)
def m4(t):
    return mz.derived_edges(t.ev)


@query("m5_memory_base_edges", "SELECT * FROM m5", _M4)
def m5(t):
    return mz.memory_base_edges(t.memory)


@query("m6_artifact_base_edges", """
SELECT 'edge_' || a || '_belongs_to_session_' || session_id AS edge_id, a AS src, 'artifact' AS src_type, 'belongs_to_session' AS edge_type, session_id AS dst, 'session' AS dst_type, 1.0::DOUBLE AS weight FROM ar
UNION ALL SELECT 'edge_' || a || '_owned_by_agent_' || agent_id, a, 'artifact', 'owned_by_agent', agent_id, 'agent', 1.0 FROM ar
UNION ALL SELECT 'edge_' || a || '_tool_produces_' || event_id, a, 'artifact', 'tool_produces', event_id, 'event', 1.0 FROM ar""", "ar AS (SELECT *, 'art_' || event_id AS a FROM ev WHERE event_type IN ('tool_call', 'tool_result'))")
def m6(t):
    return mz.artifact_base_edges(mz.artifacts(t.ev))


@query("m7_event_base_edges", """
SELECT 'edge_' || event_id || '_belongs_to_session_' || session_id AS edge_id, event_id AS src, 'event' AS src_type, 'belongs_to_session' AS edge_type, session_id AS dst, 'session' AS dst_type, 1.0::DOUBLE AS weight FROM ev
UNION ALL SELECT 'edge_' || event_id || '_owned_by_agent_' || agent_id, event_id, 'event', 'owned_by_agent', agent_id, 'agent', 1.0 FROM ev
UNION ALL SELECT 'edge_' || event_id || '_caused_by_' || parent_event_id, event_id, 'event', 'caused_by', parent_event_id, 'event', 0.8 FROM ev WHERE parent_event_id <> ''
UNION ALL SELECT 'edge_' || event_id || '_caused_by_' || r, event_id, 'event', 'caused_by', r, 'event', 0.8 FROM (SELECT *, unnest(causal_refs) AS r FROM ev)""")
def m7(t):
    return mz.event_base_edges(t.ev)


_STATE = """st AS (
  SELECT event_id, lsn, ts, CASE WHEN event_type = 'state_update' THEN 'value' ELSE 'last_memory_id' END AS state_key, CASE WHEN event_type = 'state_update' THEN CAST(k AS VARCHAR) ELSE 'mem_' || event_id END AS state_value,
    CASE WHEN event_type = 'state_update' THEN event_type ELSE 'ingest_checkpoint' END AS state_type,
    'state_' || substr(sha256(tenant_id || chr(0) || workspace_id || chr(0) || agent_id || chr(0) || session_id || chr(0) || CASE WHEN event_type = 'state_update' THEN 'value' ELSE 'last_memory_id' END), 1, 24) AS state_id FROM ev
), sv AS (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY lsn) AS version, ts AS valid_from, lead(ts) OVER (PARTITION BY state_id ORDER BY lsn) AS valid_to FROM st)"""


@query("m8_derive_state", "SELECT state_id, event_id, state_key, state_value, state_type FROM st", _STATE)
def m8(t):
    return mz.states(t.ev).select("state_id", "event_id", "state_key", "state_value", "state_type")


@query("m9_state_versions", "SELECT state_id, event_id, CAST(version AS BIGINT) AS version, valid_from, valid_to FROM sv", _STATE)
def m9(t):
    twice = t.ev.unionByName(t.ev.withColumn("lsn", F.col("lsn") + 10_000_000))  # a replayed log changes nothing
    return mz.state_versions(mz.states(twice)).select("state_id", "event_id", "version", "valid_from", "valid_to")


@query("m10_derive_artifact", "SELECT 'art_' || event_id AS artifact_id, event_id, event_type AS artifact_type, 'text/plain' AS mime_type FROM ev WHERE event_type IN ('tool_call', 'tool_result')")
def m10(t):
    return mz.artifacts(t.ev).select("artifact_id", "event_id", "artifact_type", "mime_type")


@query("m11_tool_trace", "SELECT 'tool_trace_' || event_id AS artifact_id, event_id, 'tool_trace' AS artifact_type, text AS body FROM ev WHERE event_type IN ('tool_call', 'tool_result')")
def m11(t):
    return mz.tool_traces(t.ev).select("artifact_id", "event_id", "artifact_type", "body")


@query("m13_canonical_access", f"SELECT event_id, tenant_id, workspace_id, agent_id AS owner, {_VIS} AS visibility FROM ev")
def m13(t):
    return t.ev.select("event_id", "tenant_id", "workspace_id", F.col("agent_id").alias("owner"), mz.default_visibility(F.col("visibility"), F.col("session_id"), F.col("workspace_id"), F.col("agent_id")).alias("visibility"))


_FRAG = r"""fr AS (
  SELECT *, list_filter(list_transform(list_filter(regexp_split_to_array(lower(trim(content)), '\s+'), lambda w: w <> ''), lambda w: trim(w, '.,!?;:')), lambda w: w <> '') AS words FROM doc
), ft AS (SELECT *, list_transform(list_sort(list_transform(list_distinct(words), lambda w: {'p': list_position(words, w), 'w': w})), lambda s: s.w) AS tokens FROM fr)"""


@query("m14_evidence_fragment", "SELECT memory_id, CAST(len(tokens) AS BIGINT) AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM ft", _FRAG)
def m14(t):
    tokens = mz.fragment_tokens(F.col("content"))
    return t.doc.select("memory_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("tokens_md5"))


@query("m15_salience", "SELECT event_id, round(least(CASE WHEN importance = 0 THEN 0.5 ELSE importance END + CASE WHEN len(causal_refs) > 0 THEN 0.1 ELSE 0 END, 1.0), 6) AS salience FROM ev")
def m15(t):
    return t.ev.select("event_id", F.round(mz.salience(F.col("importance"), mz.fragment_tokens(F.col("text")), F.col("causal_refs"), F.col("visibility")), 6).alias("salience"))


@query("m17_graph_node", "SELECT memory_id AS node_id, 'mem:' || memory_id AS join_key, summary AS label, agent_id AS agent, session_id AS session FROM memory")
def m17(t):
    return mz.graph_nodes(t.memory).select("node_id", "join_key", "label", F.col("properties")["agent"].alias("agent"), F.col("properties")["session"].alias("session"))


@query("f13_infer_object_type", "SELECT id, CASE WHEN starts_with(id, 'mem_') THEN 'memory' WHEN starts_with(id, 'evt_') THEN 'event' WHEN starts_with(id, 'state_') THEN 'agent_state' WHEN starts_with(id, 'art_') THEN 'artifact' WHEN starts_with(id, 'edge_') THEN 'edge' ELSE 'memory' END AS kind FROM (SELECT memory_id AS id FROM memory UNION ALL SELECT event_id FROM ev UNION ALL SELECT edge_id FROM edge UNION ALL SELECT agent_id FROM agent)")
def f13(t):
    ids = t.memory.select(F.col("memory_id").alias("id")).unionByName(t.ev.select(F.col("event_id").alias("id"))).unionByName(t.edge.select(F.col("edge_id").alias("id"))).unionByName(t.agent.select(F.col("agent_id").alias("id")))
    return ids.select("id", object_type(F.col("id")).alias("kind"))


@query("x18_fill_defaults", "SELECT memory_id, coalesce(valid_to, TIMESTAMP '2025-01-01 00:00:00') AS valid_to FROM memory")
def x18(t):
    from datetime import datetime

    return t.memory.select("memory_id", "valid_to").withColumn("valid_to", F.coalesce("valid_to", F.lit(datetime(2025, 1, 1)).cast("timestamp_ntz")))


