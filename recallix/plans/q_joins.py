"""Queries over joins (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..operators import materialize as mz
from ..operators import memory_algorithms as ma
from ..operators.retrieval import top_k_per
from .fixtures import NOW
from .q_filters import now
from .q_objects import _STATE
from .registry import query

_NOW = f"TIMESTAMP '{NOW}'"


@query("j1_enrich_candidates", "SELECT e.event_id, m.memory_id, m.importance, m.confidence FROM ev e LEFT JOIN memory m ON m.memory_id = 'mem_' || e.parent_event_id")
def j1(t):
    right = t.memory.select("memory_id", "importance", "confidence")
    return t.ev.select("event_id", F.concat(F.lit("mem_"), "parent_event_id").alias("ref")).join(right, F.col("ref") == F.col("memory_id"), "left").select("event_id", "memory_id", "importance", "confidence")


_SEED = "SELECT memory_id FROM memory WHERE agent_id = 'agent_9'"


def _seeds(t):
    return t.memory.where("agent_id = 'agent_9'").select(F.col("memory_id").alias("id"))


@query("j2_one_hop_expand", f"SELECT DISTINCT edge_id FROM edge WHERE edge_type = 'projected_from' AND (src IN ({_SEED}) OR dst IN ({_SEED}))")
def j2(t):
    return graph.expand_one_hop(_seeds(t), t.edge, ["projected_from"]).select("edge_id")


@query("j3_expand_request", f"SELECT DISTINCT id FROM (SELECT memory_id AS id FROM ({_SEED}) UNION ALL SELECT src FROM hit UNION ALL SELECT dst FROM hit)", f"hit AS (SELECT * FROM edge WHERE src IN ({_SEED}) OR dst IN ({_SEED}))")
def j3(t):
    s = _seeds(t)
    return graph.touched_nodes(s, graph.expand_one_hop(s, t.edge))


@query("j4_tool_state", "SELECT c.event_id AS call_id, r.event_id AS result_id, CASE WHEN r.event_id IS NULL THEN 'pending' ELSE 'completed' END AS status FROM ev c LEFT JOIN (SELECT *, CASE WHEN parent_event_id <> '' THEN parent_event_id ELSE coalesce(causal_refs[1], '') END AS ref FROM ev WHERE event_type = 'tool_result') r ON r.ref = c.event_id WHERE c.event_type = 'tool_call'")
def j4(t):
    ref = F.when(F.col("parent_event_id") != "", F.col("parent_event_id")).otherwise(F.coalesce(F.get("causal_refs", F.lit(0)), F.lit("")))
    calls = t.ev.where("event_type = 'tool_call'").select(F.col("event_id").alias("call_id"))
    results = t.ev.where("event_type = 'tool_result'").select(F.col("event_id").alias("result_id"), ref.alias("ref"))
    return calls.join(results, F.col("call_id") == F.col("ref"), "left").select("call_id", "result_id", F.when(F.col("result_id").isNull(), "pending").otherwise("completed").alias("status"))


_OVER = f"a.valid_from <= coalesce(b.valid_to, {_NOW}) AND b.valid_from <= coalesce(a.valid_to, {_NOW})"
CONFLICT = f"""cf AS (
  SELECT * FROM (SELECT a.agent_id, a.memory_id AS left_id, b.memory_id AS right_id,
    CASE WHEN a.memory_type = b.memory_type AND lower(trim(a.content)) <> lower(trim(b.content)) AND {_OVER} THEN 'value'
         WHEN a.memory_type = 'factual' AND a.confidence >= 0.9 AND lower(trim(a.content)) <> lower(trim(b.content)) AND NOT ({_OVER}) THEN 'factual'
         WHEN list_has_any(a.source_event_ids, b.source_event_ids) AND abs(a.confidence - b.confidence) > 0.3 THEN 'entity' END AS rule
  FROM memory a JOIN memory b ON a.agent_id = b.agent_id AND a.lsn < b.lsn) WHERE rule IS NOT NULL
), cs AS (SELECT *, CASE rule WHEN 'value' THEN 0.8::DOUBLE WHEN 'factual' THEN 0.75 ELSE 0.6 END AS severity FROM cf)"""


@query("j5_detect_conflicts", "SELECT left_id, right_id, rule, severity FROM cs", CONFLICT)
def j5(t):
    return ma.conflicts(t.memory, now())


@query("j6_time_overlap", f"SELECT a.memory_id AS a_id, b.memory_id AS b_id, {_OVER} AS meets FROM memory a JOIN memory b ON a.session_id = b.session_id AND a.lsn < b.lsn")
def j6(t):
    a = t.memory.select("session_id", F.col("memory_id").alias("a_id"), F.col("lsn").alias("a_lsn"), F.col("valid_from").alias("a_from"), F.col("valid_to").alias("a_to"))
    b = t.memory.select("session_id", F.col("memory_id").alias("b_id"), F.col("lsn").alias("b_lsn"), F.col("valid_from").alias("b_from"), F.col("valid_to").alias("b_to"))
    return a.join(b, "session_id").where("a_lsn < b_lsn").select("a_id", "b_id", ma.time_overlap(F.col("a_from"), F.col("a_to"), F.col("b_from"), F.col("b_to"), now()).alias("meets"))


@query("j7_source_overlap", "SELECT DISTINCT a.memory_id AS a_id, b.memory_id AS b_id FROM (SELECT memory_id, unnest(source_event_ids) AS s FROM memory) a JOIN (SELECT memory_id, unnest(source_event_ids) AS s FROM memory) b ON a.s = b.s AND a.memory_id < b.memory_id")
def j7(t):
    x = t.memory.select("memory_id", F.explode("source_event_ids").alias("s"))
    return x.withColumnRenamed("memory_id", "a_id").join(x.withColumnRenamed("memory_id", "b_id"), "s").where("a_id < b_id").select("a_id", "b_id").distinct()


@query("j8_join_key_lookup", "SELECT e.edge_id, 'mem:' || m.memory_id AS join_key, m.memory_type FROM edge e JOIN memory m ON e.dst = m.memory_id WHERE e.edge_type = 'derived_from'")
def j8(t):
    nodes = mz.graph_nodes(t.memory).select("join_key", F.col("properties")["type"].alias("memory_type"))
    keys = t.edge.where("edge_type = 'derived_from'").select("edge_id", F.concat(F.lit("mem:"), "dst").alias("join_key"))
    return keys.join(nodes, "join_key").select("edge_id", "join_key", "memory_type")


@query("j9_agent_aggregate", "SELECT agent_id, memory_id, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY importance DESC, memory_id) AS r FROM memory WHERE visibility IN ('public', 'workspace') AND workspace_id IN (SELECT workspace_id FROM agent WHERE role = 'building')) WHERE r <= 3")
def j9(t):
    scopes = t.agent.where("role = 'building'").select("workspace_id").distinct()
    readable = t.memory.where(F.col("visibility").isin("public", "workspace")).join(scopes, "workspace_id", "left_semi")
    return top_k_per(readable, ["agent_id"], "importance", 3, "memory_id").select("agent_id", "memory_id", "rank")


@query("j10_batch_lineage", "SELECT source, memory_id, CAST(min(i) AS BIGINT) AS pos FROM (SELECT memory_id, unnest(source_event_ids) AS source, unnest(range(0, len(source_event_ids))) AS i FROM memory) GROUP BY source, memory_id")
def j10(t):
    return t.memory.select("memory_id", F.posexplode("source_event_ids").alias("i", "source")).groupBy("source", "memory_id").agg(F.min("i").cast("long").alias("pos"))


@query("j11_resolve_provenance", "SELECT DISTINCT src AS object_id, ref FROM (SELECT src, provenance_ref AS ref FROM edge UNION ALL SELECT memory_id, unnest(source_event_ids) FROM memory) WHERE trim(ref) <> ''")
def j11(t):
    refs = t.edge.select(F.col("src").alias("object_id"), F.col("provenance_ref").alias("ref")).unionByName(t.memory.select(F.col("memory_id").alias("object_id"), F.explode("source_event_ids").alias("ref")))
    return refs.where(F.trim("ref") != "").distinct()


@query("j12_latest_version", "SELECT state_id, arg_max(event_id, version) AS event_id, CAST(max(version) AS BIGINT) AS version FROM sv GROUP BY state_id", _STATE)
def j12(t):
    return mz.state_versions(mz.states(t.ev)).groupBy("state_id").agg(F.max_by("event_id", "version").alias("event_id"), F.max("version").alias("version"))


@query("j13_as_of_version", "SELECT state_id, event_id, CAST(version AS BIGINT) AS version FROM sv WHERE valid_from <= TIMESTAMP '2024-01-15 12:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15 12:00:00')", _STATE)
def j13(t):
    at = F.expr("timestamp_ntz '2024-01-15 12:00:00'")
    seen = mz.state_versions(mz.states(t.ev)).where(F.col("valid_from") <= at)
    return seen.groupBy("state_id").agg(F.max_by("event_id", "version").alias("event_id"), F.max("version").alias("version"))


@query("j14_tiered_lookup", "SELECT e.event_id, coalesce(h.memory_id, w.memory_id) AS memory_id, CASE WHEN h.memory_id IS NOT NULL THEN 'hot' WHEN w.memory_id IS NOT NULL THEN 'warm' ELSE 'cold' END AS tier FROM ev e LEFT JOIN (SELECT memory_id, event_id FROM memory WHERE importance >= 0.5) h ON h.event_id = e.event_id LEFT JOIN (SELECT memory_id, event_id FROM memory WHERE is_active) w ON w.event_id = e.event_id")
def j14(t):
    hot = t.memory.where("importance >= 0.5").select("event_id", F.col("memory_id").alias("hot_id"))
    warm = t.memory.where("is_active").select("event_id", F.col("memory_id").alias("warm_id"))
    return t.ev.select("event_id").join(hot, "event_id", "left").join(warm, "event_id", "left").select("event_id", F.coalesce("hot_id", "warm_id").alias("memory_id"), F.when(F.col("hot_id").isNotNull(), "hot").when(F.col("warm_id").isNotNull(), "warm").otherwise("cold").alias("tier"))


