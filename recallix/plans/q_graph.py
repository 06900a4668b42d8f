"""Queries over graphs, traces, communities and evidence (G, E, and the searches that walk a graph)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import object_type
from ..operators import graph
from .planner import QueryRequest, plan
from .registry import query

_SEED = "SELECT memory_id FROM memory WHERE agent_id = 'agent_11'"


def _seeds(t):
    return t.memory.where("agent_id = 'agent_11'").select(F.col("memory_id").alias("id"))


def _bfs(hops: int, where: str, both: bool) -> str:
    step = "SELECT edge_id, src, dst FROM edge WHERE " + where
    if both:
        step += " UNION ALL SELECT edge_id, dst, src FROM edge WHERE " + where
    return f"eb AS ({step}), walk AS (SELECT memory_id AS id, 0 AS d FROM ({_SEED}) UNION SELECT eb.dst, d + 1 FROM walk JOIN eb ON walk.id = eb.src WHERE d < {hops}), node AS (SELECT id, min(d) AS d FROM walk GROUP BY id)"


_DEPTH = "SELECT edge_id, min(d) + 1 AS depth FROM node JOIN eb ON node.id = eb.src WHERE d < {} GROUP BY edge_id"


@query("g1_assemble_trace", _DEPTH.format(8), _bfs(8, "true", False))
def g1(t):
    return graph.trace(_seeds(t), t.edge, 8)


@query("g2_expand_subgraph", _DEPTH.format(1), _bfs(1, "true", True))
def g2(t):
    return graph.trace(_seeds(t), t.edge, 1, directed=False)


@query("g3_subgraph_plan", _DEPTH.format(2), _bfs(2, "weight >= 0.5", True))
def g3(t):
    docs = t.memory.select("memory_id", "agent_id")
    return plan(QueryRequest(agent_id="agent_11", mode="subgraph", max_hops=2, min_weight=0.5), docs, t.edge)


@query("g4_multi_hop_plan", _DEPTH.format(4), _bfs(4, "edge_type = 'projected_from'", True))
def g4(t):
    docs = t.memory.select("memory_id", "agent_id")
    return plan(QueryRequest(agent_id="agent_11", mode="multi_hop", max_hops=4, edge_types=("projected_from",)), docs, t.edge)


_CHAIN = "ch AS (SELECT src, dst FROM edge WHERE edge_type = 'derived_from' AND weight > 0.2), cw AS (SELECT src AS node, dst AS other FROM ch UNION ALL SELECT dst, src FROM ch), cc AS (SELECT node, node AS o FROM cw UNION SELECT cc.node, cw.other FROM cc JOIN cw ON cc.o = cw.node)"


@query("g5_communities", "SELECT node, min(o) AS community FROM cc GROUP BY node", _CHAIN)
def g5(t):
    return graph.communities(t.edge.where("edge_type = 'derived_from' and weight > 0.2"))


_ENT = r"""ep AS (SELECT 'conv_' || conv_id || '_' || turn AS episode_id, text, 'agent_' || conv_id AS owner, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS valid_at FROM conversations),
en AS (SELECT *, list_sort(list_distinct(list_transform(list_append(regexp_extract_all(text, '\b[A-Z][A-Za-z0-9_]+\b'), owner), lambda w: 'ent_' || lower(w)))) AS entities FROM ep)"""


def _episodes(t):
    c = t.conversations.select(F.concat(F.lit("conv_"), "conv_id", F.lit("_"), "turn").alias("episode_id"), "text", F.concat(F.lit("agent_"), "conv_id").alias("owner"), (F.expr("timestamp_ntz '2024-01-01 00:00:00'") + F.make_dt_interval(F.col("conv_id").cast("int"), F.lit(0), F.col("turn").cast("int"))).alias("valid_at"))
    return c.withColumns({"entities": graph.entities(F.col("text"), F.col("owner")), "predicate": graph.predicate(F.col("text"))})


@query("g6_extract_entities", "SELECT episode_id, array_to_string(entities, ',') AS entities FROM en", _ENT)
def g6(t):
    return _episodes(t).select("episode_id", F.array_join("entities", ",").alias("entities"))


@query("g7_extract_facts", "SELECT episode_id, a.e AS src, b.e AS dst FROM (SELECT episode_id, unnest(entities) AS e FROM en) a JOIN (SELECT episode_id, unnest(entities) AS e FROM en) b USING (episode_id) WHERE a.e < b.e", _ENT)
def g7(t):
    return graph.facts(_episodes(t)).select("episode_id", "src", "dst")


@query("g8_infer_predicate", "SELECT conv_id, turn, CASE WHEN contains(lower(text), ' not ') OR contains(lower(text), ' no ') THEN 'NEGATES' WHEN contains(lower(text), ' works ') OR contains(lower(text), 'work at') THEN 'WORKS_WITH' WHEN contains(lower(text), ' likes ') OR contains(lower(text), 'love') THEN 'PREFERS' ELSE 'RELATED_TO' END AS predicate FROM conversations")
def g8(t):
    return t.conversations.select("conv_id", "turn", graph.predicate(F.col("text")).alias("predicate"))


_FACT = "fa AS (SELECT event_id AS episode_id, agent_id AS src, workspace_id AS dst, CASE WHEN k % 5 = 0 THEN 'NEGATES' ELSE 'RELATED_TO' END AS predicate, ts AS valid_at FROM ev)"


@query("g9_invalidate_contradictions", "SELECT episode_id, CASE WHEN predicate = 'NEGATES' THEN min(valid_at) FILTER (predicate <> 'NEGATES') OVER w ELSE min(valid_at) FILTER (predicate = 'NEGATES') OVER w END AS invalid_at FROM fa WINDOW w AS (PARTITION BY src, dst ORDER BY valid_at, episode_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)", _FACT)
def g9(t):
    fact = t.ev.select(F.col("event_id").alias("episode_id"), F.col("agent_id").alias("src"), F.col("workspace_id").alias("dst"), F.when(F.col("k") % 5 == 0, "NEGATES").otherwise("RELATED_TO").alias("predicate"), F.col("ts").alias("valid_at"))
    return graph.close_contradicted(fact).select("episode_id", "invalid_at")


@query("g10_temporal_range", "SELECT event_id, CASE WHEN k % 2 = 0 THEN ts - to_days(CAST(k AS INTEGER)) ELSE ts END AS valid_from FROM ev")
def g10(t):
    text = F.when(F.col("k") % 2 == 0, F.concat(F.lit("Seen "), "k", F.lit(" days ago"))).otherwise("Seen today")
    return t.ev.select("event_id", graph.temporal_start(text, F.col("ts")).alias("valid_from"))


_STEPS = """stp AS (SELECT memory_id AS object_id, 1 AS place, 'canonical' AS step, memory_type AS detail FROM memory UNION ALL SELECT src, 2, 'edge', edge_id FROM edge UNION ALL SELECT object_id, 3, 'quarantined', policy_event_id FROM policy WHERE quarantine_flag UNION ALL SELECT object_id, 4, 'retracted', policy_event_id FROM policy WHERE verified_state = 'retracted')"""


def _steps(t):
    step = lambda df, oid, place, name, detail: df.select(F.col(oid).alias("object_id"), F.lit(place).cast("long").alias("place"), F.lit(name).alias("step"), F.col(detail).alias("detail"))
    return step(t.memory, "memory_id", 1, "canonical", "memory_type").unionByName(step(t.edge, "src", 2, "edge", "edge_id")).unionByName(step(t.policy.where("quarantine_flag"), "object_id", 3, "quarantined", "policy_event_id")).unionByName(step(t.policy.where("verified_state = 'retracted'"), "object_id", 4, "retracted", "policy_event_id"))


@query("g11_object_traces", "SELECT object_id, CAST(place AS BIGINT) AS place, step, detail FROM stp WHERE object_id = 'mem_evt_48'", _STEPS)
def g11(t):
    return _steps(t).where("object_id = 'mem_evt_48'")


@query("e1_build_evidence", "SELECT object_id, count(*) AS n_steps, md5(string_agg(step || ':' || detail, ',' ORDER BY place, detail)) AS proof_md5 FROM stp GROUP BY object_id", _STEPS)
def e1(t):
    proof = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "detail", "step"))), lambda s: F.concat(s["step"], F.lit(":"), s["detail"])), ",")
    return _steps(t).groupBy("object_id").agg(F.count(F.lit(1)).alias("n_steps"), F.md5(proof).alias("proof_md5"))


@query("e2_governance_annotations", "SELECT object_id, step, detail FROM stp WHERE place >= 3", _STEPS)
def e2(t):
    return _steps(t).where("place >= 3").select("object_id", "step", "detail")


@query("e3_resolve_versions", "SELECT object_id, max(seq) AS version, arg_max(policy_event_id, seq) AS mutation FROM policy GROUP BY object_id")
def e3(t):
    return t.policy.groupBy("object_id").agg(F.max("seq").alias("version"), F.max_by("policy_event_id", "seq").alias("mutation"))


@query("e4_fragment_steps", "SELECT event_id, CAST(i AS BIGINT) AS place, related[i + 1] AS related FROM (SELECT event_id, list_concat([agent_id, session_id], causal_refs) AS related, unnest(range(0, 2 + len(causal_refs))) AS i FROM ev)")
def e4(t):
    return t.ev.select("event_id", F.posexplode(F.concat(F.array("agent_id", "session_id"), "causal_refs")).alias("place", "related")).select("event_id", F.col("place").cast("long").alias("place"), "related")


@query("e6_query_outcome", "SELECT session_id, CASE WHEN count(*) FILTER (is_active) > 0 THEN 'ok' WHEN count(*) > 0 THEN 'supplemented' ELSE 'no_retrieval_hits' END AS status FROM memory GROUP BY session_id")
def e6(t):
    return t.memory.groupBy("session_id").agg(F.when(F.sum(F.col("is_active").cast("long")) > 0, "ok").when(F.count(F.lit(1)) > 0, "supplemented").otherwise("no_retrieval_hits").alias("status"))


@query("e7_query_chain", "SELECT DISTINCT id, CASE WHEN starts_with(id, 'mem_') THEN 'memory' WHEN starts_with(id, 'evt_') THEN 'event' ELSE 'memory' END AS kind FROM (SELECT memory_id AS id FROM (" + _SEED + ") UNION ALL SELECT src FROM edge WHERE src IN (" + _SEED + ") OR dst IN (" + _SEED + ") UNION ALL SELECT dst FROM edge WHERE src IN (" + _SEED + ") OR dst IN (" + _SEED + "))")
def e7(t):
    s = _seeds(t)
    return graph.touched_nodes(s, graph.expand_one_hop(s, t.edge)).select("id", object_type(F.col("id")).alias("kind"))


@query("e8_fragment_cache", "SELECT count(*) AS asked, count(m.memory_id) AS hits, count(*) - count(m.memory_id) AS misses FROM edge e LEFT JOIN (SELECT memory_id FROM memory WHERE importance > 0.5) m ON e.dst = m.memory_id")
def e8(t):
    cached = t.memory.where("importance > 0.5").select("memory_id")
    return t.edge.join(cached, F.col("dst") == F.col("memory_id"), "left").agg(F.count(F.lit(1)).alias("asked"), F.count("memory_id").alias("hits"), F.sum(F.col("memory_id").isNull().cast("long")).alias("misses"))


_NB = "nb AS (SELECT src AS id, dst AS other FROM edge UNION SELECT dst, src FROM edge), w AS (SELECT memory_id AS id, 0 AS d FROM (" + _SEED + ") UNION SELECT nb.other, d + 1 FROM w JOIN nb ON w.id = nb.id WHERE d < 2)"


@query("r32_bfs_search", "SELECT id, round(max(1.0::DOUBLE / (d + 1)), 6) AS score FROM w GROUP BY id", _NB)
def r32(t):
    both = t.edge.select("edge_id", "src", "dst", F.lit(1.0).alias("weight"), "edge_type")
    seeds = _seeds(t)
    steps = graph.trace(seeds, both, 2, directed=False)
    ends = steps.join(both, "edge_id").select("depth", F.explode(F.array("src", "dst")).alias("id"))
    reached = ends.groupBy("id").agg(F.min("depth").alias("depth")).join(seeds, "id", "left_anti")
    # An edge's depth is that of the hop that used it; a node's is the smallest of its edges'.
    return reached.select("id", F.round(1.0 / (F.col("depth") + 1), 6).alias("score")).unionByName(seeds.select("id", F.lit(1.0).alias("score")).distinct())


@query("r36_node_distance", "SELECT id, round(1.0::DOUBLE / (min(d) + 1), 6) AS boost FROM w GROUP BY id", _NB)
def r36(t):
    return r32(t).withColumnRenamed("score", "boost")
