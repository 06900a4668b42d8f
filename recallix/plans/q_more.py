"""Queries over the remaining computations: checkpoints, routing, sharing, views, replays, task progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as fl
from ..operators import materialize as mz
from ..operators.retrieval import tfidf, top_k, top_k_per
from .fixtures import NOW
from .q_filters import now
from .q_objects import _STATE
from .q_retrieval import _TFIDF
from .registry import query

_NOW = f"TIMESTAMP '{NOW}'"


@query("m12_checkpoint", f"SELECT state_id, arg_max(state_value, version) AS state_value, CAST(max(version) + 1 AS BIGINT) AS version, {_NOW} AS valid_from FROM sv GROUP BY state_id", _STATE)
def m12(t):
    """A snapshot version of every current state."""
    return mz.state_versions(mz.states(t.ev)).groupBy("state_id").agg(F.max_by("state_value", "version").alias("state_value"), (F.max("version") + 1).alias("version")).withColumn("valid_from", now())


@query("m16_route_object", "SELECT event_id, CASE WHEN event_type IN ('tool_call', 'tool_result') THEN 'artifact' WHEN event_type = 'state_update' THEN 'agent_state' ELSE 'memory' END AS route FROM ev")
def m16(t):
    kind = F.col("event_type")
    return t.ev.select("event_id", F.when(kind.isin("tool_call", "tool_result"), "artifact").when(kind.isin("state_update", "state_change"), "agent_state").otherwise("memory").alias("route"))


@query("m18_attributes", "SELECT event_id, agent_id AS agent, event_type AS kind, visibility FROM ev")
def m18(t):
    flat = F.create_map(F.lit("agent_id"), "agent_id", F.lit("event_type"), "event_type", F.lit("visibility"), "visibility")
    return t.ev.withColumn("a", flat).select("event_id", F.col("a")["agent_id"].alias("agent"), F.col("a")["event_type"].alias("kind"), F.col("a")["visibility"].alias("visibility"))


@query("m19_supplement_types", "SELECT memory_id AS id FROM memory WHERE agent_id = 'agent_2' UNION ALL SELECT 'art_' || event_id FROM ev WHERE agent_id = 'agent_2' AND event_type IN ('tool_call', 'tool_result') UNION ALL SELECT DISTINCT state_id FROM st WHERE state_id IN (SELECT state_id FROM st JOIN ev USING (event_id) WHERE agent_id = 'agent_2')", _STATE)
def m19(t):
    own = t.ev.where("agent_id = 'agent_2'")
    return t.memory.where("agent_id = 'agent_2'").select(F.col("memory_id").alias("id")).unionByName(mz.artifacts(own).select(F.col("artifact_id").alias("id"))).unionByName(mz.states(own).select(F.col("state_id").alias("id")).distinct())


@query("r37_structured_fetch", "SELECT memory_id, row_number() OVER (ORDER BY lsn DESC) AS place FROM (SELECT * FROM memory WHERE workspace_id = 'ws_3' AND source_file_name = 'file_2.txt' ORDER BY lsn DESC LIMIT 25)")
def r37(t):
    hit = t.memory.where(fl.equal_when_set(workspace_id="ws_3", source_file_name="file_2.txt"))
    return top_k(hit.withColumnRenamed("memory_id", "object_id"), "lsn", 25).select(F.col("object_id").alias("memory_id"), F.col("rank").alias("place"))


@query("r12_cold_exact", "SELECT query_id, object_id, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS object_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b) WHERE rank <= 3")
def r12(t):
    from ..operators.retrieval import knn

    return knn(t.embeddings, t.embeddings, 3, "cosine").select("query_id", "object_id", "rank")


@query("x1_reindex_embeddings", "SELECT memory_id, count(*) AS buckets, round(sum(w * w), 4) AS norm FROM (SELECT memory_id, round(v / sqrt(sum(v * v) OVER (PARTITION BY memory_id)), 6) AS w FROM vv) GROUP BY memory_id", _TFIDF)
def x1(t):
    return tfidf(t.doc, "memory_id", "content").groupBy(F.col("object_id").alias("memory_id")).agg(F.count(F.lit(1)).alias("buckets"), F.round(F.sum(F.col("value") * F.col("value")), 4).alias("norm"))


@query("x6_next_version", "SELECT state_id, CAST(max(version) + 1 AS BIGINT) AS next FROM sv GROUP BY state_id", _STATE)
def x6(t):
    return mz.state_versions(mz.states(t.ev)).groupBy("state_id").agg((F.max("version") + 1).alias("next"))


@query("x7_soft_expire", f"SELECT memory_id, is_active AND NOT (valid_to IS NOT NULL AND valid_to <= {_NOW}) AS is_active FROM memory")
def x7(t):
    over = F.coalesce(F.col("valid_to") <= now(), F.lit(False))
    return t.memory.select("memory_id", (F.col("is_active") & ~over).alias("is_active"))


@query("x9_task_complete", "SELECT session_id, round(epoch_us(max(ts)) / 1000.0::DOUBLE - epoch_us(min(ts)) / 1000.0::DOUBLE, 1) AS duration_ms, count(*) FILTER (event_type = 'critique_generated') = 0 AS success FROM ev GROUP BY session_id")
def x9(t):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return t.ev.groupBy("session_id").agg(F.round(F.max(us) / 1000.0 - F.min(us) / 1000.0, 1).alias("duration_ms"), (F.sum((F.col("event_type") == "critique_generated").cast("long")) == 0).alias("success"))


_HANDOFFS = """ho AS (SELECT e.lsn AS seq, p.agent_id AS from_agent, e.agent_id AS to_agent, CASE WHEN e.k % 4 = 0 THEN '' ELSE 'planner' END AS role_from, ['executor', 'critic', ''][e.k % 3 + 1] AS role_to FROM ev e JOIN ev p ON e.parent_event_id = p.event_id WHERE e.parent_event_id <> ''),
hc AS (SELECT agent_id, arg_max(given, place) AS given FROM (SELECT seq * 2 AS place, to_agent AS agent_id, role_to AS given FROM ho UNION ALL SELECT seq * 2 + 1, from_agent, role_from FROM ho) WHERE given <> '' GROUP BY agent_id)"""


@query("x10_agent_handoff", "SELECT a.agent_id, coalesce(given, a.role) AS role, coalesce(n, 0) AS handoffs FROM agent a LEFT JOIN hc ON hc.agent_id = a.agent_id LEFT JOIN (SELECT from_agent, count(*) AS n FROM ho GROUP BY from_agent) g ON g.from_agent = a.agent_id", _HANDOFFS)
def x10(t):
    """Each event that continues another one hands over from that one's agent; roles afterwards, and events by giver."""
    before = t.ev.select(F.col("event_id").alias("parent_event_id"), F.col("agent_id").alias("from_agent"))
    role_to = F.element_at(F.array(F.lit("executor"), F.lit("critic"), F.lit("")), (F.col("k") % 3 + 1).cast("int"))
    handoffs = t.ev.where("parent_event_id != ''").join(before, "parent_event_id").select(F.col("lsn").alias("seq"), "from_agent", F.col("agent_id").alias("to_agent"), "session_id", F.when(F.col("k") % 4 == 0, "").otherwise("planner").alias("role_from"), role_to.alias("role_to"))
    given = mz.handoff_events(handoffs).groupBy("agent_id").agg(F.count(F.lit(1)).alias("handoffs"))
    return mz.apply_handoffs(t.agent.select("agent_id", "role"), handoffs).join(given, "agent_id", "left").select("agent_id", "role", F.coalesce("handoffs", F.lit(0)).alias("handoffs"))


@query("x11_ground_truth", "SELECT 'task_' || conv_id AS task_id, arg_max(text, turn) AS expected FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def x11(t):
    """Answers expected of tasks, recorded one after another: the last record of a task stands."""
    records = t.conversations.where("role = 'assistant'").select(F.concat(F.lit("task_"), "conv_id").alias("task_id"), F.col("text").alias("expected"), "turn")
    return records.where("task_id != ''").groupBy("task_id").agg(F.max_by("expected", "turn").alias("expected"))


@query("x12_conflict_inject", "SELECT 'edge_' || a || '_conflict_' || b AS edge_id, a AS src, b AS dst FROM (SELECT agent_id, min(memory_id) AS a, max(memory_id) AS b FROM memory GROUP BY agent_id) WHERE a <> b")
def x12(t):
    ends = t.memory.groupBy("agent_id").agg(F.min("memory_id").alias("src"), F.max("memory_id").alias("dst")).where("src != dst")
    return ends.select(F.concat(F.lit("edge_"), "src", F.lit("_conflict_"), "dst").alias("edge_id"), "src", "dst")


@query("x13_memory_view", "SELECT agent_id, count(*) AS seen, count(*) FILTER (visibility IN ('public', 'workspace')) AS in_scope, count(*) FILTER (visibility IN ('public', 'workspace') AND lifecycle_state NOT IN ('quarantined', 'hidden', 'deleted_logically')) AS allowed FROM memory GROUP BY agent_id")
def x13(t):
    scope = F.col("visibility").isin("public", "workspace")
    allowed = scope & ~F.col("lifecycle_state").isin("quarantined", "hidden", "deleted_logically")
    return t.memory.groupBy("agent_id").agg(F.count(F.lit(1)).alias("seen"), F.sum(scope.cast("long")).alias("in_scope"), F.sum(allowed.cast("long")).alias("allowed"))


@query("x14_replay_apply", "SELECT count(*) FILTER (r = 1 AND k % 40 <> 0) AS applied, count(*) FILTER (r > 1) AS duplicate, count(*) FILTER (r = 1 AND k % 40 = 0) AS failed FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY x) AS r FROM (SELECT *, 0 AS x FROM ev WHERE lsn >= 5000 UNION ALL SELECT *, 1 FROM ev WHERE lsn >= 9000))")
def x14(t):
    again = t.ev.where("lsn >= 5000").unionByName(t.ev.where("lsn >= 9000"))
    once = again.groupBy("event_id").agg(F.count(F.lit(1)).alias("c"), F.first("k").alias("k"))
    bad = F.col("k") % 40 == 0
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return once.agg(total((~bad).cast("long")).alias("applied"), total(F.col("c") - 1).alias("duplicate"), total(bad.cast("long")).alias("failed"))


@query("x17_validate", "SELECT vec_id, len(embedding) = 64 AS right_size, len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AS finite FROM embeddings")
def x17(t):
    bad = F.filter("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return t.embeddings.select("vec_id", (F.size("embedding") == 64).alias("right_size"), (F.size(bad) == 0).alias("finite"))


@query("b18_merge_profile", "SELECT coalesce(a.agent_id, b.agent_id) AS agent_id, coalesce(a.key, b.key) AS key, CASE WHEN a.s IS NULL THEN b.s WHEN b.s IS NULL THEN a.s ELSE (a.s + b.s) / 2.0 END AS strength FROM (SELECT agent_id, memory_type AS key, round(max(importance), 6) AS s FROM memory WHERE level < 2 GROUP BY ALL) a FULL JOIN (SELECT agent_id, memory_type AS key, round(max(importance), 6) AS s FROM memory WHERE level >= 2 GROUP BY ALL) b ON a.agent_id = b.agent_id AND a.key = b.key")
def b18(t):
    side = lambda cond: t.memory.where(cond).groupBy("agent_id", "memory_type").agg(F.round(F.max("importance"), 6).alias("s")).groupBy("agent_id").agg(F.map_from_entries(F.collect_list(F.struct("memory_type", "s"))).alias("m"))
    none = F.create_map().cast("map<string,double>")
    both = side("level < 2").withColumnRenamed("m", "a").join(side("level >= 2").withColumnRenamed("m", "b"), "agent_id", "full")
    merged = F.map_zip_with(F.coalesce("a", none), F.coalesce("b", none), lambda k, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise((x + y) / 2.0))
    return both.select("agent_id", F.explode(merged).alias("key", "strength"))


@query("b22_broadcast", "SELECT 'shared_' || memory_id || '_agent_1' AS memory_id, 'agent_1' AS agent_id, 'restricted_shared' AS visibility FROM memory WHERE agent_id = 'agent_4' AND is_active")
def b22(t):
    own = t.memory.where("agent_id = 'agent_4' and is_active")
    return own.select(F.concat(F.lit("shared_"), "memory_id", F.lit("_agent_1")).alias("memory_id"), F.lit("agent_1").alias("agent_id"), F.lit("restricted_shared").alias("visibility"))


def _in_lists(agents: str, roles: str, acl: str, agent: str, role: str) -> str:
    tokens = f"regexp_split_to_array({acl}, '[,; \\t\\n]')"
    return f"(list_contains({agents}, '*') OR list_contains({agents}, {agent}) OR coalesce(list_contains({roles}, {role}), false) OR list_contains({tokens}, '*') OR list_contains({tokens}, {agent}) OR list_contains({tokens}, 'agent:' || {agent}) OR coalesce(list_contains({tokens}, 'role:' || {role}), false))"


_SHARES = f"""ct AS (SELECT *, CAST(substr(contract_id, 10) AS BIGINT) AS c FROM contract),
ask AS (SELECT memory_id, agent_id AS owner, workspace_id, CASE WHEN n % 6 = 0 THEN 'agent_0' ELSE agent_id END AS from_agent, CASE WHEN n % 11 = 0 THEN agent_id ELSE 'agent_' || (n * 7 % 150) END AS to_agent, CASE WHEN n % 4 = 0 THEN '' ELSE 'contract_' || (n % 27) END AS asked FROM memory),
sh AS (SELECT a.*, CASE WHEN owner <> '' AND owner <> from_agent THEN 'not_owner' WHEN from_agent = to_agent THEN 'no_op' WHEN asked = '' THEN 'shared' WHEN contract_id IS NULL THEN 'contract_not_found' WHEN ct.workspace_id <> '' AND ct.workspace_id <> a.workspace_id THEN 'other_scope'
  WHEN NOT {_in_lists("['agent_' || (c + 1)]", "[CASE WHEN c % 4 < 2 THEN 'building' ELSE 'household' END]", "CASE WHEN c % 3 = 1 THEN '*' ELSE '' END", "from_agent", "f.role")} THEN 'derive_denied'
  WHEN NOT {_in_lists("read_agents", "read_roles", "read_acl", "to_agent", "g.role")} THEN 'read_denied' ELSE 'shared' END AS outcome
  FROM ask a LEFT JOIN ct ON asked = contract_id LEFT JOIN agent f ON f.agent_id = from_agent LEFT JOIN agent g ON g.agent_id = to_agent)"""


@query("b23_share_with_contract", "SELECT memory_id, to_agent, outcome, CASE WHEN outcome = 'shared' THEN 'shared_' || memory_id || '_to_' || to_agent END AS shared_id FROM sh", _SHARES)
def b23(t):
    """One request for each memory, some without a contract, with an unknown one, by another agent, or to the owner."""
    n, c = F.col("n"), F.substring("contract_id", 10, 20).cast("long")
    requests = t.memory.select(
        "memory_id", F.col("agent_id").alias("owner"), "workspace_id", F.when(n % 6 == 0, "agent_0").otherwise(F.col("agent_id")).alias("from_agent"),
        F.when(n % 11 == 0, F.col("agent_id")).otherwise(F.concat(F.lit("agent_"), n * 7 % 150)).alias("to_agent"), F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("contract_"), n % 27)).alias("contract_id"),
    )
    derive = {"derive_agents": F.array(F.concat(F.lit("agent_"), c + 1)), "derive_roles": F.array(F.when(c % 4 < 2, "building").otherwise("household")), "derive_acl": F.when(c % 3 == 1, "*").otherwise("")}
    return fl.share_requests(requests, t.contract.withColumns(derive), t.agent).select("memory_id", "to_agent", "outcome", "shared_id")


@query("b25_extract", "SELECT memory_id, 0 AS level, memory_type, md5(content) AS content_md5 FROM memory")
def b25(t):
    return t.ev.select(F.concat(F.lit("mem_"), "event_id").alias("memory_id"), F.lit(0).alias("level"), mz.memory_type(F.col("payload_memory_type"), F.col("event_type")).alias("memory_type"), F.md5("text").alias("content_md5"))


@query("b26_dispatch_recall", "SELECT agent_id, memory_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY round(confidence * importance + 1e-9, 6) DESC, memory_id) AS r FROM memory WHERE is_active) WHERE r <= 5")
def b26(t):
    scored = t.memory.where("is_active").withColumn("score", F.round(F.col("confidence") * F.col("importance") + 1e-9, 6))
    return top_k_per(scored, ["agent_id"], "score", 5, "memory_id").select("agent_id", "memory_id", "rank")
