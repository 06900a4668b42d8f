"""Projection of log events into memories, states, artifacts, edges, versions and evidence fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import fields, state_id

EDGE_COLUMNS = ("edge_id", "src", "src_type", "edge_type", "dst", "dst_type", "weight", "provenance_ref")


def memory_type(declared: Column, event_type: Column) -> Column:
    """The payload's type if it declares one, else by the event's type."""
    by_event = F.when(event_type.isin("user_message", "assistant_message"), "episodic").when(event_type.isin("critique_generated", "reflection"), "reflective").when(event_type == "plan_updated", "procedural").when(event_type == "tool_result_returned", "factual").otherwise("episodic")
    return F.when(F.trim(declared) != "", F.trim(declared)).otherwise(by_event)


def default_visibility(declared: Column, session: Column, workspace: Column, agent: Column) -> Column:
    """The declared visibility, else the narrowest scope that the event has."""
    return F.when(F.trim(declared) != "", F.trim(declared)).when(session != "", "session").when(workspace != "", "workspace").when(agent != "", "private").otherwise("public")


def normalise(ev: DataFrame) -> DataFrame:
    """Defaults filled, visibility resolved, payload size and digest added. Null strings count as empty."""
    text = F.coalesce("text", F.lit(""))
    return ev.withColumns({"visibility": default_visibility(F.coalesce("visibility", F.lit("")), F.coalesce("session_id", F.lit("")), F.coalesce("workspace_id", F.lit("")), F.coalesce("agent_id", F.lit(""))), "importance": F.coalesce("importance", F.lit(0.5)), "payload_bytes": F.octet_length(text).cast("long"), "payload_hash": F.sha2(text, 256)})


def _edge(df: DataFrame, edge_id: Column, src: Column, src_type: str, kind: str, dst: Column, dst_type: str, weight: float, ref: Column) -> DataFrame:
    return df.select(edge_id.alias("edge_id"), src.alias("src"), F.lit(src_type).alias("src_type"), F.lit(kind).alias("edge_type"), dst.alias("dst"), F.lit(dst_type).alias("dst_type"), F.lit(weight).alias("weight"), ref.alias("provenance_ref"))


def _typed(prefix: str, src: Column, kind: str, dst: Column) -> Column:
    return F.concat(F.lit(prefix), src, F.lit(f"_{kind}_"), dst)


def _links(df: DataFrame, links: Column, ref: Column) -> DataFrame:
    """Edges from an array of structs of EDGE_COLUMNS without the reference: one pass over the input."""
    return df.select(F.explode(F.filter(links, lambda x: x.isNotNull())).alias("x"), ref.alias("provenance_ref")).select("x.*", "provenance_ref")


def _link(edge_id: Column, src: Column, src_type: str, kind: str, dst: Column, dst_type: str, weight: float) -> Column:
    return F.struct(edge_id.alias("edge_id"), src.alias("src"), F.lit(src_type).alias("src_type"), F.lit(kind).alias("edge_type"), dst.alias("dst"), F.lit(dst_type).alias("dst_type"), F.lit(weight).alias("weight"))


def derived_edges(ev: DataFrame) -> DataFrame:
    """Edges that an event's materialization adds: to its event, session, agent and causal references."""
    m, e = F.concat(F.lit("mem_"), "event_id"), F.col("event_id")
    fixed = F.array(
        _link(F.concat(F.lit("edge_"), m, F.lit("_event")), m, "memory", "caused_by", e, "event", 1.0),
        F.when(F.col("session_id") != "", _link(_typed("edge_", m, "belongs_to_session", F.col("session_id")), m, "memory", "belongs_to_session", F.col("session_id"), "session", 1.0)),
        F.when(F.col("agent_id") != "", _link(_typed("edge_", m, "owned_by_agent", F.col("agent_id")), m, "memory", "owned_by_agent", F.col("agent_id"), "agent", 1.0)),
    )
    causal = F.transform("causal_refs", lambda r, i: _link(F.concat(F.lit("edge_"), m, F.lit("_causal_"), i), m, "memory", "derived_from", r, "event", 0.8))
    return _links(ev, F.concat(fixed, causal), e)


def memory_base_edges(memory: DataFrame) -> DataFrame:
    m = F.col("memory_id")
    fixed = F.array(
        F.when(F.col("session_id") != "", _link(_typed("edge_", m, "belongs_to_session", F.col("session_id")), m, "memory", "belongs_to_session", F.col("session_id"), "session", 1.0)),
        F.when(F.col("agent_id") != "", _link(_typed("edge_", m, "owned_by_agent", F.col("agent_id")), m, "memory", "owned_by_agent", F.col("agent_id"), "agent", 1.0)),
    )
    sources = F.transform(F.filter("source_event_ids", lambda x: x != ""), lambda x: _link(_typed("edge_", m, "derived_from", x), m, "memory", "derived_from", x, "event", 1.0))
    return _links(memory, F.concat(fixed, sources), F.col("event_id"))


def event_base_edges(ev: DataFrame) -> DataFrame:
    e = F.col("event_id")
    fixed = F.array(
        F.when(F.col("session_id") != "", _link(_typed("edge_", e, "belongs_to_session", F.col("session_id")), e, "event", "belongs_to_session", F.col("session_id"), "session", 1.0)),
        F.when(F.col("agent_id") != "", _link(_typed("edge_", e, "owned_by_agent", F.col("agent_id")), e, "event", "owned_by_agent", F.col("agent_id"), "agent", 1.0)),
        F.when(F.col("parent_event_id") != "", _link(_typed("edge_", e, "caused_by", F.col("parent_event_id")), e, "event", "caused_by", F.col("parent_event_id"), "event", 0.8)),
    )
    refs = F.transform(F.filter("causal_refs", lambda x: x != ""), lambda x: _link(_typed("edge_", e, "caused_by", x), e, "event", "caused_by", x, "event", 0.8))
    return _links(ev, F.concat(fixed, refs), F.lit("")).drop("provenance_ref")


def artifact_base_edges(artifact: DataFrame) -> DataFrame:
    a = F.col("artifact_id")
    links = F.array(
        F.when(F.col("session_id") != "", _link(_typed("edge_", a, "belongs_to_session", F.col("session_id")), a, "artifact", "belongs_to_session", F.col("session_id"), "session", 1.0)),
        F.when(F.col("agent_id") != "", _link(_typed("edge_", a, "owned_by_agent", F.col("agent_id")), a, "artifact", "owned_by_agent", F.col("agent_id"), "agent", 1.0)),
        F.when(F.col("event_id") != "", _link(_typed("edge_", a, "tool_produces", F.col("event_id")), a, "artifact", "tool_produces", F.col("event_id"), "event", 1.0)),
    )
    return _links(artifact, links, F.lit("")).drop("provenance_ref")


def states(ev: DataFrame) -> DataFrame:
    """One state change for each event: its own key and value for state events, else the session's checkpoint."""
    own = F.col("event_type").isin("state_update", "state_change")
    key = F.when(own, F.lit("value")).otherwise("last_memory_id")
    value = F.when(own, F.col("k").cast("string")).otherwise(F.concat(F.lit("mem_"), "event_id"))
    sid = state_id(F.col("tenant_id"), F.col("workspace_id"), F.col("agent_id"), F.col("session_id"), key)
    return ev.select("event_id", "lsn", "ts", "agent_id", "session_id", key.alias("state_key"), value.alias("state_value"), F.when(own, F.col("event_type")).otherwise("ingest_checkpoint").alias("state_type"), sid.alias("state_id"))


def state_versions(changes: DataFrame) -> DataFrame:
    """Version chain of each state: numbers from 1 in order of lsn, each valid until the next one starts. A change is
    counted once however often its event is replayed: the first lsn of an event id holds."""
    once = changes.withColumn("_turn", F.row_number().over(W.partitionBy("event_id", "state_id").orderBy("lsn"))).where("_turn = 1").drop("_turn")
    chain = W.partitionBy("state_id").orderBy("lsn")
    return once.withColumns({"version": F.row_number().over(chain).cast("long"), "valid_from": F.col("ts"), "valid_to": F.lead("ts").over(chain)})


def artifacts(ev: DataFrame) -> DataFrame:
    """Artifacts of tool events. An event without a URI has a plain-text body."""
    return ev.where(F.col("event_type").isin("tool_call", "tool_result")).select(F.concat(F.lit("art_"), "event_id").alias("artifact_id"), "session_id", "agent_id", "event_id", F.col("event_type").alias("artifact_type"), F.lit("text/plain").alias("mime_type"), "lsn")


def tool_traces(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("event_type").isin("tool_call", "tool_result")).select(F.concat(F.lit("tool_trace_"), "event_id").alias("artifact_id"), "event_id", "session_id", "agent_id", F.lit("tool_trace").alias("artifact_type"), F.col("text").alias("body"))


def fragment_tokens(text: Column) -> Column:
    """Distinct words in lower case without marks at their ends, in order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(fields(F.lower(F.trim(text))), lambda w: F.btrim(w, F.lit(".,!?;:"))), lambda w: w != ""))


def salience(importance: Column, tokens: Column, refs: Column, visibility: Column) -> Column:
    """Importance (0.5 where missing or zero) with bonuses for many tokens, causal references and global visibility."""
    base = F.when(F.coalesce(importance, F.lit(0.0)) == 0, 0.5).otherwise(importance)
    raised = base + F.when(F.size(tokens) > 10, 0.1).otherwise(0.0) + F.when(F.size(refs) > 0, 0.1).otherwise(0.0) + F.when(visibility == "global", 0.2).otherwise(0.0)
    return F.least(raised, F.lit(1.0))


def fragments(ev: DataFrame) -> DataFrame:
    """Precomputed evidence of each event's memory."""
    tokens = fragment_tokens(F.col("text"))
    related = F.concat(F.filter(F.array("agent_id", "session_id"), lambda x: x != ""), F.col("causal_refs"))
    filters = F.filter(F.array(F.when(F.col("agent_id") != "", F.concat(F.lit("agent_id:"), "agent_id")), F.when(F.col("visibility") != "", F.concat(F.lit("visibility:"), "visibility"))), lambda x: x.isNotNull())
    return ev.select(F.concat(F.lit("mem_"), "event_id").alias("object_id"), tokens.alias("tokens"), related.alias("related"), filters.alias("filters"), salience(F.col("importance"), tokens, F.col("causal_refs"), F.col("visibility")).alias("salience"))


def merge_edges(base: DataFrame, derived: DataFrame) -> DataFrame:
    """Union by id: where both have an edge, the derived value of each field holds unless it is null."""
    kept = [c for c in base.columns if c != "edge_id"]
    both = base.withColumn("_late", F.lit(0)).unionByName(derived.withColumn("_late", F.lit(1)))
    return both.groupBy("edge_id").agg(*(F.coalesce(F.max(F.when(F.col("_late") == 1, F.col(c))), F.max(F.when(F.col("_late") == 0, F.col(c)))).alias(c) for c in kept))


def graph_nodes(memory: DataFrame) -> DataFrame:
    """Memories as graph nodes with their join key and a map of properties."""
    properties = F.map_from_arrays(F.array(F.lit("agent"), F.lit("session"), F.lit("type")), F.array("agent_id", "session_id", "memory_type"))
    return memory.select(F.col("memory_id").alias("node_id"), F.lit("memory").alias("node_type"), F.concat(F.lit("mem:"), "memory_id").alias("join_key"), F.coalesce(F.nullif("summary", F.lit("")), F.col("content")).alias("label"), properties.alias("properties"))


def latest_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest order columns of each key: what an upsert leaves."""
    best = W.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("_turn", F.row_number().over(best)).where("_turn = 1").drop("_turn")


def fill_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Missing values replaced by each column's default."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def fixed_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 400, step: int = 360) -> DataFrame:
    """Windows of ``size`` characters every ``step``; a text has one at least, unless it is empty."""
    n = F.length(text_col)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1 - (size - step), F.lit(0)), F.lit(step)))
    return docs.select(F.col(id_col), F.posexplode(starts).alias("chunk_no", "start"), F.col(text_col).alias("_t")).select(id_col, "chunk_no", "start", F.substring(F.col("_t"), F.col("start") + 1, F.lit(size)).alias("chunk"))


def handoff_events(handoffs: DataFrame) -> DataFrame:
    """The log's event of each handoff (seq, from_agent, to_agent, session_id, role_from, role_to) that names both agents;
    the giver is its actor."""
    named = handoffs.where("from_agent != '' and to_agent != ''")
    names = ("from_agent", "to_agent", "role_from", "role_to")
    payload = F.map_from_arrays(F.array(*(F.lit(c) for c in names)), F.array(*(F.coalesce(c, F.lit("")) for c in names)))
    return named.select("seq", F.concat(F.lit("handoff_"), "seq").alias("event_id"), F.col("from_agent").alias("agent_id"), "session_id", F.lit("handoff_occurred").alias("event_type"), payload.alias("payload"))


def apply_handoffs(agents: DataFrame, handoffs: DataFrame) -> DataFrame:
    """Agents (agent_id, role, ...) with the role that the last handoff gave them. In one handoff the receiver is changed
    first, then the giver; blank roles and agents that don't exist change nothing."""
    change = lambda turn, who, role: F.struct((F.col("seq") * 2 + turn).alias("at"), F.col(who).alias("agent_id"), F.col(role).alias("given"))
    changes = handoffs.where("from_agent != '' and to_agent != ''").select(F.inline(F.array(change(0, "to_agent", "role_to"), change(1, "from_agent", "role_from"))))
    last = changes.where("given != ''").groupBy("agent_id").agg(F.max_by("given", "at").alias("_given"))
    return agents.join(last, "agent_id", "left").withColumn("role", F.coalesce("_given", "role")).drop("_given")
