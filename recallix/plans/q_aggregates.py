"""Queries over aggregates, windows, order and id sets (A, W, O, set operations, X)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import materialize as mz
from ..operators import memory_algorithms as ma
from ..operators.retrieval import knn, top_k_per
from .q_objects import _STATE
from .registry import query


@query("a1_aggregate_ops", "SELECT CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, count(*) AS n, round(avg(l_discount), 6) AS avg_disc, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price FROM lineitem")
def a1(t):
    return t.lineitem.agg(F.sum("l_quantity").alias("sum_qty"), F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.min("l_extendedprice").alias("min_price"), F.max("l_extendedprice").alias("max_price"))


@query("a2_partial_final", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, count(*) AS n, round(sum(l_quantity) / count(*), 6) AS avg_qty FROM lineitem GROUP BY ALL")
def a2(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity") / F.count(F.lit(1)), 6).alias("avg_qty"))


@query("a3_group_by_nulls", "SELECT quality, dataset_name, count(*) AS n, count(quality) AS known FROM doc GROUP BY quality, dataset_name")
def a3(t):
    return t.doc.groupBy("quality", "dataset_name").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("known"))


@query("a4_count_where", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 50000")
def a4(t):
    return t.orders.where("o_orderstatus = 'F' and o_totalprice > 50000").agg(F.count(F.lit(1)).alias("n"))


@query("a5_consolidate", "SELECT 'summary_' || agent_id || '_' || session_id AS memory_id, md5(string_agg(content, ' ' ORDER BY lsn) || ' ') AS content_md5, count(*) AS n_sources FROM memory WHERE level = 0 AND is_active GROUP BY agent_id, session_id")
def a5(t):
    return ma.consolidate(t.memory).select("memory_id", F.md5("content").alias("content_md5"), "n_sources")


_SUM = """s1 AS (SELECT agent_id, session_id, string_agg(content, ' | ' ORDER BY lsn) AS content, round(avg(importance), 9) AS importance, max(lsn) AS lsn, count(*) AS n_sources, 1 AS level, 'semantic' AS memory_type FROM memory WHERE level = 0 AND is_active GROUP BY agent_id, session_id HAVING count(*) >= 2),
s2 AS (SELECT agent_id, session_id, string_agg(content, ' | ' ORDER BY lsn) AS content, round(avg(importance), 9) AS importance, max(lsn) AS lsn, count(*) AS n_sources, 2 AS level, 'procedural' AS memory_type FROM (SELECT agent_id, session_id, content, importance, lsn FROM memory WHERE level = 1 AND is_active UNION ALL SELECT agent_id, session_id, content, importance, lsn FROM s1) GROUP BY agent_id, session_id HAVING count(*) >= 2)"""


@query("a6_summarise", "SELECT agent_id, session_id, memory_type, CAST(level AS BIGINT) AS level, n_sources, round(importance + 1e-9, 6) AS importance FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2)", _SUM)
def a6(t):
    cols = ["agent_id", "session_id", "content", "importance", "confidence", "valid_from", "lsn", "level", "is_active"]
    one = ma.summarise(t.memory.select(*cols), 1)
    two = ma.summarise(t.memory.select(*cols).unionByName(one.select(*cols)), 2)
    return one.unionByName(two).select("agent_id", "session_id", "memory_type", "level", "n_sources", F.round(F.col("importance") + 1e-9, 6).alias("importance"))


@query("a7_compress", "SELECT agent_id, md5(string_agg(content, ' | ' ORDER BY lsn)) AS content_md5, round(avg(importance) + 1e-9, 6) AS importance FROM memory GROUP BY agent_id")
def a7(t):
    return t.memory.groupBy("agent_id").agg(F.md5(ma.joined(F.col("content"), F.col("lsn"), " | ")).alias("content_md5"), F.round(F.avg("importance") + 1e-9, 6).alias("importance"))


@query("a8_compress_bank", "SELECT agent_id, md5(string_agg(content, ' | ' ORDER BY lsn)) AS content_md5, round(avg(importance) + 1e-9, 6) AS importance, max(confidence) AS confidence, 'Compressed from ' || count(*) || ' memories' AS summary FROM memory GROUP BY agent_id")
def a8(t):
    return t.memory.groupBy("agent_id").agg(F.md5(ma.joined(F.col("content"), F.col("lsn"), " | ")).alias("content_md5"), F.round(F.avg("importance") + 1e-9, 6).alias("importance"), F.max("confidence").alias("confidence"), F.concat(F.lit("Compressed from "), F.count(F.lit(1)), F.lit(" memories")).alias("summary"))


@query("a9_replay_preview", "SELECT event_type, count(*) AS n, min(lsn) AS first_lsn, max(lsn) AS last_lsn FROM ev WHERE lsn >= 100 GROUP BY event_type")
def a9(t):
    return t.ev.where("lsn >= 100").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))


@query("a10_percentiles", "SELECT event_type, max(value) FILTER (r = (50 * cnt + 99) // 100) AS p50, max(value) FILTER (r = (95 * cnt + 99) // 100) AS p95, max(value) FILTER (r = (99 * cnt + 99) // 100) AS p99 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS cnt FROM ev) GROUP BY event_type")
def a10(t):
    # Nearest rank by counted values: the window runs over distinct values with their counts, not over all rows.
    counted = t.ev.groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("c"))
    upto = W.partitionBy("event_type").orderBy("value")
    ranked = counted.withColumns({"upto": F.sum("c").over(upto), "n": F.sum("c").over(W.partitionBy("event_type"))})
    at = lambda p: F.min(F.when(F.col("upto") >= F.floor((F.lit(p) * F.col("n") + 99) / 100), F.col("value")))
    return ranked.groupBy("event_type").agg(at(50).alias("p50"), at(95).alias("p95"), at(99).alias("p99"))


@query("a11_metric_ratios", "SELECT session_id, count(*) AS total, count(*) FILTER (event_type = 'tool_call') AS calls, coalesce(round(count(*) FILTER (event_type = 'tool_result') / nullif(count(*) FILTER (event_type = 'tool_call'), 0), 6), 0) AS result_rate FROM ev GROUP BY session_id")
def a11(t):
    n = lambda k: F.sum((F.col("event_type") == k).cast("long"))
    return t.ev.groupBy("session_id").agg(F.count(F.lit(1)).alias("total"), n("tool_call").alias("calls"), F.coalesce(F.round(n("tool_result") / F.nullif(n("tool_call"), F.lit(0)), 6), F.lit(0.0)).alias("result_rate"))


_PREF = "pf AS (SELECT agent_id, lower(trim(content)) AS key, lsn, 0.6::DOUBLE AS s FROM memory WHERE memory_type = 'preference_constraint' AND confidence >= 0.7)"


@query("a12_extract_profile", "SELECT agent_id, key, round(list_reduce(list(s ORDER BY lsn), lambda a, x: (a + x) / 2.0), 6) AS strength FROM pf GROUP BY agent_id, key", _PREF)
def a12(t):
    return ma.profile_preferences(t.memory)


@query("a13_scoped_aggregate", "SELECT workspace_id, agent_id, count(*) AS n, round(avg(importance), 6) AS importance FROM memory GROUP BY ROLLUP (workspace_id, agent_id)")
def a13(t):
    return t.memory.rollup("workspace_id", "agent_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("importance"), 6).alias("importance"))


@query("a14_consensus", "SELECT state_key, workspace_id, arg_max(v, (c, v)) AS value, round(max(c) / sum(c), 6) AS share FROM (SELECT 'value' AS state_key, workspace_id, lpad(CAST(k AS VARCHAR), 3, '0') AS v, count(*) AS c FROM ev WHERE event_type = 'state_update' GROUP BY ALL) GROUP BY state_key, workspace_id")
def a14(t):
    votes = t.ev.where("event_type = 'state_update'").groupBy(F.lit("value").alias("state_key"), "workspace_id", F.lpad(F.col("k").cast("string"), 3, "0").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    return votes.groupBy("state_key", "workspace_id").agg(F.max_by("v", F.struct("c", "v")).alias("value"), F.round(F.max("c") / F.sum("c"), 6).alias("share"))


@query("a15_conflict_compare", "SELECT a.memory_id AS a_id, b.memory_id AS b_id FROM memory a JOIN memory b ON a.agent_id = b.agent_id AND a.memory_type = b.memory_type AND a.lsn < b.lsn AND b.valid_from <= a.valid_from + INTERVAL 3600 SECOND WHERE a.content <> b.content")
def a15(t):
    a = t.memory.select("agent_id", "memory_type", F.col("memory_id").alias("a_id"), F.col("lsn").alias("a_lsn"), F.col("valid_from").alias("a_from"), F.col("content").alias("a_c"), F.explode(F.array(F.floor(F.unix_seconds(F.col("valid_from").cast("timestamp")) / 3600), F.floor(F.unix_seconds(F.col("valid_from").cast("timestamp")) / 3600) + 1)).alias("hour"))
    b = t.memory.select("agent_id", "memory_type", F.col("memory_id").alias("b_id"), F.col("lsn").alias("b_lsn"), F.col("valid_from").alias("b_from"), F.col("content").alias("b_c"), F.floor(F.unix_seconds(F.col("valid_from").cast("timestamp")) / 3600).alias("hour"))
    near = (F.col("a_lsn") < F.col("b_lsn")) & (F.col("b_from") <= F.col("a_from") + F.expr("INTERVAL '3600' SECOND")) & (F.col("a_c") != F.col("b_c"))
    return a.join(b, ["agent_id", "memory_type", "hour"]).where(near).select("a_id", "b_id")


_NEAR = "SELECT a.vec_id AS query_id, b.vec_id AS object_id FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0{} QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) DESC, b.vec_id) <= 10"


@query("a16_recall_at_k", "SELECT q.vec_id AS query_id, round(count(f.object_id) / 10.0::DOUBLE, 6) AS recall FROM (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0) q LEFT JOIN tr ON tr.query_id = q.vec_id LEFT JOIN fo f ON f.query_id = tr.query_id AND f.object_id = tr.object_id GROUP BY q.vec_id", f"tr AS ({_NEAR.format('')}), fo AS ({_NEAR.format(' AND a.label = b.label')})")
def a16(t):
    """Recall at 10 of a search that only looks among rows of the query's label, against the exact one."""
    asked = t.embeddings.where("vec_id % 100 = 0")
    truth = knn(t.embeddings, asked, 10, "cosine").select("query_id", "object_id")
    labels = [r[0] for r in t.embeddings.select("label").distinct().collect()]  # lists of the index: a few
    found = None
    for x in labels:
        part = knn(t.embeddings.where(F.col("label") == x), asked.where(F.col("label") == x), 10, "cosine").select("query_id", "object_id", F.lit(1).alias("hit"))
        found = part if found is None else found.unionByName(part)
    hits = truth.join(found, ["query_id", "object_id"], "left").groupBy("query_id").agg(F.round(F.count("hit") / 10.0, 6).alias("recall"))
    return asked.select(F.col("vec_id").alias("query_id")).join(hits, "query_id", "left").select("query_id", F.coalesce("recall", F.lit(0.0)).alias("recall"))


@query("a17_rate_windows", "SELECT event_id, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS last_hour FROM ev")
def a17(t):
    """Events of the hour before each event: those up to it less those before the hour. Both are running numbers, of the
    minutes before and inside the minute, so that no window holds more than a minute's events, or one row a minute."""
    minute = lambda us: F.floor(us / 60_000_000)
    e = t.ev.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    marks = e.select("event_id", "us", F.lit(1).alias("one")).unionByName(e.select("event_id", (F.col("us") - 3_600_000_000).alias("us"), F.lit(0).alias("one"))).withColumn("minute", minute(F.col("us")))
    before = marks.groupBy("minute").agg(F.sum("one").alias("n")).select("minute", F.coalesce(F.sum("n").over(W.orderBy("minute").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    order = W.partitionBy("minute").orderBy("us")
    upto = F.sum("one").over(order.rangeBetween(W.unboundedPreceding, 0))
    under = F.coalesce(F.sum("one").over(order.rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    counted = marks.withColumn("inside", F.when(F.col("one") == 1, upto).otherwise(-under)).join(before, "minute")
    total = F.col("inside") + F.when(F.col("one") == 1, F.col("base")).otherwise(-F.col("base"))
    return counted.groupBy("event_id").agg(F.sum(total).cast("long").alias("last_hour"))


@query("a18_answer_consistency", "SELECT agent_id, round(avg(confidence), 6) AS consistency FROM ev WHERE event_type = 'critique_generated' GROUP BY agent_id")
def a18(t):
    return t.ev.where("event_type = 'critique_generated'").groupBy("agent_id").agg(F.round(F.avg("confidence"), 6).alias("consistency"))


@query("a19_index_stats", "SELECT namespace, count(*) AS n FROM doc GROUP BY namespace")
def a19(t):
    return t.doc.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


@query("w1_version_chain", "SELECT state_id, event_id, lag(event_id) OVER w AS previous, lead(event_id) OVER w AS next, row_number() OVER w AS version FROM st WINDOW w AS (PARTITION BY state_id ORDER BY lsn)", _STATE)
def w1(t):
    chain = W.partitionBy("state_id").orderBy("lsn")
    return mz.states(t.ev).select("state_id", "event_id", F.lag("event_id").over(chain).alias("previous"), F.lead("event_id").over(chain).alias("next"), F.row_number().over(chain).cast("long").alias("version"))


@query("w2_previous_memory", "SELECT memory_id, lag(memory_id) OVER (PARTITION BY agent_id, session_id ORDER BY lsn) AS previous FROM memory")
def w2(t):
    return t.memory.select("memory_id", F.lag("memory_id").over(W.partitionBy("agent_id", "session_id").orderBy("lsn")).alias("previous"))


@query("w3_every_tenth", "SELECT agent_id, event_id, r AS number FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY lsn) AS r FROM ev) WHERE r % 10 = 0")
def w3(t):
    return t.ev.select("agent_id", "event_id", F.row_number().over(W.partitionBy("agent_id").orderBy("lsn")).cast("long").alias("number")).where("number % 10 = 0")


@query("w4_session_context", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role <> 'system') WHERE r <= 3")
def w4(t):
    last = t.conversations.where("role != 'system'").withColumn("r", F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))).where("r <= 3")
    return last.select("conv_id", "turn", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long").alias("place"))


@query("w5_normalised_score", "SELECT memory_id, round(importance / max(importance) OVER (), 6) AS share FROM memory")
def w5(t):
    top = t.memory.agg(F.max("importance").alias("top"))
    return t.memory.crossJoin(F.broadcast(top)).select("memory_id", F.round(F.col("importance") / F.col("top"), 6).alias("share"))


@query("w6_grouped_top_k", "SELECT session_id, memory_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY importance DESC, memory_id) AS r FROM memory) WHERE r <= 2")
def w6(t):
    return top_k_per(t.memory, ["session_id"], "importance", 2, "memory_id").select("session_id", "memory_id", "rank")


@query("w7_visible_prefix", "SELECT agent_id, coalesce(min(lsn) FILTER (k % 50 = 0) - 1, max(lsn)) AS watermark FROM ev GROUP BY agent_id")
def w7(t):
    hidden = F.col("k") % 50 == 0
    return t.ev.groupBy("agent_id").agg(F.coalesce(F.min(F.when(hidden, F.col("lsn"))) - 1, F.max("lsn")).alias("watermark"))


@query("w8_group_ordered_sort", "SELECT session_id, memory_id, dense_rank() OVER (ORDER BY best DESC, session_id) AS group_place FROM (SELECT *, max(importance) OVER (PARTITION BY session_id) AS best FROM memory WHERE agent_id = 'agent_7')")
def w8(t):
    own = t.memory.where("agent_id = 'agent_7'")
    heads = own.groupBy("agent_id", "session_id").agg(F.max("importance").alias("best")).withColumn("group_place", F.row_number().over(W.partitionBy("agent_id").orderBy(F.col("best").desc(), "session_id")).cast("long"))
    return own.join(heads, ["agent_id", "session_id"]).select("session_id", "memory_id", "group_place")


@query("w9_validity_interval", "SELECT state_id, event_id, valid_from, valid_to FROM sv", _STATE)
def w9(t):
    return mz.state_versions(mz.states(t.ev)).select("state_id", "event_id", "valid_from", "valid_to")


@query("o1_top_scored", "SELECT memory_id, row_number() OVER (ORDER BY importance DESC, lsn DESC) AS place FROM (SELECT * FROM memory ORDER BY importance DESC, lsn DESC LIMIT 20)")
def o1(t):
    best = t.memory.orderBy(F.col("importance").desc(), F.col("lsn").desc()).limit(20)
    return best.select("memory_id", F.row_number().over(W.orderBy(F.col("importance").desc(), F.col("lsn").desc())).cast("long").alias("place"))


@query("o2_order_by", "SELECT dataset_name, memory_id, row_number() OVER (PARTITION BY dataset_name ORDER BY quality NULLS FIRST, n_chars DESC, memory_id) AS place FROM doc")
def o2(t):
    order = W.partitionBy("dataset_name").orderBy(F.col("quality").asc_nulls_first(), F.col("n_chars").desc(), "memory_id")
    return t.doc.select("dataset_name", "memory_id", F.row_number().over(order).cast("long").alias("place"))


@query("o3_order_by_json", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CAST(json_extract_string(props, '$.k') AS BIGINT) DESC, event_id) AS place FROM events")
def o3(t):
    order = W.partitionBy("user_id").orderBy(F.get_json_object("props", "$.k").cast("long").desc(), "event_id")
    return t.events.select("user_id", "event_id", F.row_number().over(order).cast("long").alias("place"))


@query("o4_merge_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey LIMIT 50 OFFSET 25")
def o4(t):
    return t.orders.where("o_totalprice > 1000").orderBy("o_orderkey").offset(25).limit(50).select("o_orderkey", "o_totalprice")


@query("o5_parse_order_by", "SELECT event_id, place FROM (SELECT event_id, row_number() OVER (ORDER BY CAST(json_extract_string(props, '$.k') AS BIGINT) DESC, value, event_id) AS place FROM events) WHERE place <= 30")
def o5(t):
    from .planner import order_columns

    columns = [*order_columns("props.$.k:long:desc, value:asc"), F.col("event_id").asc()]
    best = t.events.orderBy(*columns).limit(30)
    return best.select("event_id", F.row_number().over(W.orderBy(*columns)).cast("long").alias("place"))


@query("o6_effective_types", "SELECT memory_id, array_to_string(list_sort(list_distinct([memory_type, 'memory', memory_type])), ',') AS types FROM memory")
def o6(t):
    return t.memory.select("memory_id", F.array_join(F.array_sort(F.array_distinct(F.array("memory_type", F.lit("memory"), "memory_type"))), ",").alias("types"))


@query("o7_round_scores", "SELECT memory_id, round(importance, 2) AS score FROM memory ORDER BY score DESC, memory_id LIMIT 40 OFFSET 10")
def o7(t):
    return t.memory.select("memory_id", F.round("importance", 2).alias("score")).orderBy(F.col("score").desc(), "memory_id").offset(10).limit(40)


@query("set_append_missing", "SELECT id, CAST(min(place) AS BIGINT) AS place FROM (SELECT memory_id AS id, lsn AS place FROM memory WHERE is_active UNION ALL SELECT memory_id, lsn + 1000000 FROM memory WHERE importance > 0.5) GROUP BY id")
def set_append(t):
    a = t.memory.where("is_active").select(F.col("memory_id").alias("id"), F.col("lsn").alias("place"))
    b = t.memory.where("importance > 0.5").select(F.col("memory_id").alias("id"), (F.col("lsn") + 1_000_000).alias("place"))
    return a.unionByName(b).groupBy("id").agg(F.min("place").alias("place"))


@query("set_unique_strings", "SELECT DISTINCT trim(ref) AS ref FROM (SELECT provenance_ref AS ref FROM edge UNION ALL SELECT event_id FROM ev)")
def set_unique(t):
    return t.edge.select(F.trim("provenance_ref").alias("ref")).unionByName(t.ev.select(F.trim("event_id").alias("ref"))).distinct()


@query("set_edge_union", "SELECT edge_id FROM edge WHERE weight > 0.7 UNION SELECT edge_id FROM edge WHERE edge_type = 'derived_from'")
def set_edges(t):
    return t.edge.where("weight > 0.7").select("edge_id").union(t.edge.where("edge_type = 'derived_from'").select("edge_id")).distinct()


@query("set_intersection", "SELECT memory_id FROM memory WHERE is_active INTERSECT SELECT object_id FROM policy")
def set_intersection(t):
    return t.memory.where("is_active").select("memory_id").intersect(t.policy.select("object_id"))


@query("set_difference", "SELECT event_id FROM ev WHERE event_type = 'tool_call' EXCEPT SELECT parent_event_id FROM ev WHERE event_type = 'tool_result'")
def set_difference(t):
    return t.ev.where("event_type = 'tool_call'").select("event_id").subtract(t.ev.where("event_type = 'tool_result'").select("parent_event_id"))


@query("x3_embedding_compatibility", "SELECT count(*) AS checked, count(*) FILTER (label >= 5 OR len(embedding) <> 64) AS incompatible, count(*) FILTER (label = 0) AS legacy FROM embeddings")
def x3(t):
    n = lambda c: F.sum(c.cast("long"))
    return t.embeddings.agg(F.count(F.lit(1)).alias("checked"), n((F.col("label") >= 5) | (F.size("embedding") != 64)).alias("incompatible"), n(F.col("label") == 0).alias("legacy"))


@query("x4_segments_per_day", "SELECT workspace_id AS namespace, import_batch_id AS day, count(*) AS n FROM memory GROUP BY ALL")
def x4(t):
    return t.memory.groupBy(F.col("workspace_id").alias("namespace"), F.col("import_batch_id").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("x5_session_metrics", "SELECT session_id, count(*) AS steps, round(sum(value), 2) AS tokens, round(count(*) FILTER (len(causal_refs) > 0) / count(*), 6) AS evidence_rate FROM ev GROUP BY session_id")
def x5(t):
    return t.ev.groupBy("session_id").agg(F.count(F.lit(1)).alias("steps"), F.round(F.sum("value"), 2).alias("tokens"), F.round(F.sum((F.size("causal_refs") > 0).cast("long")) / F.count(F.lit(1)), 6).alias("evidence_rate"))


@query("x8_task_stage", "SELECT session_id, arg_max(event_type, lsn) AS stage FROM ev GROUP BY session_id")
def x8(t):
    return t.ev.groupBy("session_id").agg(F.max_by("event_type", "lsn").alias("stage"))


@query("x16_vector_upsert", "SELECT label, arg_max(vec_id, vec_id) AS vec_id FROM embeddings WHERE len(embedding) = 64 GROUP BY label")
def x16(t):
    return mz.latest_per_key(t.embeddings.where(F.size("embedding") == 64), ["label"], ["vec_id"]).select("label", "vec_id")


