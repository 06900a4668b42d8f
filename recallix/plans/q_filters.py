"""Queries over filters, access and the predicate language (F, P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import space_out
from ..operators import filters as fl
from .fixtures import NOW
from .registry import query


def now():
    return F.expr(f"timestamp_ntz '{NOW}'")


_NOW = f"TIMESTAMP '{NOW}'"
_AS_OF = "TIMESTAMP '2024-01-25 00:00:00'"


@query("f1_safety_filter", f"SELECT memory_id FROM memory WHERE NOT list_contains(policy_tags, 'quarantine') AND NOT (ttl > 0 AND ttl < epoch({_NOW})) AND valid_from <= {_NOW} AND is_active AND valid_from <= {_AS_OF} AND version >= 2 AND lifecycle_state <> 'unverified' AND NOT list_contains(policy_tags, 'unverified')")
def f1(t):
    return t.memory.where(fl.safety(now(), F.expr("timestamp_ntz '2024-01-25 00:00:00'"), min_version=2)).select("memory_id")


@query("f2_numeric_range", "SELECT memory_id, importance FROM memory WHERE importance BETWEEN 0.25 AND 0.75 AND version <= 5")
def f2(t):
    return t.memory.where(fl.numeric_range("importance", 0.25, 0.75) & fl.numeric_range("version", high=5)).select("memory_id", "importance")


@query("f3_tag_filter", "SELECT memory_id FROM memory WHERE NOT list_has_any(policy_tags, ['quarantine', 'unverified']) AND list_has_any(policy_tags, ['noise', 'reviewed'])")
def f3(t):
    return t.memory.where(fl.tags(["noise", "reviewed"], ["quarantine", "unverified"], "any")).select("memory_id")


_ALLOWS = "(list_has_any(read_agents, ['agent_6', '*']) OR list_has_any(read_roles, ['building']) OR len(list_filter(regexp_split_to_array(read_acl, '[,; \\t\\n]'), lambda x: x IN ('*', 'agent_6', 'agent:agent_6', 'role:building'))) > 0)"


def _principal(t):
    """Rows as the access rules read them: every seventh memory names a share contract."""
    ok = t.contract.select(F.col("contract_id"), (((F.col("workspace_id") == "") | (F.col("workspace_id") == "ws_2")) & fl.contract_allows(F.col("read_agents"), F.col("read_roles"), F.col("read_acl"), "agent_6", ["building"])).alias("contract_ok"))
    m = t.memory.withColumn("contract_id", F.when(F.col("n") % 7 == 0, F.concat(F.lit("contract_"), F.col("n") % 25))).withColumns({"grant_agents": F.when(F.col("k") % 9 == 0, F.array(F.lit("agent_6"))).otherwise(F.array().cast("array<string>")), "grant_roles": F.when(F.col("k") % 14 == 0, F.array(F.lit("building"))).otherwise(F.array().cast("array<string>"))})
    return m.join(F.broadcast(ok), "contract_id", "left").withColumn("reason", fl.access_reason("agent_6", ["building"], "tenant_0", "ws_2", "sess_6_20240105", 8000))


_ACC = f"""ac AS (
  SELECT m.memory_id, m.agent_id, m.n, CASE WHEN lsn > 8000 THEN 'mutation_not_visible' WHEN tenant_id <> 'tenant_0' THEN 'tenant_mismatch' WHEN agent_id = 'agent_6' THEN 'owner'
    WHEN n % 7 = 0 AND c.ok THEN 'share_contract' WHEN n % 7 = 0 THEN 'share_contract_denied' WHEN k % 9 = 0 THEN 'explicit_agent_grant' WHEN k % 14 = 0 THEN 'explicit_role_grant'
    WHEN visibility = 'public' THEN 'public' WHEN visibility = 'workspace' AND m.workspace_id = 'ws_2' THEN 'workspace' WHEN visibility = 'session' AND session_id = 'sess_6_20240105' THEN 'session' WHEN visibility = 'private' THEN 'private' ELSE 'scope_not_visible' END AS reason
  FROM memory m LEFT JOIN (SELECT contract_id, (workspace_id IN ('', 'ws_2')) AND {_ALLOWS} AS ok FROM contract) c ON m.n % 7 = 0 AND c.contract_id = 'contract_' || m.n % 25
)"""
_ALLOWED = "('" + "', '".join(fl.ALLOWED) + "')"


@query("f4_evaluate_access", f"SELECT memory_id, reason, reason IN {_ALLOWED} AS allowed FROM ac", _ACC)
def f4(t):
    return _principal(t).select("memory_id", "reason", F.col("reason").isin(*fl.ALLOWED).alias("allowed"))


@query("f5_share_contract_allows", f"SELECT contract_id, {_ALLOWS} AS allowed FROM contract")
def f5(t):
    return t.contract.select("contract_id", fl.contract_allows(F.col("read_agents"), F.col("read_roles"), F.col("read_acl"), "agent_6", ["building"]).alias("allowed"))


@query("f6_metadata_access", "SELECT memory_id, CASE WHEN agent_id = 'agent_6' THEN 'owner' WHEN visibility IN ('public', 'global') THEN 'public' WHEN visibility = 'workspace' AND workspace_id = 'ws_2' THEN 'workspace' WHEN visibility = 'session' AND session_id = 'sess_6_20240105' THEN 'session' ELSE 'denied' END AS decision FROM memory")
def f6(t):
    return t.memory.select("memory_id", fl.metadata_access("agent_6", "ws_2", "sess_6_20240105").alias("decision"))


@query("f7_lifecycle_filter", "SELECT memory_id FROM memory WHERE is_active AND NOT list_contains(policy_tags, 'quarantine') AND memory_id NOT IN (SELECT object_id FROM policy WHERE quarantine_flag)")
def f7(t):
    return fl.not_in_lifecycle(t.memory, t.policy).select("memory_id")


@query("f8_quarantined", "SELECT memory_id, list_contains(policy_tags, 'quarantine') OR memory_id IN (SELECT object_id FROM policy WHERE quarantine_flag) AS quarantined FROM memory")
def f8(t):
    flagged = t.policy.where("quarantine_flag").select(F.col("object_id").alias("memory_id")).distinct().withColumn("flag", F.lit(True))
    return t.memory.join(flagged, "memory_id", "left").select("memory_id", (fl.quarantined_by_tag(F.col("policy_tags")) | F.coalesce("flag", F.lit(False))).alias("quarantined"))


@query("f9_selectors", "SELECT memory_id FROM memory WHERE workspace_id = 'ws_1' AND dataset_name = 'ds_2' AND source_file_name = 'file_3.txt'")
def f9(t):
    return t.memory.where(fl.equal_when_set(workspace_id="ws_1", agent_id="", session_id=None, dataset_name="ds_2", source_file_name="file_3.txt")).select("memory_id")


@query("f10_latest_batch", "SELECT memory_id, m.import_batch_id FROM memory m JOIN (SELECT workspace_id, arg_max(import_batch_id, (version, valid_from, import_batch_id)) AS b FROM memory WHERE import_batch_id <> '' GROUP BY workspace_id) x ON m.workspace_id = x.workspace_id AND m.import_batch_id = x.b")
def f10(t):
    return fl.latest_batch(t.memory, ["workspace_id"]).select("memory_id", "import_batch_id")


@query("f11_ttl_expired", f"SELECT memory_id, ttl > 0 AND epoch_us({_NOW}) - epoch_us(valid_from) > ttl * 1000000 AS expired FROM memory")
def f11(t):
    return t.memory.select("memory_id", fl.lifetime_expired(now(), F.col("valid_from"), F.col("ttl")).alias("expired"))


@query("f12_filter_by_types", "SELECT id FROM (SELECT memory_id AS id FROM memory UNION ALL SELECT event_id FROM ev UNION ALL SELECT edge_id FROM edge UNION ALL SELECT agent_id FROM agent) WHERE starts_with(id, 'mem_') OR starts_with(id, 'agent_')")
def f12(t):
    ids = t.memory.select(F.col("memory_id").alias("id")).unionByName(t.ev.select(F.col("event_id").alias("id"))).unionByName(t.edge.select(F.col("edge_id").alias("id"))).unionByName(t.agent.select(F.col("agent_id").alias("id")))
    return ids.where(fl.by_type(F.col("id"), ["memory", "artifact"]))


@query("f14_evidence_access", f"SELECT edge_id FROM edge WHERE src NOT IN (SELECT memory_id FROM ac WHERE reason NOT IN {_ALLOWED}) AND dst NOT IN (SELECT memory_id FROM ac WHERE reason NOT IN {_ALLOWED})", _ACC)
def f14(t):
    denied = _principal(t).where(~F.col("reason").isin(*fl.ALLOWED)).select(F.col("memory_id").alias("id"))
    return fl.without_denied(t.edge, denied).select("edge_id")


@query("f15_contamination", f"SELECT agent_id, count(*) AS returned, count(*) FILTER (reason NOT IN {_ALLOWED}) AS denied FROM ac WHERE agent_id <> 'agent_6' GROUP BY agent_id", _ACC)
def f15(t):
    bad = (~F.col("reason").isin(*fl.ALLOWED)).cast("long")
    return _principal(t).where("agent_id != 'agent_6'").groupBy("agent_id").agg(F.count(F.lit(1)).alias("returned"), F.sum(bad).alias("denied"))


@query("f16_scope_filter", "SELECT memory_id FROM memory WHERE CASE WHEN visibility = '' THEN 'private_agent' ELSE visibility END IN ('private_agent', 'public')")
def f16(t):
    return t.memory.where(F.when(F.col("visibility") == "", "private_agent").otherwise(F.col("visibility")).isin("private_agent", "public")).select("memory_id")


@query("f17_lifecycle_exclusion", "SELECT memory_id FROM memory WHERE lifecycle_state NOT IN ('quarantined', 'hidden', 'deleted_logically')")
def f17(t):
    return t.memory.where(~F.col("lifecycle_state").isin("quarantined", "hidden", "deleted_logically")).select("memory_id")


@query("f18_effective_salience", "SELECT memory_id, CASE WHEN w > 0 THEN w ELSE importance END AS salience FROM memory LEFT JOIN (SELECT object_id, arg_max(salience_weight, policy_event_id) AS w FROM policy GROUP BY object_id) ON memory_id = object_id")
def f18(t):
    return fl.effective_salience(t.memory, t.policy)


@query("f19_effective_confidence", "SELECT memory_id, coalesce(o, confidence) AS confidence FROM memory LEFT JOIN (SELECT object_id, arg_min(confidence_override, seq) AS o FROM policy WHERE confidence_override > 0 GROUP BY object_id) ON memory_id = object_id")
def f19(t):
    return fl.effective_confidence(t.memory, t.policy)


@query("f20_verified", "SELECT object_id, coalesce(arg_min(verified_state, seq) FILTER (verified_state IN ('verified', 'retracted')) = 'verified', true) AS verified FROM policy GROUP BY object_id")
def f20(t):
    return fl.verified(t.policy)


@query("f22_spaced_query", r"SELECT item_id, rtrim(regexp_replace(regexp_replace(text, '\s+', '', 'g'), '(.)', '\1 ', 'g')) AS spaced FROM benchmark")
def f22(t):
    return t.benchmark.select("item_id", space_out(F.col("text")).alias("spaced"))


@query("p1_unary_range", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 45 AND l_returnflag <> 'R'")
def p1(t):
    return t.lineitem.where((F.col("l_quantity") >= 45) & (F.col("l_returnflag") != "R")).select("l_orderkey", "l_linenumber")


@query("p2_binary_range", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 150000")
def p2(t):
    return t.orders.where((F.col("o_totalprice") > 100000) & (F.col("o_totalprice") <= 150000)).select("o_orderkey")


@query("p3_term", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
def p3(t):
    return t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.col("c_nationkey").isin(1, 2, 3)).select("c_custkey")


@query("p4_compare", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > l_tax")
def p4(t):
    return t.lineitem.where(F.col("l_discount") > F.col("l_tax")).select("l_orderkey", "l_linenumber")


@query("p5_and_or", "SELECT p_partkey FROM part WHERE (p_size < 10 AND p_retailprice > 1000) OR p_size > 45")
def p5(t):
    return t.part.where(((F.col("p_size") < 10) & (F.col("p_retailprice") > 1000)) | (F.col("p_size") > 45)).select("p_partkey")


@query("p6_not", "SELECT p_partkey FROM part WHERE NOT (p_size BETWEEN 10 AND 40)")
def p6(t):
    return t.part.where(~F.col("p_size").between(10, 40)).select("p_partkey")


@query("p7_arithmetic", "SELECT memory_id FROM memory WHERE (n * 3 + 1) % 5 = 2 AND len(source_event_ids) >= 1 AND importance * 2 - 1 < 0")
def p7(t):
    return t.memory.where(((F.col("n") * 3 + 1) % 5 == 2) & (F.size("source_event_ids") >= 1) & (F.col("importance") * 2 - 1 < 0)).select("memory_id")


@query("p8_match", "SELECT doc_id, starts_with(content, 'The') AS prefix, ends_with(content, '.') AS suffix, contains(content, 'eron') AS inner_match, content LIKE 'T%on%' AS general FROM doc")
def p8(t):
    c = F.col("content")
    return t.doc.select("doc_id", c.startswith("The").alias("prefix"), c.endswith(".").alias("suffix"), c.contains("eron").alias("inner_match"), c.like("T%on%").alias("general"))


@query("p9_text_match", r"SELECT doc_id, list_has_any(string_split(lower(content), ' '), ['eron', 'thion']) AS any_word, regexp_matches(lower(content), '(^|\s)of the(\s|$)') AS phrase FROM doc")
def p9(t):
    low = F.lower("content")
    return t.doc.select("doc_id", F.arrays_overlap(F.split(low, " "), F.array(F.lit("eron"), F.lit("thion"))).alias("any_word"), low.rlike(r"(^|\s)of the(\s|$)").alias("phrase"))


@query("p10_null", "SELECT doc_id, quality IS NULL AS missing FROM doc")
def p10(t):
    return t.doc.select("doc_id", F.col("quality").isNull().alias("missing"))


@query("p11_json_exists", "SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS has_k, json_extract_string(props, '$.z') IS NOT NULL AS has_z FROM events")
def p11(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").isNotNull().alias("has_k"), F.get_json_object("props", "$.z").isNotNull().alias("has_z"))


@query("p12_contains", "SELECT memory_id, list_contains(policy_tags, 'noise') AS one, list_has_all(policy_tags, ['noise', 'reviewed']) AS every, list_has_any(policy_tags, ['noise', 'unverified']) AS some FROM memory")
def p12(t):
    tags = F.col("policy_tags")
    return t.memory.select("memory_id", F.array_contains(tags, "noise").alias("one"), fl.tags(["noise", "reviewed"]).alias("every"), fl.tags(["noise", "unverified"], mode="any").alias("some"))


@query("p14_random_sample", "SELECT memory_id FROM memory WHERE CAST('0x' || substr(md5(memory_id), 1, 8) AS BIGINT) < 429496729")
def p14(t):
    return t.memory.where(F.conv(F.substring(F.md5("memory_id"), 1, 8), 16, 10).cast("long") < 429496729).select("memory_id")


@query("p15_element_filter", "SELECT memory_id, array_to_string(list_filter(source_event_ids, lambda x: ends_with(x, '7')), ',') AS kept FROM memory")
def p15(t):
    return t.memory.select("memory_id", F.array_join(F.filter("source_event_ids", lambda x: x.endswith("7")), ",").alias("kept"))


@query("p16_match_count", "SELECT memory_id, len(list_filter(policy_tags, lambda x: x <> 'reviewed')) = len(policy_tags) AS match_all, len(list_filter(policy_tags, lambda x: x = 'noise')) > 0 AS match_any, len(policy_tags) >= 2 AS at_least_2, len(policy_tags) <= 1 AS at_most_1, len(policy_tags) = 1 AS exactly_1 FROM memory")
def p16(t):
    tags = F.col("policy_tags")
    return t.memory.select("memory_id", F.forall(tags, lambda x: x != "reviewed").alias("match_all"), F.exists(tags, lambda x: x == "noise").alias("match_any"), (F.size(tags) >= 2).alias("at_least_2"), (F.size(tags) <= 1).alias("at_most_1"), (F.size(tags) == 1).alias("exactly_1"))


@query("p17_time_arithmetic", "SELECT memory_id FROM memory WHERE valid_from + INTERVAL 36 HOUR >= TIMESTAMP '2024-01-15 00:00:00'")
def p17(t):
    return t.memory.where(F.expr("valid_from + INTERVAL '36' HOUR >= timestamp_ntz '2024-01-15 00:00:00'")).select("memory_id")


__all__ = ["now"]
