"""Filters over memories: safety rules, ranges, tags, lifetimes, selectors, and access decisions with their reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safety(now: Column, as_of: Column | None = None, min_version: int = 0, exclude_quarantined: bool = True, exclude_unverified: bool = True) -> Column:
    """The seven rules that a memory must pass: not quarantined, not past an absolute expiry second, not from the
    future, active, visible at ``as_of``, new enough, and verified."""
    rules = [~((F.col("ttl") > 0) & (F.col("ttl") < F.unix_seconds(now.cast("timestamp")))), F.coalesce(F.col("valid_from") <= now, F.lit(True)), F.col("is_active")]
    if exclude_quarantined:
        rules.append(~F.array_contains("policy_tags", "quarantine"))
    if as_of is not None:
        rules.append(F.coalesce(F.col("valid_from") <= as_of, F.lit(True)))
    if min_version > 0:
        rules.append(F.col("version") >= min_version)
    if exclude_unverified:
        rules.append((F.col("lifecycle_state") != "unverified") & ~F.array_contains("policy_tags", "unverified"))
    out = rules[0]
    for r in rules[1:]:
        out = out & r
    return out


def numeric_range(field: str, low: float | None = None, high: float | None = None) -> Column:
    """Inclusive range on importance, confidence, version or ttl; any other field keeps nothing."""
    if field not in ("importance", "confidence", "version", "ttl"):
        return F.lit(False)
    out = F.lit(True)
    if low is not None:
        out = out & (F.col(field) >= low)
    if high is not None:
        out = out & (F.col(field) <= high)
    return out


def tags(required: Sequence[str] = (), excluded: Sequence[str] = (), mode: str = "all") -> Column:
    """No excluded tag, and all (or any) of the required ones."""
    own = F.col("policy_tags")
    out = ~F.arrays_overlap(own, F.array(*(F.lit(t) for t in excluded))) if excluded else F.lit(True)
    if required:
        want = F.array(*(F.lit(t) for t in required))
        out = out & (F.arrays_overlap(own, want) if mode == "any" else F.size(F.array_except(want, own)) == 0)
    return out


def lifetime_expired(now: Column, valid_from: Column, ttl: Column) -> Column:
    """Seconds of lifetime from ``valid_from`` are over; 0 means no end."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(valid_from.cast("timestamp"))
    return (ttl > 0) & F.coalesce(age > ttl * 1_000_000, F.lit(False))


def equal_when_set(**selectors: str | None) -> Column:
    """Equality on every selector that is set; empty and None mean any."""
    out = F.lit(True)
    for name, value in selectors.items():
        if value:
            out = out & (F.col(name) == value)
    return out


def dataset_match(workspace: str, file_name: str = "", dataset: str = "", prefix: str = "") -> Column:
    """Selectors of a workspace's memories, all of which must hold. A memory without the column is judged by a label
    in its content that stands alone, as in ``dataset_name:NAME`` or ``file_name:NAME``."""
    out = F.lit(workspace != "") & (F.col("workspace_id") == workspace)

    def label(key: str, value: str, whole: bool) -> Column:
        end = r"(?![A-Za-z0-9_.\-])" if whole else ""
        quoted = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in value)
        return F.col("content").rlike(rf"(?<![A-Za-z0-9_]){key}:{quoted}{end}")

    if file_name:
        out = out & F.when(F.col("source_file_name") != "", F.col("source_file_name") == file_name).otherwise(label("file_name", file_name, True))
    if dataset:
        out = out & F.when(F.col("dataset_name") != "", F.col("dataset_name") == dataset).otherwise(label("dataset_name", dataset, True))
    if prefix:
        out = out & F.when(F.col("source_file_name") != "", F.col("source_file_name").startswith(prefix)).otherwise(label("file_name", prefix, False))
    return out


def by_type(object_id: Column, wanted: Sequence[str]) -> Column:
    """Ids whose prefix stands for a wanted type; ids of unknown prefix stay. Only unknown names mean the default."""
    known = {"memory": ("mem_", "summary_", "shared_"), "agent_state": ("state_",), "artifact": ("art_", "tool_trace_"), "event": ("evt_",), "edge": ("edge_",)}
    types = [t for t in dict.fromkeys(wanted) if t in known] or ["memory", "agent_state", "artifact"]
    has = lambda ps: F.greatest(*(object_id.startswith(p) for p in (*ps, *ps)))
    every = [p for ps in known.values() for p in ps]
    return has([p for t in types for p in known[t]]) | ~has(every)


def latest_batch(memory: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Memories of each key's latest import batch: highest version, then latest start; blank batches don't count."""
    best = memory.where("import_batch_id != ''").groupBy(*keys).agg(F.max_by("import_batch_id", F.struct("version", "valid_from", "import_batch_id")).alias("import_batch_id"))
    return memory.join(best, [*keys, "import_batch_id"], "left_semi")


def quarantined_by_tag(policy_tags: Column) -> Column:
    return F.exists(policy_tags, lambda t: F.lower(F.trim(t)).isin("quarantine", "quarantined"))


def not_in_lifecycle(memory: DataFrame, policy: DataFrame) -> DataFrame:
    """Active memories that neither a tag nor a policy quarantines. Flagged ids are reduced to one row each first."""
    flagged = policy.where("quarantine_flag").select(F.col("object_id").alias("memory_id")).distinct()
    return memory.where(F.col("is_active") & ~quarantined_by_tag(F.col("policy_tags"))).join(flagged, "memory_id", "left_anti")


def effective_salience(memory: DataFrame, policy: DataFrame) -> DataFrame:
    """Weight of the latest policy if positive, else the memory's importance."""
    last = policy.groupBy("object_id").agg(F.max_by("salience_weight", "policy_event_id").alias("w"))
    return memory.join(last, F.col("memory_id") == F.col("object_id"), "left").select("memory_id", F.when(F.col("w") > 0, F.col("w")).otherwise(F.col("importance")).alias("salience"))


def effective_confidence(memory: DataFrame, policy: DataFrame) -> DataFrame:
    """First positive override in the order of the log, else the memory's confidence."""
    first = policy.where("confidence_override > 0").groupBy("object_id").agg(F.min_by("confidence_override", "seq").alias("o"))
    return memory.join(first, F.col("memory_id") == F.col("object_id"), "left").select("memory_id", F.coalesce("o", "confidence").alias("confidence"))


def verified(policy: DataFrame) -> DataFrame:
    """(object_id, verified) by the first policy that says verified or retracted; neither means verified."""
    said = F.when(F.col("verified_state").isin("verified", "retracted"), F.col("verified_state"))
    return policy.groupBy("object_id").agg(F.min_by(said, F.when(said.isNotNull(), F.col("seq"))).alias("s")).select("object_id", F.coalesce(F.col("s") == "verified", F.lit(True)).alias("verified"))


def lists_allow(agents: Column, roles: Column, acl: Column, agent: Column, own_roles: Column) -> Column:
    """A share contract's lists or its access string (tokens *, an id, agent:ID, role:NAME) let a principal in; a blank
    agent is in by * only."""
    tokens = F.filter(F.split(acl, r"[,; \t\n]"), lambda t: t != "")
    named = agent != ""
    by_token = F.exists(tokens, lambda t: (t == "*") | (named & ((t == agent) | (t == F.concat(F.lit("agent:"), agent)))) | (t.startswith("role:") & F.array_contains(own_roles, F.substring(t, 6, 1 << 20))))
    listed = F.exists(agents, lambda a: (a == "*") | (named & (a == agent)))
    return listed | F.arrays_overlap(roles, own_roles) | by_token


def contract_allows(agents: Column, roles: Column, acl: Column, agent_id: str, own_roles: Sequence[str]) -> Column:
    """``lists_allow`` for one principal."""
    mine = F.array(*(F.lit(r) for r in own_roles)) if own_roles else F.array().cast("array<string>")
    return lists_allow(agents, roles, acl, F.lit(agent_id), mine)


def share_requests(requests: DataFrame, contracts: DataFrame, agents: DataFrame) -> DataFrame:
    """Requests (memory_id, owner, workspace_id, from_agent, to_agent, contract_id) with their outcome and the id of the
    memory that the receiver gets (null unless shared).

    In this order: a blank id, someone else's memory, a receiver that has it already; then, with a contract, whether it is
    known, meets the memory's workspace, lets the giver derive and lets the receiver read. Contracts and agents (agent_id,
    role) have one row for each id."""
    own = contracts.select(F.col("contract_id").alias("_id"), F.col("workspace_id").alias("_ws"), *(F.col(f"{op}_{x}").alias(f"_{op}_{x}") for op in ("derive", "read") for x in ("agents", "roles", "acl")))
    role = lambda name: agents.select(F.col("agent_id").alias(f"_{name}"), F.array("role").alias(f"_{name}_roles"))
    met = requests.join(own, F.col("contract_id") == F.col("_id"), "left").join(role("from"), F.col("from_agent") == F.col("_from"), "left").join(role("to"), F.col("to_agent") == F.col("_to"), "left")
    none = F.array().cast("array<string>")
    may = lambda op, who: F.coalesce(lists_allow(F.col(f"_{op}_agents"), F.col(f"_{op}_roles"), F.col(f"_{op}_acl"), F.trim(f"{who}_agent"), F.coalesce(f"_{who}_roles", none)), F.lit(False))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    outcome = (
        F.when(blank("memory_id") | blank("from_agent") | blank("to_agent"), "invalid")
        .when(~blank("owner") & (F.col("owner") != F.trim("from_agent")), "not_owner")
        .when(F.trim("from_agent") == F.trim("to_agent"), "no_op")
        .when(blank("contract_id"), "shared")
        .when(F.col("_id").isNull(), "contract_not_found")
        .when(~blank("_ws") & ~F.col("_ws").eqNullSafe(F.col("workspace_id")), "other_scope")
        .when(~may("derive", "from"), "derive_denied")
        .when(~may("read", "to"), "read_denied")
        .otherwise("shared")
    )
    shared_id = F.when(F.col("outcome") == "shared", F.concat(F.lit("shared_"), "memory_id", F.lit("_to_"), F.trim("to_agent")))
    return met.withColumn("outcome", outcome).withColumn("shared_id", shared_id).select(*requests.columns, "outcome", "shared_id")


def access_reason(agent_id: str, roles: Sequence[str], tenant: str, workspace: str, session: str, watermark: int) -> Column:
    """Why a principal may or may not see a row; the first rule that applies, in this order: not yet visible, other
    tenant, owner, share contract, grants, visibility. Rows have tenant_id, workspace_id, session_id, agent_id,
    visibility, lsn, contract_ok (null without a contract), grant_agents and grant_roles."""
    mine = F.array(*(F.lit(r) for r in roles)) if roles else F.array().cast("array<string>")
    v = F.lower(F.trim("visibility"))
    same = lambda c, x: (F.col(c) != "") & (F.col(c) == x)
    return (
        F.when((F.col("lsn") > 0) & (F.col("lsn") > watermark), "mutation_not_visible")
        .when((F.col("tenant_id") != "") & F.lit(tenant != "") & (F.col("tenant_id") != tenant), "tenant_mismatch")
        .when(F.lit(agent_id != "") & (F.col("agent_id") == agent_id), "owner")
        .when(F.col("contract_ok"), "share_contract")
        .when(~F.col("contract_ok"), "share_contract_denied")
        .when(F.array_contains("grant_agents", agent_id), "explicit_agent_grant")
        .when(F.arrays_overlap("grant_roles", mine), "explicit_role_grant")
        .when(v.isin("public", "global_shared", "global"), "public")
        .when((v == "tenant") & same("tenant_id", tenant), "tenant")
        .when(v.isin("workspace", "shared", "workspace_shared") & same("workspace_id", workspace), "workspace")
        .when(v.isin("session", "session_local") & same("session_id", session), "session")
        .when(v.isin("private", "private_agent", "private_user"), "private")
        .when(v == "restricted_shared", "restricted_without_grant")
        .when((v == "") & (F.col("agent_id") == ""), "legacy_unowned")
        .otherwise("scope_not_visible")
    )


ALLOWED = ("owner", "share_contract", "explicit_agent_grant", "explicit_role_grant", "public", "tenant", "workspace", "team", "session", "legacy_unowned")


def metadata_access(agent_id: str, workspace: str, session: str) -> Column:
    """The reduced decision from scope columns alone."""
    v = F.lower(F.trim("visibility"))
    return F.when(F.col("agent_id") == agent_id, "owner").when(v.isin("public", "global"), "public").when((v == "workspace") & (F.col("workspace_id") == workspace), "workspace").when((v == "session") & (F.col("session_id") == session), "session").otherwise("denied")


def without_denied(edges: DataFrame, denied: DataFrame) -> DataFrame:
    """Edges with both ends allowed; ``denied`` has one column id."""
    ids = denied.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
