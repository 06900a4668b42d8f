"""Scores, decay, lifecycle, conflicts and consolidation of memories as expressions and joins. "now" is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import clamp01, days_between, polarity

#: Fixed values of the algorithms' defaults.
ADMISSION = {"salience": 0.25, "stability": 0.20, "task": 0.25, "explicit": 0.15, "noise": 0.15}
RETENTION = {"recency": 0.20, "recalls": 0.20, "salience": 0.15, "confidence": 0.15, "conflict": 0.20, "reaffirmed": 0.10}
RECALL = {"retention": 0.30, "salience": 0.15, "freshness": 0.20, "confidence": 0.15, "conflict": 0.10}
DECAY_PER_DAY = {"episodic": 0.05, "semantic": 0.02, "procedural": 0.01, "social": 0.03, "reflective": 0.02, "factual": 0.01, "profile": 0.005, "affective_state": 0.20, "preference_constraint": 0.005}
INITIAL_STRENGTH = {"episodic": 1.0, "semantic": 2.0, "procedural": 2.0, "social": 1.5, "reflective": 2.0, "factual": 3.0, "profile": 2.5, "affective_state": 0.8, "preference_constraint": 3.0}
ADMIT, SESSION, STALE, ARCHIVE = 0.65, 0.40, 0.25, 0.10


def lookup(table: dict[str, float], key: Column, default: float) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key], F.lit(default))


def admission_score() -> Column:
    """From importance, number of sources, level, confidence and a noise tag."""
    stability = F.least(F.size("source_event_ids") / 5.0, F.lit(1.0))
    task = F.least(F.col("level") / 3.0, F.lit(1.0))
    noise = F.when(F.array_contains("policy_tags", "noise"), 1.0).otherwise(0.0)
    w = ADMISSION
    return clamp01(w["salience"] * F.col("importance") + w["stability"] * stability + w["task"] * task + w["explicit"] * F.col("confidence") - w["noise"] * noise)


def bell(updated: Column, now: Column) -> Column:
    """Recency that peaks at an age of 7 days, with a spread of 14; 0.5 without a time."""
    x = (days_between(updated, now) - 7.0) / 14.0
    return F.coalesce(clamp01(F.exp(-0.5 * x * x)), F.lit(0.5))


def log_capped(n: Column) -> Column:
    return F.least(F.log1p(n.cast("double")) / F.log1p(F.lit(10.0)), F.lit(1.0))


def retention_score(updated: Column, now: Column, recalls: Column, conflict: Column, reaffirmed: Column, rates: dict[str, float]) -> Column:
    rate = F.create_map(*(F.lit(x) for kv in rates.items() for x in kv))[F.col("memory_type")]
    bonus = F.coalesce(1.0 + 0.2 * (1.0 - rate), F.lit(1.0))
    w = RETENTION
    return clamp01((w["recency"] * bell(updated, now) + w["recalls"] * log_capped(recalls) + w["salience"] * F.col("importance") + w["confidence"] * F.col("confidence") + w["conflict"] * (1.0 - conflict) + w["reaffirmed"] * F.when(reaffirmed, 1.0).otherwise(0.0)) * bonus)


def recall_score(retention: Column, conflict: Column, similarity: Column | None = None) -> Column:
    w = RECALL
    fresh = F.when(F.col("freshness") == 0, 0.5).otherwise(F.col("freshness"))
    return (F.lit(1.0) if similarity is None else similarity) + w["retention"] * retention + w["salience"] * F.col("importance") + w["freshness"] * fresh + w["confidence"] * F.col("confidence") - w["conflict"] * conflict


def next_lifecycle(current: Column, suggested: Column, retention: Column) -> Column:
    """The state machine of lifecycles; empty strings stand for no state."""
    says = suggested
    return (
        F.when(current == "", F.when(says != "", says).otherwise("candidate"))
        .when(current == "candidate", F.when(says == "active", "active").otherwise("candidate"))
        .when(current == "active", F.when(says == "compressed", "compressed").when(retention < STALE, "stale").when(says == "reinforced", "reinforced").otherwise("active"))
        .when(current == "reinforced", F.when(says == "compressed", "compressed").when(retention < STALE, "stale").otherwise("reinforced"))
        .when(current == "compressed", F.when(retention < STALE, "stale").otherwise("compressed"))
        .when(current == "stale", F.when(retention < ARCHIVE, "archived").otherwise("stale"))
        .when(current == "archived", "archived")
        .when(current == "quarantined", F.when((says != "") & (says != "quarantined"), says).otherwise("quarantined"))
        .otherwise(F.when(says != "", says).otherwise(current))
    )


def time_overlap(a_from: Column, a_to: Column, b_from: Column, b_to: Column, now: Column) -> Column:
    """Closed intervals meet; a missing start overlaps everything, a missing end is now."""
    return F.coalesce((a_from <= F.coalesce(b_to, now)) & (b_from <= F.coalesce(a_to, now)), F.lit(True))


def conflicts(memory: DataFrame, now: Column) -> DataFrame:
    """(left_id, right_id, rule, severity) of conflicting memories of an agent, the earlier one (by lsn) left.

    Four ordered rules: value contradiction, preference reversal, factual disagreement, entity conflict. Pairs are
    made inside an agent, as the rules ask for: the result itself grows with the square of an agent's memories.
    """
    cols = ["memory_id", "memory_type", "content", "confidence", "valid_from", "valid_to", "source_event_ids", "lsn"]
    left = memory.select("agent_id", *(F.col(c).alias(f"a_{c}") for c in cols))
    right = memory.select("agent_id", *(F.col(c).alias(f"b_{c}") for c in cols))
    same = F.lower(F.trim("a_content")) == F.lower(F.trim("b_content"))
    meets = time_overlap(F.col("a_valid_from"), F.col("a_valid_to"), F.col("b_valid_from"), F.col("b_valid_to"), now)
    pa, pb = polarity(F.col("a_content")), polarity(F.col("b_content"))
    rule = (
        F.when((F.col("a_memory_type") == F.col("b_memory_type")) & (F.col("a_memory_type") != "") & ~same & meets, "value")
        .when(((F.col("a_memory_type") == "preference_constraint") | (F.col("b_memory_type") == "preference_constraint")) & (pa != "neutral") & (pb != "neutral") & (pa != pb), "preference")
        .when((F.col("a_memory_type") == "factual") & (F.col("a_confidence") >= 0.9) & ~same & ~meets, "factual")
        .when(F.arrays_overlap("a_source_event_ids", "b_source_event_ids") & (F.abs(F.col("a_confidence") - F.col("b_confidence")) > 0.3), "entity")
    )
    pairs = left.join(right, "agent_id").where(F.col("a_lsn") < F.col("b_lsn")).withColumn("rule", rule).where("rule is not null")
    severity = F.when(F.col("rule") == "value", 0.8).when(F.col("rule") == "preference", 0.85).when(F.col("rule") == "factual", 0.75).otherwise(0.6)
    return pairs.select(F.col("a_memory_id").alias("left_id"), F.col("b_memory_id").alias("right_id"), "rule", severity.alias("severity"))


def max_severity(conflict: DataFrame) -> DataFrame:
    """Largest severity of each memory, on either side of a conflict."""
    return conflict.select(F.explode(F.array("left_id", "right_id")).alias("memory_id"), "severity").groupBy("memory_id").agg(F.max("severity").alias("severity"))


def ingest_state(admission: Column, conflict: Column) -> Column:
    return F.when(conflict >= 0.7, "quarantined").when(admission >= SESSION, "active").otherwise("candidate")


def merge_previous(memory: DataFrame) -> DataFrame:
    """(winner, loser): a memory against the one before it of its agent and session; the higher version wins, the new
    one on a tie. Both must be active."""
    order = W.partitionBy("agent_id", "session_id").orderBy("lsn")
    prev = memory.where("is_active").select("memory_id", "version", F.lag("memory_id").over(order).alias("before"), F.lag("version").over(order).alias("before_version")).where("before is not null")
    new_wins = F.col("version") >= F.col("before_version")
    return prev.select(F.when(new_wins, F.col("memory_id")).otherwise(F.col("before")).alias("winner"), F.when(new_wins, F.col("before")).otherwise(F.col("memory_id")).alias("loser"))


def joined(parts: Column, order: Column, sep: str) -> Column:
    """Texts of a group in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), parts.alias("p")))), lambda s: s["p"]), sep)


def consolidate(memory: DataFrame) -> DataFrame:
    """Active level-0 memories of each agent and session as one level-1 memory."""
    src = memory.where((F.col("level") == 0) & F.col("is_active"))
    return src.groupBy("agent_id", "session_id").agg((joined(F.col("content"), F.col("lsn"), " ")).alias("content"), F.count(F.lit(1)).alias("n_sources")).select(F.concat(F.lit("summary_"), "agent_id", F.lit("_"), "session_id").alias("memory_id"), F.concat("content", F.lit(" ")).alias("content"), "n_sources")


def summarise(memory: DataFrame, level: int) -> DataFrame:
    """A memory of ``level`` from two or more active ones of the level below, by agent and session."""
    src = memory.where((F.col("level") == level - 1) & F.col("is_active"))
    out = src.groupBy("agent_id", "session_id").agg(joined(F.col("content"), F.col("lsn"), " | ").alias("content"), F.round(F.avg("importance"), 9).alias("importance"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_sources"), F.min("valid_from").alias("valid_from"), F.max("lsn").alias("lsn"))
    return out.where("n_sources >= 2").withColumn("memory_type", F.lit("procedural" if level == 2 else "semantic")).withColumn("level", F.lit(level).cast("long")).withColumn("is_active", F.lit(True))


def reflect(memory: DataFrame, policy: DataFrame, now: Column) -> DataFrame:
    """Policies applied in the order of the log: quarantine, expiry, confidence override, salience decay."""
    steps = policy.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("seq", "quarantine_flag", "ttl", "confidence_override", "salience_weight"))).alias("steps"))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("valid_from").cast("timestamp"))) / F.lit(1_000_000.0)
    start = F.struct(F.col("is_active").alias("active"), F.col("lifecycle_state").alias("state"), F.col("confidence").alias("conf"), F.col("importance").alias("imp"))

    def apply(s: Column, p: Column) -> Column:
        stop = p["quarantine_flag"] & s["active"]
        expired = (p["ttl"] > 0) & s["active"] & (age > p["ttl"])
        return F.struct(
            (s["active"] & ~stop & ~expired).alias("active"),
            F.when(stop, "quarantined").when(expired, "decayed").otherwise(s["state"]).alias("state"),
            F.when(~stop & (p["confidence_override"] > 0), p["confidence_override"]).otherwise(s["conf"]).alias("conf"),
            F.when(~stop & (p["salience_weight"] > 0) & (p["salience_weight"] < 1.0), s["imp"] * p["salience_weight"]).otherwise(s["imp"]).alias("imp"),
        )

    return memory.join(steps, F.col("memory_id") == F.col("object_id")).withColumn("r", F.aggregate("steps", start, apply)).select("memory_id", F.col("r.active").alias("is_active"), F.col("r.state").alias("lifecycle_state"), F.round("r.conf", 6).alias("confidence"), F.round("r.imp", 6).alias("importance"))


def preference(content: Column) -> Column:
    low = F.lower(content)
    has = lambda *ws: F.greatest(*(F.contains(low, F.lit(w)) for w in (*ws, *ws)))
    return F.when(has("prefers", "likes", "wants"), 0.8).when(has("avoids", "dislikes", "hates"), 0.3).when(has("neutral"), 0.5).otherwise(0.6)


def profile_preferences(memory: DataFrame) -> DataFrame:
    """(agent_id, key, strength) of confident preferences; repeats of a key are averaged with what was there so far."""
    src = memory.where((F.col("memory_type") == "preference_constraint") & (F.col("confidence") >= 0.7)).select("agent_id", "lsn", F.trim(F.lower("content")).alias("key"), preference(F.col("content")).alias("s")).where("key != ''")
    values = F.transform(F.array_sort(F.collect_list(F.struct("lsn", "s"))), lambda x: x["s"])
    return src.groupBy("agent_id", "key").agg(values.alias("v")).select("agent_id", "key", F.round(F.aggregate(F.slice("v", 2, 1 << 30), F.element_at("v", 1), lambda a, x: (a + x) / 2.0), 6).alias("strength"))


def hotness(salience: Column, idle_seconds: Column, accesses: Column) -> Column:
    return salience * 0.6 + 0.3 / (idle_seconds + 1.0) + accesses * 0.001
