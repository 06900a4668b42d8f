"""Queries over memory algorithms (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import days_between, polarity
from ..operators import memory_algorithms as ma
from .fixtures import NOW
from .q_filters import now
from .q_joins import CONFLICT
from .registry import query

_NOW = f"TIMESTAMP '{NOW}'"
_DAYS = f"((epoch_us({_NOW}) - epoch_us(valid_from)) / 86400000000.0::DOUBLE)"


def _map(table: dict[str, float], default: str) -> str:
    return "CASE memory_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + f" ELSE {default} END"


_ADM = "greatest(least(0.25 * importance + 0.20 * least(len(source_event_ids) / 5.0::DOUBLE, 1.0) + 0.25 * least(level / 3.0::DOUBLE, 1.0) + 0.15 * confidence - 0.15 * (CASE WHEN list_contains(policy_tags, 'noise') THEN 1.0 ELSE 0.0 END), 1.0), 0.0)"
_BELL = f"least(exp(-0.5 * ((({_DAYS}) - 7.0) / 14.0) * ((({_DAYS}) - 7.0) / 14.0)), 1.0)"
_BONUS = f"(1.0 + 0.2 * (1.0 - ({_map(ma.DECAY_PER_DAY, 'NULL')})))"
_RET = f"greatest(least((0.20 * {_BELL} + 0.20 * least(ln(1 + k) / ln(11.0::DOUBLE), 1.0) + 0.15 * importance + 0.15 * confidence + 0.20 * (1.0 - 0.0) + 0.10 * (CASE WHEN k % 2 = 0 THEN 1.0 ELSE 0.0 END)) * coalesce({_BONUS}, 1.0), 1.0), 0.0)"


def _ret(conflict=0.0):
    return ma.retention_score(F.col("valid_from"), now(), F.col("k"), F.lit(conflict), F.col("k") % 2 == 0, ma.DECAY_PER_DAY)


@query("b1_baseline_recall", f"SELECT memory_id, round(confidence * importance * 1.5 * exp(-0.01 * {_DAYS}), 6) AS score FROM memory")
def b1(t):
    return t.memory.select("memory_id", F.round(F.col("confidence") * F.col("importance") * 1.5 * F.exp(-0.01 * days_between(F.col("valid_from"), now())), 6).alias("score"))


@query("b2_baseline_decay", f"SELECT memory_id, round(exp(-0.1 * {_DAYS}), 6) AS strength, CASE WHEN exp(-0.1 * {_DAYS}) < 0.1 THEN 'decayed' ELSE '' END AS suggested FROM memory")
def b2(t):
    s = F.exp(-0.1 * days_between(F.col("valid_from"), now()))
    return t.memory.select("memory_id", F.round(s, 6).alias("strength"), F.when(s < 0.1, "decayed").otherwise("").alias("suggested"))


@query("b3_baseline_update", "SELECT memory_id, round(CASE WHEN freshness > 0 THEN least((importance + 0.5) * freshness * 10, 5.0) ELSE importance + 0.5 END, 6) AS strength FROM memory")
def b3(t):
    return t.memory.select("memory_id", F.round(F.when(F.col("freshness") > 0, F.least((F.col("importance") + 0.5) * F.col("freshness") * 10, F.lit(5.0))).otherwise(F.col("importance") + 0.5), 6).alias("strength"))


@query("b4_baseline_summarise", "SELECT agent_id, session_id, 'semantic' AS memory_type, count(*) AS n_sources, md5(string_agg(content, ' | ' ORDER BY lsn)) AS content_md5 FROM memory WHERE level = 1 - 1 AND is_active GROUP BY agent_id, session_id HAVING count(*) >= 2")
def b4(t):
    return ma.summarise(t.memory, 1).select("agent_id", "session_id", "memory_type", "n_sources", F.md5("content").alias("content_md5"))


_REF = f"""pl AS (SELECT object_id, list({{'q': quarantine_flag, 't': ttl, 'c': confidence_override, 's': salience_weight}} ORDER BY seq) AS steps FROM policy GROUP BY object_id),
rf AS (SELECT memory_id, valid_from, steps, 0 AS i, is_active, lifecycle_state, confidence, importance FROM memory JOIN pl ON memory_id = object_id
 UNION ALL SELECT memory_id, valid_from, steps, i + 1,
  is_active AND NOT (steps[i + 1].q AND is_active) AND NOT (steps[i + 1].t > 0 AND is_active AND (epoch_us({_NOW}) - epoch_us(valid_from)) / 1000000.0::DOUBLE > steps[i + 1].t),
  CASE WHEN steps[i + 1].q AND is_active THEN 'quarantined' WHEN steps[i + 1].t > 0 AND is_active AND (epoch_us({_NOW}) - epoch_us(valid_from)) / 1000000.0::DOUBLE > steps[i + 1].t THEN 'decayed' ELSE lifecycle_state END,
  CASE WHEN NOT (steps[i + 1].q AND is_active) AND steps[i + 1].c > 0 THEN steps[i + 1].c ELSE confidence END,
  CASE WHEN NOT (steps[i + 1].q AND is_active) AND steps[i + 1].s > 0 AND steps[i + 1].s < 1 THEN importance * steps[i + 1].s ELSE importance END
 FROM rf WHERE i < len(steps))"""


@query("b5_reflect_policies", "SELECT memory_id, is_active, lifecycle_state, round(confidence, 6) AS confidence, round(importance, 6) AS importance FROM rf WHERE i = len(steps)", _REF)
def b5(t):
    return ma.reflect(t.memory, t.policy, now())


@query("b6_admission_score", f"SELECT memory_id, round({_ADM} + 1e-9, 6) AS score FROM memory")
def b6(t):
    return t.memory.select("memory_id", F.round(ma.admission_score() + 1e-9, 6).alias("score"))


@query("b7_extract_signals", "SELECT memory_id, least(len(source_event_ids) / 5.0::DOUBLE, 1.0) AS stability, round(least(level / 3.0::DOUBLE, 1.0), 6) AS task, CASE WHEN list_contains(policy_tags, 'noise') THEN 1.0::DOUBLE ELSE 0.0 END AS noise FROM memory")
def b7(t):
    return t.memory.select("memory_id", F.least(F.size("source_event_ids") / 5.0, F.lit(1.0)).alias("stability"), F.round(F.least(F.col("level") / 3.0, F.lit(1.0)), 6).alias("task"), F.when(F.array_contains("policy_tags", "noise"), 1.0).otherwise(0.0).alias("noise"))


@query("b8_retention_score", f"SELECT memory_id, round({_RET}, 6) AS score FROM memory")
def b8(t):
    return t.memory.select("memory_id", F.round(_ret(), 6).alias("score"))


@query("b9_recency_factor", f"SELECT memory_id, round({_BELL}, 6) AS factor FROM memory")
def b9(t):
    return t.memory.select("memory_id", F.round(ma.bell(F.col("valid_from"), now()), 6).alias("factor"))


@query("b10_log1p_capped", "SELECT event_id, round(least(ln(1 + k) / ln(11.0::DOUBLE), 1.0), 6) AS value FROM ev")
def b10(t):
    return t.ev.select("event_id", F.round(ma.log_capped(F.col("k")), 6).alias("value"))


@query("b11_bank_recall", f"SELECT memory_id, round(1.0 + 0.30 * ({_RET}) + 0.15 * importance + 0.20 * freshness + 0.15 * confidence + 1e-9, 6) AS score FROM memory WHERE lifecycle_state IN ('active', 'reinforced') OR (lifecycle_state = 'stale' AND ({_RET}) >= 0.10)")
def b11(t):
    allowed = F.col("lifecycle_state").isin("active", "reinforced") | ((F.col("lifecycle_state") == "stale") & (_ret() >= ma.ARCHIVE))
    return t.memory.where(allowed).select("memory_id", F.round(ma.recall_score(_ret(), F.lit(0.0)) + 1e-9, 6).alias("score"))


_RATE = _map(ma.DECAY_PER_DAY, "0.05")


@query("b12_bank_decay", f"SELECT memory_id, round(importance * exp(-({_RATE}) * {_DAYS}), 6) AS retention, CASE WHEN lifecycle_state IN ('quarantined', 'archived') THEN lifecycle_state WHEN importance * exp(-({_RATE}) * {_DAYS}) < 0.10 THEN 'archived' WHEN importance * exp(-({_RATE}) * {_DAYS}) < 0.25 THEN 'stale' ELSE lifecycle_state END AS suggested FROM memory")
def b12(t):
    r = F.col("importance") * F.exp(-ma.lookup(ma.DECAY_PER_DAY, F.col("memory_type"), 0.05) * days_between(F.col("valid_from"), now()))
    state = F.when(F.col("lifecycle_state").isin("quarantined", "archived"), F.col("lifecycle_state")).when(r < ma.ARCHIVE, "archived").when(r < ma.STALE, "stale").otherwise(F.col("lifecycle_state"))
    return t.memory.select("memory_id", F.round(r, 6).alias("retention"), state.alias("suggested"))


_SEV = "sv2 AS (SELECT memory_id, max(severity) AS severity FROM (SELECT left_id AS memory_id, severity FROM cs UNION ALL SELECT right_id, severity FROM cs) GROUP BY memory_id)"


@query("b13_bank_ingest", f"SELECT m.memory_id, round({_ADM} + 1e-9, 6) AS retention, CASE WHEN coalesce(severity, 0) >= 0.7 THEN 'quarantined' WHEN {_ADM} >= 0.4 THEN 'active' ELSE 'candidate' END AS suggested, {_map(ma.INITIAL_STRENGTH, '1.0')} AS strength FROM memory m LEFT JOIN (SELECT right_id, max(severity) AS severity FROM cs GROUP BY right_id) ON m.memory_id = right_id", CONFLICT)
def b13(t):
    known = ma.conflicts(t.memory, now()).groupBy(F.col("right_id").alias("memory_id")).agg(F.max("severity").alias("severity"))
    return t.memory.join(known, "memory_id", "left").select("memory_id", F.round(ma.admission_score() + 1e-9, 6).alias("retention"), ma.ingest_state(ma.admission_score(), F.coalesce("severity", F.lit(0.0))).alias("suggested"), ma.lookup(ma.INITIAL_STRENGTH, F.col("memory_type"), 1.0).alias("strength"))


@query("b14_evaluate_pair", "SELECT rule, severity, count(*) AS n FROM cs GROUP BY ALL", CONFLICT)
def b14(t):
    return ma.conflicts(t.memory, now()).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("b15_max_severity", "SELECT memory_id, severity FROM sv2", CONFLICT + ", " + _SEV)
def b15(t):
    return ma.max_severity(ma.conflicts(t.memory, now()))


_WORD = "['Yes', ' no ', 'never', 'maybe', 'agree', '0', 'true']"


@query("b16_polarity", f"SELECT event_id, CASE WHEN lower(trim({_WORD}[k % 7 + 1])) IN ('yes', 'true', '1', 'confirm', 'agree') THEN 'positive' WHEN lower(trim({_WORD}[k % 7 + 1])) IN ('no', 'false', '0', 'deny', 'disagree', 'never') THEN 'negative' ELSE 'neutral' END AS polarity FROM ev")
def b16(t):
    words = F.array(*(F.lit(w) for w in ("Yes", " no ", "never", "maybe", "agree", "0", "true")))
    return t.ev.select("event_id", polarity(F.element_at(words, (F.col("k") % 7 + 1).cast("int"))).alias("polarity"))


_SAYS = "['', 'active', 'reinforced', 'compressed'][k % 4 + 1]"


@query("b17_next_lifecycle", f"""SELECT memory_id, CASE lifecycle_state WHEN 'candidate' THEN CASE WHEN {_SAYS} = 'active' THEN 'active' ELSE 'candidate' END
 WHEN 'active' THEN CASE WHEN {_SAYS} = 'compressed' THEN 'compressed' WHEN importance < 0.25 THEN 'stale' WHEN {_SAYS} = 'reinforced' THEN 'reinforced' ELSE 'active' END
 WHEN 'reinforced' THEN CASE WHEN {_SAYS} = 'compressed' THEN 'compressed' WHEN importance < 0.25 THEN 'stale' ELSE 'reinforced' END
 WHEN 'compressed' THEN CASE WHEN importance < 0.25 THEN 'stale' ELSE 'compressed' END WHEN 'stale' THEN CASE WHEN importance < 0.10 THEN 'archived' ELSE 'stale' END WHEN 'archived' THEN 'archived'
 WHEN 'quarantined' THEN CASE WHEN {_SAYS} <> '' THEN {_SAYS} ELSE 'quarantined' END ELSE CASE WHEN {_SAYS} <> '' THEN {_SAYS} ELSE lifecycle_state END END AS next FROM memory""")
def b17(t):
    says = F.element_at(F.array(*(F.lit(s) for s in ("", "active", "reinforced", "compressed"))), (F.col("k") % 4 + 1).cast("int"))
    return t.memory.select("memory_id", ma.next_lifecycle(F.col("lifecycle_state"), says, F.col("importance")).alias("next"))


@query("b19_graph_ingest", "SELECT memory_id, round(least(0.4 + 0.3 * confidence + 0.3 * importance, 1.0), 6) AS strength, round(least(0.5 + 0.2 * confidence + 0.2 * freshness + 0.1 * importance, 1.0), 6) AS retention FROM memory")
def b19(t):
    c, i, f = F.col("confidence"), F.col("importance"), F.col("freshness")
    return t.memory.select("memory_id", F.round(F.least(0.4 + 0.3 * c + 0.3 * i, F.lit(1.0)), 6).alias("strength"), F.round(F.least(0.5 + 0.2 * c + 0.2 * f + 0.1 * i, F.lit(1.0)), 6).alias("retention"))


@query("b20_graph_decay", "SELECT memory_id, round(importance * pow(0.98, k), 6) AS strength, round(confidence * pow(0.97, k), 6) AS retention, CASE WHEN confidence * pow(0.97, k) < 0.15 THEN 'archived' WHEN confidence * pow(0.97, k) < 0.30 THEN 'stale' ELSE lifecycle_state END AS suggested FROM memory")
def b20(t):
    r = F.col("confidence") * F.pow(F.lit(0.97), F.col("k"))
    return t.memory.select("memory_id", F.round(F.col("importance") * F.pow(F.lit(0.98), F.col("k")), 6).alias("strength"), F.round(r, 6).alias("retention"), F.when(r < 0.15, "archived").when(r < 0.30, "stale").otherwise(F.col("lifecycle_state")).alias("suggested"))


@query("b21_conflict_merge", "SELECT CASE WHEN version >= bv THEN memory_id ELSE b END AS winner, CASE WHEN version >= bv THEN b ELSE memory_id END AS loser FROM (SELECT *, lag(memory_id) OVER w AS b, lag(version) OVER w AS bv FROM memory WHERE is_active WINDOW w AS (PARTITION BY agent_id, session_id ORDER BY lsn)) WHERE b IS NOT NULL")
def b21(t):
    return ma.merge_previous(t.memory)


@query("b24_hotness", f"SELECT memory_id, round(importance * 0.6 + 0.3 / ((epoch_us({_NOW}) - epoch_us(valid_from)) / 1000000.0::DOUBLE + 1.0) + k * 0.001, 6) AS hotness FROM memory")
def b24(t):
    idle = days_between(F.col("valid_from"), now()) * 86400.0
    return t.memory.select("memory_id", F.round(ma.hotness(F.col("importance"), idle, F.col("k")), 6).alias("hotness"))
