"""Queries over the tiers of a corpus: documents are hot, warm or cold by their importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as rt
from .fixtures import QUERY
from .planner import lexical_channel, sparse_channel
from .q_retrieval import _COLD, _SPARSE, _VEC
from .registry import query
from .tiers import cold_candidates, resolve_cold, tiered_search, warm_hits

_TIERS = (
    _SPARSE
    + f""",
dt AS (SELECT memory_id, version, content, summary, CASE WHEN importance >= 0.8 THEN 'hot' WHEN importance >= 0.3 THEN 'warm' ELSE 'cold' END AS tier FROM doc),
hl AS (SELECT object_id, row_number() OVER (ORDER BY score DESC, object_id) AS rank FROM lx JOIN dt ON memory_id = object_id WHERE score > 0 AND tier = 'hot'),
wl AS (SELECT object_id, row_number() OVER (ORDER BY score DESC, object_id) AS rank FROM lx JOIN dt ON memory_id = object_id WHERE score > 0 AND tier <> 'cold' QUALIFY rank <= 30),
ws AS (SELECT object_id, row_number() OVER (ORDER BY score DESC, object_id) AS rank FROM ss JOIN dt ON memory_id = object_id WHERE score > 0 AND tier <> 'cold' QUALIFY rank <= 30),
wf AS (SELECT object_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf FROM (SELECT * FROM wl UNION ALL SELECT * FROM ws) GROUP BY object_id),
wr AS (SELECT object_id, row_number() OVER (ORDER BY rrf DESC, object_id) AS rank FROM wf),
cb AS (SELECT memory_id AS object_id, version, {_COLD} AS lexical FROM dt WHERE tier = 'cold'),
cc AS (SELECT object_id, version, lexical, version / max(version) OVER () AS recency FROM cb WHERE lexical > 0),
cs AS (SELECT *, round(lexical + 0.1 * recency, 6) AS score FROM cc),
cl AS (SELECT *, row_number() OVER (ORDER BY score DESC, version DESC, object_id) AS rank FROM cs)"""
)


def _docs(t):
    return t.doc.withColumn("tier", F.when(F.col("importance") >= 0.8, "hot").when(F.col("importance") >= 0.3, "warm").otherwise("cold"))


def _request_sql(name: str, k: int, cold: bool) -> str:
    full = f"(SELECT count(*) FROM hl) >= {k}"
    lists = f"SELECT object_id, rank FROM hl WHERE rank <= {k} UNION ALL SELECT object_id, rank FROM wr WHERE rank <= {k}" + (f" UNION ALL SELECT object_id, rank FROM cl WHERE rank <= {k}" if cold else "")
    end = "+cold" if cold else ""
    return f"""SELECT '{name}' AS request, object_id, 'hot{end}' AS tier, rank FROM hl WHERE rank <= {k} AND {full}
UNION ALL SELECT '{name}', object_id, 'hot+warm{end}', rank FROM (SELECT object_id, row_number() OVER (ORDER BY rrf DESC, object_id) AS rank FROM (SELECT object_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf FROM ({lists}) GROUP BY object_id)) WHERE rank <= {k} AND NOT {full}"""


#: Small pages are filled by the hot tier, pages of a million are not.
_REQUESTS = (("page", 5, False), ("page and cold", 5, True), ("all", 1_000_000, False), ("all and cold", 1_000_000, True))


@query("r7_cold_candidates", "SELECT object_id, round(lexical, 6) AS lexical, round(recency, 6) AS recency, score, rank FROM cl WHERE rank <= 100", _TIERS)
def r7(t):
    best = cold_candidates(_docs(t).where("tier = 'cold'"), QUERY, 100)
    return best.select("object_id", F.round("lexical", 6).alias("lexical"), F.round("recency", 6).alias("recency"), "score", "rank")


@query("r20_rrf_tiers", "SELECT object_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf FROM (SELECT object_id, rank FROM hl WHERE rank <= 25 UNION ALL SELECT object_id, rank FROM wr WHERE rank <= 25 UNION ALL SELECT object_id, rank FROM cl WHERE rank <= 25) GROUP BY object_id ORDER BY rrf DESC, object_id LIMIT 25", _TIERS)
def r20(t):
    docs = _docs(t)
    lists = [lexical_channel(docs.where("tier = 'hot'"), QUERY, 25), warm_hits(docs.where("tier != 'cold'"), QUERY, 25), cold_candidates(docs.where("tier = 'cold'"), QUERY, 25)]
    return rt.top_k(rt.fuse_rrf(lists), "rrf", 25).select("object_id", "rrf")


@query("r22_tiered_search", " UNION ALL ".join(_request_sql(*r) for r in _REQUESTS), _TIERS)
def r22(t):
    out = None
    for name, k, cold in _REQUESTS:
        one = tiered_search(_docs(t), QUERY, k, cold).select(F.lit(name).alias("request"), "object_id", "tier", "rank")
        out = one if out is None else out.unionByName(one)
    return out


_COLD_VECTORS = f"""{_TIERS},
cv AS (SELECT request, object_id, rank FROM (SELECT a.vec_id AS request, 'mem_' || b.vec_id AS object_id, {_VEC} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_VEC} DESC, b.vec_id) AS rank
  FROM embeddings a, embeddings b JOIN dt ON memory_id = 'mem_' || b.vec_id WHERE a.vec_id % 100 = 0 AND tier = 'cold') WHERE rank <= 10 AND score > 0.3),
cq AS (SELECT vec_id AS request FROM embeddings WHERE vec_id % 100 = 0 UNION ALL SELECT -1)"""


@query("r23_cold_fallback", "SELECT request, 'vector' AS mode, object_id, rank FROM cv UNION ALL SELECT request, 'lexical', object_id, rank FROM cq, cl WHERE rank <= 10 AND request NOT IN (SELECT request FROM cv)", _COLD_VECTORS)
def r23(t):
    """Request -1 has no vector; the others fall back where no archived vector is near."""
    cold = _docs(t).where("tier = 'cold'")
    asked = t.embeddings.where("vec_id % 100 = 0")
    archived = t.embeddings.withColumn("memory_id", F.concat(F.lit("mem_"), "vec_id")).join(cold.select("memory_id"), "memory_id", "left_semi")
    near = rt.knn(archived, asked, 10, "ip").where("score > 0.3").select(F.col("query_id").alias("request"), F.concat(F.lit("mem_"), "object_id").alias("object_id"), "rank")
    requests = asked.select(F.col("vec_id").alias("request")).unionByName(t.spark.range(-1, 0).select(F.col("id").alias("request")))
    return resolve_cold(requests, near, cold_candidates(cold, QUERY, 10))


@query("e5_embedding_provenance", "SELECT object_id, round(1.0::DOUBLE / (60 + rank), 12) AS rrf, rank, 'embedding_runtime_family=tfidf, embedding_runtime_dim=256, cross_dim_fusion=rrf_result_layer, cross_dim_candidates=1' AS provenance FROM (SELECT object_id, row_number() OVER (ORDER BY rrf DESC, object_id) AS rank FROM fu) WHERE rank <= 10", _SPARSE)
def e5(t):
    """An answer's ids fused once more as a list of their own, beside what the vectors were made by."""
    answer = rt.top_k(rt.fuse_rrf([lexical_channel(t.doc, QUERY, 30), sparse_channel(t.doc, QUERY, 30)]), "rrf", 10)
    lists = [answer]
    facts = {"embedding_runtime_family": "tfidf", "embedding_runtime_dim": 256, "cross_dim_fusion": "rrf_result_layer", "cross_dim_candidates": len(lists)}
    return rt.top_k(rt.fuse_rrf(lists), "rrf", 10).withColumn("provenance", F.lit(", ".join(f"{k}={v}" for k, v in facts.items()))).select("object_id", "rrf", "rank", "provenance")
