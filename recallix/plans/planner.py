"""The query façade: a request as data, and the pipeline of DataFrame operators that answers it.

A plan is one lazy DataFrame, so Catalyst sees the whole query; only the sparse channel finds the words of a request's
terms beforehand."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import lexical_score
from ..operators import filters as fl
from ..operators import graph
from ..operators.retrieval import final_scores, fuse_rrf, mark_seeds, sparse_postings, sparse_search, sparse_terms, top_k


@dataclass(frozen=True)
class QueryRequest:
    """What a user asks for. Empty values mean no restriction."""

    query_text: str = ""
    top_k: int = 10
    namespace: str = ""
    agent_id: str = ""
    session_id: str = ""
    dataset_name: str = ""
    time_from: str = ""
    time_to: str = ""
    mode: str = "default"  # default, filter_only, subgraph, multi_hop, proof_trace, aggregate, slice
    max_hops: int = 1
    edge_types: Sequence[str] = ()
    min_weight: float = 0.0
    group_by: Sequence[str] = ()
    filter_first: bool = False
    filters: Sequence[str] = field(default_factory=lambda: ("scope", "visibility", "acl", "ttl_active", "quarantine_excluded", "salience_threshold"))


def order_columns(spec: str) -> list[Column]:
    """Sort keys from "field:asc, other:desc, json.$.path:type:desc"; nulls come first, as in the request language."""
    out = []
    for part in (p.strip() for p in spec.split(",") if p.strip()):
        bits = part.split(":")
        name, direction = bits[0], (bits[-1].lower() if len(bits) > 1 and bits[-1].lower() in ("asc", "desc") else "asc")
        if ".$" in name:
            column, path = name.split(".$", 1)
            value = F.get_json_object(column, "$" + path)
            kinds = [b for b in bits[1:] if b.lower() not in ("asc", "desc")]
            value = value.cast(kinds[0]) if kinds else value
        else:
            value = F.col(name)
        out.append(value.desc_nulls_first() if direction == "desc" else value.asc_nulls_first())
    return out


def lexical_channel(docs: DataFrame, query: str, k: int) -> DataFrame:
    scored = docs.select(F.col("memory_id").alias("object_id"), F.round(lexical_score(F.lit(query), F.col("content")), 6).alias("score")).where("score > 0")
    return top_k(scored, "score", k)


def sparse_channel(docs: DataFrame, query: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    asked = sparse_terms(spark.createDataFrame([("q", query)], "memory_id string, content string"), "memory_id", "content")
    return top_k(sparse_search(sparse_postings(docs, "memory_id", "content", asked), F.broadcast(asked)), "score", k)


def plan(request: QueryRequest, docs: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """The answer to a request over memories (memory_id, content, namespace, importance, freshness, confidence,
    quarantine) and, for graph modes, edges."""
    rows = docs.where(fl.equal_when_set(**{c: v for c, v in (("namespace", request.namespace), ("agent_id", request.agent_id), ("session_id", request.session_id), ("dataset_name", request.dataset_name)) if v}))
    if request.time_from:
        rows = rows.where(F.col("valid_from") >= F.lit(request.time_from).cast("timestamp_ntz"))
    if request.time_to:
        rows = rows.where(F.col("valid_from") <= F.lit(request.time_to).cast("timestamp_ntz"))
    if request.mode == "slice":
        return rows
    if request.mode == "aggregate":
        return rows.groupBy(*request.group_by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("importance"), 6).alias("importance"))
    if request.mode in ("subgraph", "multi_hop", "proof_trace"):
        seeds = rows.select(F.col("memory_id").alias("id"))
        directed = request.mode == "proof_trace"
        return graph.trace(seeds, edges, request.max_hops if not directed else 8, directed, request.edge_types, request.min_weight)
    if request.filter_first:
        rows = rows.where(~F.col("quarantine"))
    wide = request.top_k * 3
    if request.mode == "filter_only":
        best = top_k(rows.withColumnRenamed("memory_id", "object_id"), "importance", wide)
        fused = best.select("object_id", F.round(1.0 / (60 + F.col("rank")), 12).alias("rrf"))
    else:
        fused = fuse_rrf([lexical_channel(rows, request.query_text, wide), sparse_channel(rows, request.query_text, wide)])
    meta = docs.select("memory_id", "importance", "freshness", "confidence", "quarantine", "version")
    kept = F.broadcast(fused).join(meta, F.col("object_id") == F.col("memory_id")).where(~F.col("quarantine"))
    ranked = top_k(final_scores(kept), "final_score", request.top_k)
    return mark_seeds(ranked).select("object_id", "rrf", "final_score", "seed_score", "is_seed", "rank")
