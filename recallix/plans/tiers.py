"""Search over tiers of one corpus: hot (bounded, by words), warm (by words and sparse vectors), cold (archived)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import cold_lexical_score, recency_share
from ..operators.retrieval import fuse_rrf, merge_ordered, top_k
from ..sources.scratch import stored
from .planner import lexical_channel, sparse_channel

RECENCY = 0.1  # fixed value: what recency counts beside the words of an archived memory


def cold_candidates(cold: DataFrame, query: str, limit: int) -> DataFrame:
    """(object_id, lexical, recency, score, rank) of the best archived memories: word score, and a tenth of the version's
    share of the latest one among the hits. A blank query takes all rows by recency. Every row is scored, so there is
    no early stop that could lose one; ties go to the later version, then the smaller id."""
    lexical = cold_lexical_score(F.lit(query), F.col("content"), F.col("summary")) if query.strip() else F.lit(1.0)
    hits = cold.select(F.col("memory_id").alias("object_id"), "version", lexical.alias("lexical")).where("lexical > 0")
    latest = hits.agg(F.max("version").alias("latest"))
    share = recency_share(F.col("version"), F.col("latest"))
    scored = hits.crossJoin(F.broadcast(latest)).withColumn("recency", share).withColumn("score", F.round(F.col("lexical") + RECENCY * F.col("recency"), 6))
    order = [F.col("score").desc(), F.col("version").desc(), F.col("object_id")]
    best = scored.orderBy(*order).limit(limit)
    return best.select("object_id", "lexical", "recency", "score", F.row_number().over(W.orderBy(*order)).cast("long").alias("rank"))


def resolve_cold(requests: DataFrame, near: DataFrame, lexical: DataFrame) -> DataFrame:
    """(request, mode, object_id, rank): the vector hits of each request that has any, else the hits by words, which are a
    top-k list. ``near`` has request, object_id, rank; ``lexical`` object_id, rank."""
    without = requests.join(near.select("request").distinct(), "request", "left_anti")
    words = without.crossJoin(F.broadcast(lexical.select("object_id", "rank")))
    return near.select("request", F.lit("vector").alias("mode"), "object_id", "rank").unionByName(words.select("request", F.lit("lexical").alias("mode"), "object_id", "rank"))


def warm_hits(warm: DataFrame, query: str, k: int, channel: int = 30) -> DataFrame:
    return top_k(fuse_rrf([lexical_channel(warm, query, channel), sparse_channel(warm, query, channel)]), "rrf", k)


def tiered_search(docs: DataFrame, query: str, k: int, include_cold: bool = False) -> DataFrame:
    """(object_id, tier, rank) of the k best. ``docs`` has a column tier; the warm tier holds the hot rows too.

    A hot tier that fills the page answers alone and the others aren't read; with ``include_cold`` archived hits follow
    the hot ones as far as there is room. Otherwise the lists of all tiers are fused by rank."""
    hot = stored(lexical_channel(docs.where("tier = 'hot'"), query, k), "hot-hits")
    full = hot.count() >= k > 0
    if full and not include_cold:
        return hot.select("object_id", F.lit("hot").alias("tier"), "rank")
    cold = cold_candidates(docs.where("tier = 'cold'"), query, k) if include_cold else None
    if full:
        return merge_ordered(hot, cold, k).select("object_id", F.lit("hot+cold").alias("tier"), F.col("place").alias("rank"))
    lists = [hot, warm_hits(docs.where("tier != 'cold'"), query, k), *([cold] if include_cold else [])]
    return top_k(fuse_rrf(lists), "rrf", k).select("object_id", F.lit("hot+warm+cold" if include_cold else "hot+warm").alias("tier"), "rank")
