"""Queries over search, fusion and ranking (R) and the flagship query."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import cold_lexical_score, fields, fnv1a, lexical_score, recency_share
from ..operators import retrieval as rt
from ..sources.scratch import stored
from .fixtures import NOW, QUERY
from .planner import QueryRequest, lexical_channel, plan, sparse_channel
from .q_filters import now
from .registry import query

_Q = f"'{QUERY}'"
_WORDS = "['" + "', '".join(QUERY.split()) + "']"
_LEX = f"CASE WHEN content = '' THEN 0 WHEN contains(lower(content), {_Q}) THEN 1.0 ELSE len(list_filter({_WORDS}, lambda p: contains(lower(content), p))) / {len(QUERY.split())}.0::DOUBLE END"
_COLD = f"CASE WHEN contains(lower(content), {_Q}) OR contains(lower(summary), {_Q}) THEN 1.0 ELSE len(list_filter({_WORDS}, lambda p: list_contains(regexp_split_to_array(lower(content), '\\s+'), p))) / {len(QUERY.split())}.0::DOUBLE END"
_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, (octet_length(encode(w)) + 1)::BIGINT), lambda i: ('0x' || substr(hex(encode(w)), (2 * i - 1)::BIGINT, 2))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"
_SPARSE = rf"""tw AS (SELECT memory_id, unnest(list_filter(regexp_split_to_array(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\s+'), lambda x: x <> '')) AS w FROM doc),
tc AS (SELECT memory_id, w, count(*) AS tf FROM tw GROUP BY ALL), tn AS (SELECT memory_id, sum(tf) AS n FROM tc GROUP BY memory_id),
th AS (SELECT w, {_FNV} % 30000 AS term FROM (SELECT DISTINCT w FROM tc)),
sp AS (SELECT tc.memory_id AS object_id, term, CAST(sum(tf) AS DOUBLE) / max(n) AS weight FROM tc JOIN th ON tc.w = th.w JOIN tn ON tn.memory_id = tc.memory_id GROUP BY tc.memory_id, term),
qw AS (SELECT w, count(*) AS tf FROM (SELECT unnest({_WORDS}) AS w) GROUP BY w), qh AS (SELECT {_FNV} % 30000 AS term, tf / {len(QUERY.split())}.0::DOUBLE AS weight FROM qw), qs AS (SELECT term, sum(weight) AS weight FROM qh GROUP BY term),
ss AS (SELECT object_id, round(sum(sp.weight * qs.weight), 12) AS score FROM sp JOIN qs ON sp.term = qs.term GROUP BY object_id),
lx AS (SELECT memory_id AS object_id, round({_LEX}, 6) AS score FROM doc),
lr AS (SELECT object_id, row_number() OVER (ORDER BY score DESC, object_id) AS rank FROM lx WHERE score > 0 QUALIFY rank <= 30),
sr AS (SELECT object_id, row_number() OVER (ORDER BY score DESC, object_id) AS rank FROM ss WHERE score > 0 QUALIFY rank <= 30),
fu AS (SELECT object_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf FROM (SELECT * FROM lr UNION ALL SELECT * FROM sr) GROUP BY object_id),
fs AS (SELECT f.object_id, rrf, round(rrf * greatest(importance, 0.01) * greatest(freshness, 0.01) * greatest(confidence, 0.01), 12) AS final_score FROM fu f JOIN doc d ON f.object_id = d.memory_id WHERE NOT quarantine),
rk AS (SELECT *, row_number() OVER (ORDER BY final_score DESC, object_id) AS rank FROM fs QUALIFY rank <= 10),
sd AS (SELECT *, max(final_score) OVER () AS top FROM rk)"""
_SEEDED = "SELECT object_id, rrf, final_score, CASE WHEN final_score >= 1e-4 AND top >= 1e-4 THEN round(final_score / top, 6) ELSE 0 END AS seed_score, final_score >= 1e-4 AND top >= 1e-4 AND round(final_score / top, 6) >= 0.5 AS is_seed, rank FROM sd"


@query("hybrid_retrieve", _SEEDED, _SPARSE)
def hybrid_retrieve(t):
    return plan(QueryRequest(query_text=QUERY, top_k=10), t.doc)


@query("r1_lexical_score", f"SELECT memory_id, round({_LEX}, 6) AS score FROM doc")
def r1(t):
    return t.doc.select("memory_id", F.round(lexical_score(F.lit(QUERY), F.col("content")), 6).alias("score"))


@query("r2_lexical_search", "SELECT object_id, rank FROM lr", _SPARSE)
def r2(t):
    return lexical_channel(t.doc, QUERY, 30).select("object_id", "rank")


@query("r3_cold_lexical", f"SELECT memory_id, round({_COLD}, 6) AS score FROM doc")
def r3(t):
    return t.doc.select("memory_id", F.round(cold_lexical_score(F.lit(QUERY), F.col("content"), F.col("summary")), 6).alias("score"))


_VEC = "round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"


@query("r4_cold_vector_search", f"SELECT query_id, object_id, score, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS object_id, {_VEC} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_VEC} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b) WHERE rank <= 5 AND score > 0.2")
def r4(t):
    return rt.knn(t.embeddings, t.embeddings, 5, "ip").where("score > 0.2")


@query("r5_combine_cold", f"SELECT memory_id, round(0.4 * importance + 0.5 * ({_COLD}) + 0.1 * (version / max(version) OVER ()), 6) AS score FROM doc")
def r5(t):
    top = t.doc.agg(F.max("version").alias("latest"))
    cold = cold_lexical_score(F.lit(QUERY), F.col("content"), F.col("summary"))
    return t.doc.crossJoin(F.broadcast(top)).select("memory_id", F.round(0.4 * F.col("importance") + 0.5 * cold + 0.1 * recency_share(F.col("version"), F.col("latest")), 6).alias("score"))


@query("r6_recency_score", "SELECT memory_id, round(least(version / max(version) OVER (), 1.0), 6) AS score FROM doc")
def r6(t):
    top = t.doc.agg(F.max("version").alias("latest"))
    return t.doc.crossJoin(F.broadcast(top)).select("memory_id", F.round(recency_share(F.col("version"), F.col("latest")), 6).alias("score"))


def _knn_sql(score: str) -> str:
    return f"SELECT query_id, object_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, object_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS object_id, round({score}, 6) + 0.0 AS score FROM embeddings a, embeddings b)) WHERE rank <= 10"


@query("r8_inner_product", _knn_sql("list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"))
def r8(t):
    return rt.knn(t.embeddings, t.embeddings, 10, "ip")


@query("r9_squared_l2", "SELECT vec_id, round(list_inner_product(d, d), 6) AS l2 FROM (SELECT a.vec_id, list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), m), lambda x: x[1] - x[2]) AS d FROM embeddings a, (SELECT list(c ORDER BY i) AS m FROM (SELECT i, avg(CAST(embedding AS DOUBLE[])[i]) AS c FROM embeddings, range(1, 65) r(i) GROUP BY i)))")
def r9(t):
    from ..functions.columns import squared_l2

    mean = t.embeddings.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("m"))
    return t.embeddings.crossJoin(F.broadcast(mean)).select("vec_id", F.round(squared_l2(F.col("embedding"), F.col("m")), 6).alias("l2"))


@query("r10_cosine", _knn_sql("list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"))
def r10(t):
    return rt.knn(t.embeddings, t.embeddings, 10, "cosine")


@query("r11_batch_search", f"SELECT query_id, object_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, object_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS object_id, {_VEC} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)) WHERE rank <= 20")
def r11(t):
    return rt.knn(t.embeddings, t.embeddings.where("vec_id % 100 = 0"), 20, "ip")


@query("r13_inverted_lists")
def r13(t):
    """Approximate; tests hold its recall against the exact search."""
    return rt.InvertedLists(t.embeddings, lists=16).search(t.embeddings.where("vec_id % 100 = 0"), 10, probes=8)


@query("r15_text_to_sparse", "SELECT object_id, term, round(weight, 9) AS weight FROM sp", _SPARSE)
def r15(t):
    return rt.sparse_terms(t.doc, "memory_id", "content").select("object_id", "term", F.round("weight", 9).alias("weight"))


@query("r16_sparse_search", "SELECT object_id, rank FROM sr", _SPARSE)
def r16(t):
    return sparse_channel(t.doc, QUERY, 30).select("object_id", "rank")


@query("r17_fnv_hash", rf"SELECT w AS word, {_FNV} AS hash FROM (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w FROM benchmark)")
def r17(t):
    words = t.benchmark.select(F.explode(fields(F.col("text"))).alias("word")).distinct()
    return words.select("word", fnv1a(F.col("word")).alias("hash"))


_TFIDF = rf"""vw AS (SELECT memory_id, unnest(regexp_extract_all(lower(content), '[a-z0-9]{{2,}}|\p{{Han}}')) AS w FROM doc), vc AS (SELECT memory_id, w, count(*) AS c FROM vw GROUP BY ALL), vn AS (SELECT memory_id, sum(c) AS n FROM vc GROUP BY memory_id),
vh AS (SELECT w, {_FNV} % 256 AS bucket FROM (SELECT DISTINCT w FROM vc)), vt AS (SELECT vc.memory_id, bucket, CAST(sum(c) AS DOUBLE) / max(n) AS tf FROM vc JOIN vh ON vc.w = vh.w JOIN vn ON vn.memory_id = vc.memory_id GROUP BY vc.memory_id, bucket),
vd AS (SELECT bucket, count(*) AS df FROM vt GROUP BY bucket), vv AS (SELECT memory_id, vt.bucket, tf * (ln(((SELECT count(*) FROM vn) + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1.0) AS v FROM vt JOIN vd ON vt.bucket = vd.bucket)"""


@query("r18_tfidf_embedder", "SELECT memory_id AS object_id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY memory_id)), 6) AS value FROM vv", _TFIDF)
def r18(t):
    return rt.tfidf(t.doc, "memory_id", "content")


@query("r19_rrf_fusion", "SELECT object_id, rrf FROM fu", _SPARSE)
def r19(t):
    return rt.fuse_rrf([lexical_channel(t.doc, QUERY, 30), sparse_channel(t.doc, QUERY, 30)])


_TIER = "tr AS (SELECT memory_id AS object_id, CASE WHEN importance >= 0.8 THEN 'hot' WHEN importance >= 0.3 THEN 'warm' ELSE 'cold' END AS tier, confidence FROM memory), tk AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY confidence DESC, object_id) AS rank FROM tr QUALIFY rank <= 25)"


def _tiers(t):
    tier = F.when(F.col("importance") >= 0.8, "hot").when(F.col("importance") >= 0.3, "warm").otherwise("cold")
    return rt.top_k_per(t.memory.select(F.col("memory_id").alias("object_id"), tier.alias("tier"), "confidence"), ["tier"], "confidence", 25)


@query("r21_merge_outputs", "SELECT object_id, row_number() OVER (ORDER BY tier, rank, object_id) AS place FROM (SELECT * FROM tk WHERE tier IN ('cold', 'hot')) QUALIFY place <= 40", _TIER)
def r21(t):
    tk = _tiers(t)
    return rt.merge_ordered(tk.where("tier = 'cold'"), tk.where("tier = 'hot'"), 40)


@query("r24_hybrid_search", "SELECT object_id, rrf, row_number() OVER (ORDER BY rrf DESC, object_id) AS rank FROM fu QUALIFY rank <= 15", _SPARSE)
def r24(t):
    return rt.top_k(rt.fuse_rrf([lexical_channel(t.doc, QUERY, 30), sparse_channel(t.doc, QUERY, 30)]), "rrf", 15)


@query("r25_filter_only", "SELECT memory_id AS object_id, row_number() OVER (ORDER BY importance DESC, memory_id) AS rank FROM doc QUALIFY rank <= 30")
def r25(t):
    return rt.top_k(t.doc.withColumnRenamed("memory_id", "object_id"), "importance", 30).select("object_id", "rank")


@query("r26_final_scores", "SELECT object_id, final_score FROM fs", _SPARSE)
def r26(t):
    fused = rt.fuse_rrf([lexical_channel(t.doc, QUERY, 30), sparse_channel(t.doc, QUERY, 30)])
    return rt.final_scores(fused.join(t.doc.where("not quarantine"), F.col("object_id") == F.col("memory_id"))).select("object_id", "final_score")


@query("r27_mark_seeds", "SELECT memory_id, round(importance / max(importance) OVER (), 6) AS seed_score, round(importance / max(importance) OVER (), 6) >= 0.5 AND importance >= 1e-4 AS is_seed FROM (SELECT * FROM memory WHERE importance >= 1e-4)")
def r27(t):
    return rt.mark_seeds(t.memory.where("importance >= 1e-4").withColumn("final_score", F.col("importance"))).select("memory_id", "seed_score", "is_seed")


@query("r28_retrieve", _SEEDED, _SPARSE)
def r28(t):
    return plan(QueryRequest(query_text=QUERY, top_k=10), t.doc)


@query("r29_enrich_and_rank", "SELECT e.event_id AS object_id, round((1.0::DOUBLE / (60 + e.lsn)) * greatest(coalesce(m.importance, 0), 0.01) * greatest(coalesce(m.freshness, 0), 0.01) * greatest(coalesce(m.confidence, 0), 0.01), 12) AS final_score FROM ev e LEFT JOIN memory m ON m.memory_id = 'mem_' || e.parent_event_id")
def r29(t):
    given = t.ev.select(F.col("event_id").alias("object_id"), F.concat(F.lit("mem_"), "parent_event_id").alias("ref"), (1.0 / (60 + F.col("lsn"))).alias("rrf"))
    meta = t.memory.select("memory_id", "importance", "freshness", "confidence")
    return rt.final_scores(given.join(meta, F.col("ref") == F.col("memory_id"), "left").fillna(0.0, ["importance", "freshness", "confidence"])).select("object_id", "final_score")


_NOW = f"TIMESTAMP '{NOW}'"
_TOK = "list_distinct(list_filter(string_split(lower(regexp_replace(content || ' ' || summary, '[^A-Za-z0-9_]+', ' ', 'g')), ' '), lambda w: length(w) >= 2))"
_QTOK = "['value', 'agent', 'tool_call', 'as', 'note']"


@query("r30_overlap_freshness", f"SELECT memory_id, round(0.8 * len(list_intersect({_QTOK}, {_TOK})) / CAST(greatest(5, len({_TOK})) AS DOUBLE) + 0.2 / (1.0 + (epoch_us({_NOW}) - epoch_us(valid_from)) / 3600000000.0::DOUBLE / 168.0::DOUBLE), 6) AS score FROM memory")
def r30(t):
    return rt.overlap_freshness(t.memory, F.concat_ws(" ", "content", "summary"), F.lit("value agent tool_call as note"), F.col("valid_from"), now()).select("memory_id", "score")


_BM = rf"""bw AS (SELECT memory_id, list_filter(string_split(lower(regexp_replace(content, '[^A-Za-z0-9_]+', ' ', 'g')), ' '), lambda w: w <> '') AS ws FROM doc),
bd AS (SELECT memory_id, ws, greatest(len(list_distinct(ws)), 1) AS dl FROM bw), ba AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM bd),
bp AS (SELECT memory_id, dl, q, len(list_filter(ws, lambda x: x = q)) AS tf FROM bd, (SELECT DISTINCT unnest({_WORDS}) AS q)), bf AS (SELECT q, count(*) AS df FROM bp WHERE tf > 0 GROUP BY q),
bs AS (SELECT memory_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS raw FROM bp JOIN bf ON bp.q = bf.q, ba WHERE tf > 0 GROUP BY memory_id)"""


@query("r31_bm25", "SELECT bd.memory_id AS object_id, round(coalesce(raw, 0), 6) AS raw, round(least(coalesce(raw, 0), 1), 6) AS score FROM bd LEFT JOIN bs ON bd.memory_id = bs.memory_id", _BM)
def r31(t):
    return rt.bm25(t.doc, "memory_id", "content", QUERY.split())


@query("r33_method_rrf", "SELECT object_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf FROM (SELECT * FROM lr UNION ALL SELECT * FROM sr UNION ALL SELECT memory_id, row_number() OVER (ORDER BY round(least(raw, 1), 6) DESC, memory_id) AS rank FROM bs QUALIFY rank <= 30) GROUP BY object_id", _SPARSE + ", " + _BM)
def r33(t):
    bm = rt.top_k(rt.bm25(t.doc, "memory_id", "content", QUERY.split()).where("raw > 0"), "score", 30)
    return rt.fuse_rrf([lexical_channel(t.doc, QUERY, 30), sparse_channel(t.doc, QUERY, 30), bm])


_COSINE = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) + 0.0"
_BITS = "list_filter(range(1, 65), lambda i: CAST(b.embedding AS DOUBLE[])[i] > 0.1)"
_MMR = f"""mh AS (SELECT a.vec_id AS query_id, b.vec_id AS object_id, {_COSINE} AS score, {_BITS} AS tokens, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COSINE} DESC, b.vec_id) AS n FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 QUALIFY n <= 30),
mo AS (SELECT x.query_id, x.n AS i, list(CASE WHEN len(x.tokens) = 0 OR len(y.tokens) = 0 THEN 0 ELSE len(list_intersect(x.tokens, y.tokens)) / greatest(len(x.tokens), len(y.tokens))::DOUBLE END ORDER BY y.n) AS shared FROM mh x JOIN mh y ON x.query_id = y.query_id GROUP BY ALL),
mc AS (SELECT mh.query_id, list(object_id ORDER BY n) AS ids, list(score ORDER BY n) AS scores, list(shared ORDER BY n) AS shared FROM mh JOIN mo ON mh.query_id = mo.query_id AND n = i GROUP BY mh.query_id),
mr AS (SELECT query_id, CAST([] AS BIGINT[]) AS chosen FROM mc
  UNION ALL SELECT query_id, list_append(chosen, list_position(v, list_max(v))) FROM (SELECT mr.query_id, chosen, list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN list_contains(chosen, i) THEN -1e9 ELSE round(0.7::DOUBLE * scores[i] - (1 - 0.7::DOUBLE) * coalesce(list_max(list_transform(chosen, lambda j: shared[i][j])), 0), 12) END) AS v FROM mr JOIN mc ON mr.query_id = mc.query_id WHERE len(chosen) < least(10, len(ids))))"""


@query("r34_mmr", "SELECT query_id, ids[chosen[-1]] AS object_id, len(chosen) AS place FROM mr JOIN mc USING (query_id) WHERE len(chosen) > 0", _MMR)
def r34(t):
    hits = rt.knn(t.embeddings, t.embeddings.where("vec_id % 100 = 0"), 30, "cosine")
    tokens = t.embeddings.select(F.col("vec_id").alias("object_id"), F.transform(F.filter(F.transform("embedding", lambda x, i: F.when(x > 0.1, i)), lambda i: i.isNotNull()), lambda i: i.cast("string")).alias("tokens"))
    return rt.mmr(hits.join(tokens, "object_id"), 10)


@query("r35_episode_mentions", "SELECT m.memory_id, round(m.importance + 0.01 * coalesce(c, 0), 6) AS score FROM memory m LEFT JOIN (SELECT parent_event_id AS p, count(*) AS c FROM ev WHERE parent_event_id <> '' GROUP BY p) ON m.event_id = p")
def r35(t):
    counts = t.ev.where("parent_event_id != ''").groupBy(F.col("parent_event_id").alias("event_id")).agg(F.count(F.lit(1)).alias("c"))
    return t.memory.join(counts, "event_id", "left").select("memory_id", F.round(F.col("importance") + 0.01 * F.coalesce("c", F.lit(0)), 6).alias("score"))


_HITS = f"hits AS (SELECT query_id, object_id, score, label, n FROM (SELECT a.vec_id AS query_id, b.vec_id AS object_id, b.label, {_VEC} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_VEC} DESC, b.vec_id) AS n FROM embeddings a, embeddings b) WHERE n <= 40)"


def _labelled(t, hits):
    return hits.drop("rank").join(t.embeddings.select(F.col("vec_id").alias("object_id"), "label"), "object_id")


def _hits(t):
    return _labelled(t, rt.knn(t.embeddings, t.embeddings, 40, "ip"))


@query("r38_reduce_results", "SELECT query_id, object_id, score FROM hits WHERE n > 5 AND n <= 15", _HITS)
def r38(t):
    # Of the 40 hits the page needs those up to its end, and no labels.
    return rt.knn(t.embeddings, t.embeddings, 15, "ip").where("rank > 5").select("query_id", "object_id", "score")


_GROUPED = """gi AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, object_id) AS in_group FROM hits), gh AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, object_id) AS group_no FROM gi WHERE in_group = 1)"""


@query("r39_grouped_reduce", "SELECT gi.query_id, gi.label, object_id, in_group, group_no FROM gi JOIN gh ON gi.query_id = gh.query_id AND gi.label = gh.label WHERE in_group <= 2 AND group_no > 1 AND group_no <= 4", _HITS + ", " + _GROUPED)
def r39(t):
    return rt.grouped_hits(_hits(t), "label", limit=3, offset=1, group_size=2).select("query_id", "label", "object_id", "in_group", "group_no")


@query("r40_merge_grouped", "SELECT gi.query_id, gi.label, object_id, in_group, group_no FROM gi JOIN gh ON gi.query_id = gh.query_id AND gi.label = gh.label WHERE in_group <= 3 AND group_no <= 5", _HITS + ", " + _GROUPED)
def r40(t):
    one = stored(_hits(t), "hits")
    two = one.where("score > 0.1")
    both = one.unionByName(two).groupBy("query_id", "object_id", "label").agg(F.max("score").alias("score"))
    return rt.grouped_hits(both, "label", limit=5, offset=0, group_size=3).select("query_id", "label", "object_id", "in_group", "group_no")


@query("r41_sub_request_reduce", "SELECT query_id, object_id, n AS rank FROM hits WHERE n <= 8", _HITS)
def r41(t):
    return rt.knn(t.embeddings, t.embeddings, 8, "ip").select("query_id", "object_id", "rank")


@query("r42_rerank_groups", "SELECT query_id, label, round(sum(score) + 1e-8, 5) AS total, max(score) AS best, round(avg(score) + 1e-8, 5) AS mean FROM hits GROUP BY query_id, label", _HITS)
def r42(t):
    totals = (F.round(F.sum("score") + 1e-8, 5).alias("total"), F.max("score").alias("best"), F.round(F.avg("score") + 1e-8, 5).alias("mean"))
    # Copies of a query have the same groups.
    return rt.knn(t.embeddings, t.embeddings, 40, "ip", each=lambda hits: _labelled(t, hits).groupBy("query_id", "label").agg(*totals))


@query("r43_boost_score", "SELECT memory_id, round(importance * (CASE WHEN memory_type = 'factual' THEN 2.0 ELSE 1.0 END) * (CASE WHEN list_contains(policy_tags, 'reviewed') THEN 1.5 ELSE 1.0 END), 6) AS score FROM memory")
def r43(t):
    boost = F.when(F.col("memory_type") == "factual", 2.0).otherwise(1.0) * F.when(F.array_contains("policy_tags", "reviewed"), 1.5).otherwise(1.0)
    return t.memory.select("memory_id", F.round(F.col("importance") * boost, 6).alias("score"))


@query("r45_highlight", "SELECT memory_id, regexp_replace(content, '(agent)', '<em>\\1</em>', 'gi') AS marked FROM memory")
def r45(t):
    return t.memory.select("memory_id", F.regexp_replace("content", "(?i)(agent)", "<em>$1</em>").alias("marked"))
