"""Search channels, fusion, ranking, and grouped reduction of results.

Every ranking breaks ties by id. Where a total order over all rows is asked for, a top-k comes first: it is a partial
sort in each task and a merge of k rows, so that no window runs over more than k rows in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import cosine, fields, fnv1a, inner_product, mixed_tokens, overlap, squared_l2, token_set, word_tokens
from ..sources.scratch import new_path, remove, stored

K_RRF = 60


def top_k(rows: DataFrame, score: str, k: int, id_col: str = "object_id") -> DataFrame:
    """The k best rows with their rank from 1."""
    best = rows.orderBy(F.col(score).desc(), F.col(id_col)).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.col(score).desc(), F.col(id_col))).cast("long"))


def top_k_per(rows: DataFrame, group: Sequence[str], score: str, k: int, id_col: str = "object_id") -> DataFrame:
    """The k best rows of each group; Spark cuts each group to k rows before the shuffle."""
    order = W.partitionBy(*group).orderBy(F.col(score).desc(), F.col(id_col))
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def fuse_rrf(lists: Sequence[DataFrame], k: int = K_RRF) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (object_id, rank from 1)."""
    out = lists[0].select("object_id", "rank")
    for x in lists[1:]:
        out = out.unionByName(x.select("object_id", "rank"))
    return out.groupBy("object_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("rrf"))


def merge_ordered(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """The first list, then what the second adds, up to k; each (object_id, rank)."""
    both = first.select("object_id", F.lit(0).alias("list"), "rank").unionByName(second.select("object_id", F.lit(1).alias("list"), "rank"))
    best = both.groupBy("object_id").agg(F.min(F.struct("list", "rank")).alias("at"))
    return best.orderBy("at.list", "at.rank", "object_id").limit(k).withColumn("place", F.row_number().over(W.orderBy("at.list", "at.rank", "object_id")).cast("long")).select("object_id", "place")


def sparse_terms(docs: DataFrame, id_col: str, text_col: str, buckets: int = 30000) -> DataFrame:
    """(id, term, weight): bytes of ASCII letters lower-cased, white-space words hashed by FNV-1a, weight tf / length.

    Each distinct word is hashed once, after words were counted inside each document."""
    low = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select(F.col(id_col).alias("object_id"), fields(low).alias("w")).withColumn("n", F.size("w")).select("object_id", "n", F.explode_outer("w").alias("word")).where("word is not null")
    counted = words.groupBy("object_id", "n", "word").agg(F.count(F.lit(1)).alias("tf"))
    hashed = counted.join(counted.select("word").distinct().withColumn("term", fnv1a(F.col("word")) % buckets), "word")
    return hashed.groupBy("object_id", "term").agg((F.sum("tf") / F.max("n")).alias("weight"))


def sparse_search(terms: DataFrame, query_terms: DataFrame) -> DataFrame:
    """Inner product of sparse vectors over shared terms; only positive scores."""
    q = query_terms.select("term", F.col("weight").alias("q"))
    return terms.join(q, "term").groupBy("object_id").agg(F.round(F.sum(F.col("weight") * F.col("q")), 12).alias("score")).where("score > 0")


def sparse_postings(docs: DataFrame, id_col: str, text_col: str, query_terms: DataFrame, buckets: int = 30000) -> DataFrame:
    """``sparse_terms`` of one request's terms only: each distinct word of the corpus is hashed once, and the words of other
    terms go where they are read, before anything is counted or shuffled. The words of the request's terms are a share
    terms / buckets of the vocabulary; they are written, counted, and broadcast up to a million."""
    low = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.col(id_col).alias("object_id"), fields(low).alias("w")).withColumn("n", F.size("w"))
    # An inner join on a term that can't be null: a semi join, or a filter for nulls, would be pushed below the distinct and
    # hash every word where it stands. explode_outer, as explode adds a filter that splits each text again.
    distinct = rows.select(F.explode_outer("w").alias("word")).where("word is not null").distinct().withColumn("term", F.coalesce(fnv1a(F.col("word")) % buckets, F.lit(-1)))
    wanted = stored(distinct.join(F.broadcast(query_terms.select("term").distinct()), "term"), "wanted-words")
    few = wanted.count() <= 1_000_000
    met = rows.select("object_id", "n", F.explode_outer("w").alias("word")).join(F.broadcast(wanted) if few else wanted, "word")
    return met.groupBy("object_id", "term").agg((F.count(F.lit(1)) / F.max("n")).alias("weight"))


def write_postings(docs: DataFrame, path: str, id_col: str, text_col: str, buckets: int = 30000, files: int = 64) -> None:
    """The sparse vectors of a corpus version as postings, sorted by term in ranges, so that a request reads the row groups
    of its own terms only."""
    sparse_terms(docs, id_col, text_col, buckets).repartitionByRange(files, "term").sortWithinPartitions("term", "object_id").write.mode("overwrite").parquet(path)


def read_postings(spark: SparkSession, path: str, terms: Sequence[int]) -> DataFrame:
    return spark.read.parquet(path).where(F.col("term").isin(*terms))


def bm25(docs: DataFrame, id_col: str, text_col: str, query: Sequence[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(object_id, raw, score): BM25 with the number of distinct terms as length; score is raw cut to [0, 1].

    A document is read once and leaves its length and the counts of the query's terms, a few numbers, which are dealt
    out by id: the totals and the scores both read that exchange."""
    wanted = sorted(set(query))
    tokens = docs.select(F.col(id_col).alias("object_id"), word_tokens(F.col(text_col)).alias("w"))
    tf = [(F.size("w") - F.size(F.array_remove("w", t))).alias(f"tf{i}") for i, t in enumerate(wanted)]
    counted = tokens.select("object_id", F.greatest(F.size(F.array_distinct("w")), F.lit(1)).alias("dl"), *tf).repartition("object_id")
    here = [F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(wanted))]
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.count("object_id").alias("named"), F.avg("dl").alias("avgdl"), *here)
    raw = F.lit(0.0)
    for i in range(len(wanted)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        raw = raw + F.when(F.col(f"tf{i}") > 0, idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    scored = counted.crossJoin(F.broadcast(stats)).select("object_id", raw.alias("raw"))
    return scored.select("object_id", F.round("raw", 6).alias("raw"), F.round(F.least("raw", F.lit(1.0)), 6).alias("score"))


def tfidf(docs: DataFrame, id_col: str, text_col: str, dim: int = 256) -> DataFrame:
    """(object_id, bucket, value): hashed TF-IDF vectors of unit length, IDF ln((N+1)/(df+1))+1 over the corpus.

    The buckets of all documents are counted map-side; N counts documents with a token."""
    words = docs.select(F.col(id_col).alias("object_id"), mixed_tokens(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    counted = words.withColumn("n", F.size("w")).select("object_id", "n", F.explode_outer("w").alias("word")).where("word is not null").groupBy("object_id", "n", "word").agg(F.count(F.lit(1)).alias("c"))
    hashed = counted.join(counted.select("word").distinct().withColumn("bucket", fnv1a(F.col("word")) % dim), "word")
    tf = hashed.groupBy("object_id", "bucket").agg((F.sum("c") / F.max("n")).alias("tf"))
    df = tf.groupBy("bucket").agg(F.count(F.lit(1)).alias("df"))
    total = words.agg(F.count(F.lit(1)).alias("total"))
    raw = tf.join(F.broadcast(df), "bucket").crossJoin(F.broadcast(total)).withColumn("v", F.col("tf") * (F.log((F.col("total") + 1.0) / (F.col("df") + 1.0)) + 1.0))
    return raw.withColumn("value", F.round(F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy("object_id"))), 6)).select("object_id", "bucket", "value")


METRICS = {"ip": (inner_product, False), "l2": (squared_l2, True), "cosine": (cosine, False)}


def knn(base: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", max_query_bytes: int = 64 << 20, each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, object_id, score, rank): exact nearest neighbours of a query set against all rows; or what ``each`` makes
    of them, rows with a query_id that depend on the hits of that query alone.

    Scores are in double precision. Null vectors and vectors of another width than the queries', and vectors without an
    id, take no part. Where pairs are very many and at least half of the rows are copies, distinct vectors are searched."""
    usable = queries.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull())
    facts = usable.select(F.max(F.size(vec_col)).alias("width"), F.count(F.lit(1)).alias("n")).first()
    width, n = facts["width"] or 1, facts["n"]
    same = (F.size(vec_col) == width) & F.col(id_col).isNotNull()
    alike = base.sameSemantics(queries)
    base, usable = base.where(same), usable.where(same)
    each = each or (lambda hits: hits)
    if n > _TILE[0] and n * (n if alike else base.count()) >= _MANY_PAIRS:
        of_queries = _copies(usable, id_col, vec_col)
        of_base = of_queries if alike or not of_queries else _copies(base, id_col, vec_col)
        if of_queries and of_base:
            return _knn_of_distinct(of_base, of_queries, k, metric, width, max_query_bytes, each)
    return each(_knn_of_rows(base, usable, n, k, metric, id_col, vec_col, width, max_query_bytes))


def _copies(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame, int] | None:
    """The distinct vectors (first, v, copies), the rows (first, id) and the number of distinct vectors; first is the
    smallest id of equal vectors. None where less than half of the rows are copies, ids repeat, or a number isn't finite."""
    ids, h = F.col(id_col).cast("long"), F.xxhash64(vec_col)
    facts = rows.select(ids.alias("id"), h.alias("h")).agg(F.count_distinct("id").alias("ids"), F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("some")).first()
    if facts["ids"] < facts["n"] or 2 * facts["some"] > facts["n"]:
        return None
    grouped = rows.groupBy(F.col(vec_col).alias("v")).agg(F.min(ids).alias("first"), F.count(F.lit(1)).alias("copies"))
    distinct = stored(grouped.select("first", "v", "copies", F.xxhash64("v").alias("h")), "vectors")
    fit = F.coalesce(F.forall("v", lambda x: F.abs(x) < 1e150), F.lit(False))
    seen = distinct.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h").alias("hashes"), F.bool_and(fit).alias("fit")).first()
    # Rows find their vector by its hash, as long as no two vectors share one.
    if seen["hashes"] < seen["n"] or not seen["fit"]:
        return None
    return distinct.drop("h"), stored(rows.select(ids.alias("id"), h.alias("h")).join(distinct.select("h", "first"), "h").select("first", "id"), "copies"), seen["n"]


def _knn_of_distinct(of_base, of_queries, k: int, metric: str, width: int, max_query_bytes: int, each: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The search over distinct vectors. The k best rows are copies of the k best vectors by score and first id, so k of
    these are kept for each distinct query; copies of vectors that fewer than k rows are better than are ranked again,
    and what ``each`` makes of them is given to every copy of the query."""
    (vectors, copies, _), (asked, askers, n) = of_base, of_queries
    found = _knn_of_rows(vectors, asked, n, k, metric, "first", "v", width, max_query_bytes).drop("rank")
    of_query = W.partitionBy("query_id")
    found = found.join(vectors.select(F.col("first").alias("object_id"), "copies"), "object_id").withColumn("tie", F.dense_rank().over(of_query.orderBy(F.col("score").desc())))
    better = F.sum("copies").over(of_query.orderBy("tie").rangeBetween(W.unboundedPreceding, -1))
    found = found.withColumn("better", F.coalesce(better, F.lit(0))).where(F.col("better") < k).withColumnRenamed("object_id", "first")
    place = F.row_number().over(W.partitionBy("first").orderBy("id"))
    few = copies.withColumn("place", place).where(F.col("place") <= k).drop("place")
    hits = top_k_per(found.join(few, "first").select("query_id", F.col("id").alias("object_id"), "score"), ["query_id"], "score", k)
    made = each(hits)
    rest = [c for c in made.columns if c != "query_id"]
    return made.withColumnRenamed("query_id", "first").join(askers, "first").select(F.col("id").alias("query_id"), *rest)


def _knn_of_rows(base: DataFrame, usable: DataFrame, n: int, k: int, metric: str, id_col: str, vec_col: str, width: int, max_query_bytes: int) -> DataFrame:
    """The search of n queries of one width.

    One side is sent in blocks of a fixed size, each with a pass over the other side. Where there are several, a block's
    result is written and the block dropped before the next one is sent, so executors and driver hold one block whatever
    the number of rows. The queries are sent if they are few: each task keeps k of its rows for each query before the
    shuffle. Where that would shuffle more than the rows themselves hold, the rows are sent, and each task keeps k for each
    of its own queries, which go on with these to the next block. Scores are made in tiles of a fixed size in both cases."""
    size = lambda df, count: count * width * (4 if df.schema[vec_col].dataType.simpleString() == "array<float>" else 8)
    blocks, send_rows = max(1, -(-size(usable, n) // max_query_bytes)), False
    if n > _TILE[0]:
        rows, parts = base.groupBy(F.spark_partition_id().alias("p")).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
        row_blocks = max(1, -(-size(base, rows) // max_query_bytes))
        send_rows = row_blocks <= blocks and size(base, rows) <= n * k * 24 * parts
    if send_rows:
        blocks = row_blocks
        # Tasks by their number of products with a block, however many files the queries come in, but with queries enough
        # to be worth reading the block.
        tasks = -(-n // max(_TASK_PRODUCTS * blocks // max(rows, 1), _TASK_QUERIES))
        usable = usable.repartition(tasks, id_col) if tasks > parts else usable
    sent_side = base if send_rows else usable
    dealt = (usable if send_rows else base).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    spark, out, before = base.sparkSession, None, None
    for i in range(blocks):
        block = sent_side if blocks == 1 else sent_side.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == i)
        goes_on = send_rows and i + 1 < blocks
        near, sent = _knn_block(dealt, block, k, metric, id_col, vec_col, width, send_rows, goes_on)
        if blocks == 1 or send_rows and not goes_on:
            return top_k_per(near, ["query_id"], "score", k)
        if goes_on:
            path = new_path(spark, "knn")
            near.write.option("compression", "zstd").parquet(path)
            dealt = spark.read.schema(near.schema).parquet(path)
            if before:
                remove(spark, before)
            before = path
        else:
            # Of the queries' blocks each is whole.
            found = stored(top_k_per(near, ["query_id"], "score", k), "knn")
            out = found if out is None else out.unionByName(found)
        sent.destroy()
    return out


_TASK_PRODUCTS = 1 << 28
_TASK_QUERIES = 1 << 12
_TILE = 512, 8192
_PAIRS = 1 << 14
_MOST_PAIRS = 1 << 18
_MANY_PAIRS = 1 << 32


def _vectors(ids, vectors, width: int):
    """Ids and matrix of two Arrow columns."""
    return ids.to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _scores(q, b, metric: str):
    """Scores of the vectors of q and b, row by row."""
    s, x, y = (np.einsum("ij,ij->i", *v) for v in ((q, b), (q, q), (b, b)))
    if metric == "l2":
        return -(x + y - 2 * s)
    if metric == "cosine":
        norm = np.sqrt(x) * np.sqrt(y)
        return np.divide(s, norm, out=np.zeros_like(s), where=norm != 0)
    return s


def _screen(x, metric: str):
    """Vectors whose products tell which scores can be among the best: single precision, of unit length for the cosine; and
    the largest length, infinite if single precision may not hold."""
    whole, x = x, x.astype(np.float64)
    length = np.sqrt((x * x).sum(axis=1))
    if metric == "cosine":
        x = np.divide(x, length[:, None], out=np.zeros_like(x), where=length[:, None] != 0)
        length = length * 0 + 1
    most = length.max(initial=0.0)
    return (x if metric == "cosine" else whole).astype(np.float32, copy=False), most if metric != "l2" and most < 1e15 else np.inf


def _keep_best(best, q, b, ids, screens, k: int, metric: str, later: bool):
    """The k best (scores, ids) of each query q, of those before and the rows b named ids, by rounded score and id.
    later: all of these ids come after those before. Products in single precision leave out what can't be among the best
    by more than their error; what is left is scored in double precision, rounded and sorted."""
    (q_screen, q_most), (b_screen, b_most) = screens
    m, n = len(q), len(b)
    had = best[0].shape[1] if best else 0
    error = 1.2e-7 * (q.shape[1] + 4) * q_most * b_most
    some = None
    if np.isfinite(error) and (had == k or n > k):
        s = q_screen @ b_screen.T
        floor = best[0][:, -1] if had == k else np.partition(s, n - k, axis=1)[:, n - k].astype(np.float64)
        # Rounding moves each of two scores by half a millionth.
        floor = (floor - 1.1e-6 - 2 * error - 1e-6 * np.abs(floor)).astype(np.float32)
        some = ~(s < floor[:, None])
        del s
    left = m * n if some is None else np.count_nonzero(some)
    if left > _MOST_PAIRS and m > 1:
        # Rows that are equal or nearly so leave out nothing: fewer queries at a time, whatever the rows are.
        size = min(m - 1, max(1, m * _MOST_PAIRS // left))
        some, parts = None, []
        for i in range(0, m, size):
            own = best and tuple(x[i : i + size] for x in best)
            parts.append(_keep_best(own, q[i : i + size], b, ids, ((q_screen[i : i + size], q_most), screens[1]), k, metric, later))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    row, at = np.divmod(np.arange(m * n) if some is None else np.flatnonzero(some), n)
    del some
    score, own = np.empty(len(row)), ids[at]
    for i in range(0, len(row), _PAIRS):
        x, y = (v[j[i : i + _PAIRS]].astype(np.float64) for v, j in ((q, row), (b, at)))
        score[i : i + _PAIRS] = np.round(_scores(x, y, metric), 6) + 0.0
    if had == k:
        last = best[0][:, -1][row]
        some = ~(score <= last) if later else ~(score < last)  # negated, as scores that are no numbers go to the sort
        row, score, own = row[some], score[some], own[some]
        if not len(row):
            return best
    if had:
        row = np.concatenate([np.repeat(np.arange(m), had), row])
        score, own = np.concatenate([best[0].ravel(), score]), np.concatenate([best[1].ravel(), own])
    order = np.lexsort((own, -score, row))
    row = row[order]
    order = order[np.arange(len(row)) - np.searchsorted(row, np.arange(m))[row] < k]
    return score[order].reshape(m, -1), own[order].reshape(m, -1)


def _tiles(x, size: int, metric: str):
    """(start, end, screen) of blocks of rows."""
    return [(i, min(i + size, len(x)), _screen(x[i : i + size], metric)) for i in range(0, len(x), size)]


def _knn_block(dealt: DataFrame, block: DataFrame, k: int, metric: str, id_col: str, vec_col: str, width: int, send_rows: bool, goes_on: bool):
    """What the sent block leaves of ``dealt`` (id, v, and the best ids and scores of earlier blocks): hits, or where the
    queries go on to another block, the same rows with the best so far."""
    got = block.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).toArrow().combine_chunks()
    ids, mat = _vectors(*(c.chunk(0) for c in got.columns), width) if len(got) else (np.zeros(0, np.int64), np.zeros((0, width)))
    order = np.argsort(ids, kind="stable")
    sent = block.sparkSession.sparkContext.broadcast((ids[order], mat[order]))

    def hits(q_ids, best):
        import pyarrow as pa

        m = best[0].shape[1]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, m)), pa.array(best[1].ravel()), pa.array(best[0].ravel())], ["query_id", "object_id", "score"])

    def with_best(q_ids, vectors, best):
        import pyarrow as pa

        m = best[0].shape[1]
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(q_ids) + 1, dtype=np.int32) * m), pa.array(x.ravel())) for x in (best[1], best[0])]
        return pa.RecordBatch.from_arrays([pa.array(q_ids), vectors, *lists], ["id", "v", "ids", "scores"])

    def of_own_queries(batches):
        ids, mat = sent.value
        tiles = _tiles(mat, _TILE[1], metric)
        for batch in batches:
            q_ids, q = _vectors(batch.column(0), batch.column(1), width)
            # All queries have met the same rows, so they have equally many.
            had = [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(q), -1) for c in (3, 2)] if batch.num_columns > 2 and len(q) else [np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)]
            for i, j, screen in _tiles(q, _TILE[0], metric):
                best = (had[0][i:j], had[1][i:j])
                for c, d, other in tiles:
                    best = _keep_best(best, q[i:j], mat[c:d], ids[c:d], (screen, other), k, metric, not had[0].shape[1])
                yield with_best(q_ids[i:j], batch.column(1).slice(i, j - i), best) if goes_on else hits(q_ids[i:j], best)

    def of_sent_queries(batches):
        q_ids, q = sent.value
        tiles = _tiles(q, _TILE[0], metric)
        best = [None] * len(tiles)
        for batch in batches:
            ids, mat = _vectors(batch.column(0), batch.column(1), width)
            for c, d, other in _tiles(mat, _TILE[1], metric):
                for t, (i, j, screen) in enumerate(tiles):
                    best[t] = _keep_best(best[t], q[i:j], mat[c:d], ids[c:d], (screen, other), k, metric, False)
        for x, (i, j, _) in zip(best, tiles, strict=True):
            if x is not None:
                yield hits(q_ids[i:j], x)

    schema = f"id long, v {dealt.schema['v'].dataType.simpleString()}, ids array<long>, scores array<double>" if goes_on else "query_id long, object_id long, score double"
    return dealt.mapInArrow(of_own_queries if send_rows else of_sent_queries, schema), sent


def knn_columns(base: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The same by column expressions only, for small query sets: the check of the block form."""
    f, ascending = METRICS[metric]
    q = F.broadcast(queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("q")))
    score = F.round(f(F.col("q"), F.col(vec_col)), 6)
    pairs = base.crossJoin(q).select("query_id", F.col(id_col).alias("object_id"), (-score if ascending else score).alias("score"))
    return top_k_per(pairs, ["query_id"], "score", k)


def final_scores(candidates: DataFrame) -> DataFrame:
    """rrf times importance, freshness and confidence, each 0.01 at least."""
    low = lambda c: F.greatest(F.col(c), F.lit(0.01))
    return candidates.withColumn("final_score", F.round(F.col("rrf") * low("importance") * low("freshness") * low("confidence"), 12))


def mark_seeds(candidates: DataFrame, threshold: float = 0.5, floor: float = 1e-4) -> DataFrame:
    """Scores over the largest one; a seed has at least the threshold, and the absolute floor before division. The
    largest score is one number, found by an aggregate and not by a window over all rows."""
    top = candidates.agg(F.max("final_score").alias("_top"))
    open_ = (F.col("final_score") >= floor) & (F.col("_top") >= floor)
    return candidates.crossJoin(F.broadcast(top)).withColumn("seed_score", F.when(open_, F.round(F.col("final_score") / F.col("_top"), 6)).otherwise(0.0)).withColumn("is_seed", open_ & (F.col("seed_score") >= threshold)).drop("_top")


def overlap_freshness(docs: DataFrame, text: Column, query: Column, valid_from: Column, now: Column) -> DataFrame:
    """0.8 token overlap + 0.2 freshness, where freshness halves after a week."""
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(valid_from.cast("timestamp"))) / F.lit(3_600_000_000.0)
    fresh = F.when(valid_from.isNull() | (hours < 0), 0.5).otherwise(F.least(1.0 / (1.0 + hours / 168.0), F.lit(1.0)))
    return docs.withColumn("score", F.round(0.8 * overlap(token_set(query), token_set(text)) + 0.2 * fresh, 6))


def grouped_hits(hits: DataFrame, group: str, limit: int, offset: int, group_size: int, id_col: str = "object_id", request: str = "query_id") -> DataFrame:
    """Of each request the groups numbered offset+1 to offset+limit in the order of their best hit, with at most
    ``group_size`` hits each. Hits are dealt out by request once, and groups are numbered where they lie, so nothing that
    the hits come from is computed twice. Hits without a request or a group go, but a group of hits without one has a number."""
    inside = W.partitionBy(request, group).orderBy(F.col("score").desc(), F.col(id_col))
    heads = hits.repartition(request).withColumn("in_group", F.row_number().over(inside).cast("long")).withColumn("_head", F.first(F.struct("score", F.col(id_col).alias("id"))).over(inside))
    order = W.partitionBy(request).orderBy(F.col("_head.score").desc(), F.col("_head.id"), F.col(group))
    numbered = heads.where(F.col("in_group") <= group_size).withColumn("group_no", F.dense_rank().over(order).cast("long")).drop("_head")
    return numbered.where((F.col("group_no") > offset) & (F.col("group_no") <= offset + limit) & F.col(request).isNotNull() & F.col(group).isNotNull())


def mmr(ranked: DataFrame, k: int, weight: float = 0.7, group: str = "query_id") -> DataFrame:
    """Greedy choice of diverse results from (query_id, object_id, score, tokens): each step takes the best of
    weight * score - (1 - weight) * largest overlap with what is chosen. One task holds one request's candidates, a
    top-k list by contract; ties go to the smaller id."""

    def pick(pdf):
        pdf = pdf.sort_values(["score", "object_id"], ascending=[False, True]).reset_index(drop=True)
        sets = [set(t) for t in pdf["tokens"]]
        rest, chosen, rows = list(range(len(pdf))), [], []
        worst = np.zeros(len(pdf))
        while rest and len(chosen) < k:
            value = [weight * pdf["score"][i] - (1 - weight) * worst[i] for i in rest]
            at = rest.pop(int(np.argmax(np.round(value, 12))))
            chosen.append(at)
            rows.append((pdf[group][at], pdf["object_id"][at], len(chosen)))
            for i in rest:
                both = len(sets[i] & sets[at])
                most = max(len(sets[i]), len(sets[at]))
                worst[i] = max(worst[i], both / most if sets[i] and sets[at] else 0.0)
        import pandas as pd

        return pd.DataFrame(rows, columns=[group, "object_id", "place"])

    kind = ranked.schema["object_id"].dataType.simpleString()
    return ranked.groupBy(group).applyInPandas(pick, f"{group} {ranked.schema[group].dataType.simpleString()}, object_id {kind}, place long")


class InvertedLists:
    """Approximate search: vectors dealt to the nearest of ``lists`` centres, queries probe the nearest ``probes``.

    Centres are trained on a bounded sample; every row is indexed."""

    def __init__(self, base: DataFrame, lists: int = 16, sample: int = 20_000, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 1):
        self.id_col, self.vec_col = id_col, vec_col
        rows = base.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(vec_col).collect()
        x = np.array([r[0] for r in rows], np.float64)
        rng = np.random.default_rng(seed)
        self.centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(15):
            near = np.argmin(((x[:, None, :] - self.centres[None]) ** 2).sum(-1), axis=1)
            self.centres = np.array([x[near == i].mean(axis=0) if (near == i).any() else self.centres[i] for i in range(len(self.centres))])
        self.index = base.withColumn("list", F.element_at(self._nearest(F.col(vec_col), 1), 1))

    def _nearest(self, vec: Column, n: int) -> Column:
        dists = F.array(*(F.struct(squared_l2(vec, F.array(*(F.lit(float(v)) for v in c))).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(self.centres)))
        return F.transform(F.slice(F.array_sort(dists), 1, n), lambda s: s["i"])

    def search(self, queries: DataFrame, k: int, probes: int = 4) -> DataFrame:
        q = queries.select(F.col(self.id_col).alias("query_id"), F.col(self.vec_col).alias("q"), F.explode(self._nearest(F.col(self.vec_col), probes)).alias("list"))
        met = self.index.join(q, "list").select("query_id", F.col(self.id_col).alias("object_id"), F.round(cosine(F.col("q"), F.col(self.vec_col)), 6).alias("score"))
        return top_k_per(met, ["query_id"], "score", k)
