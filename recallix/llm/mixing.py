"""Mixing sources to target weights by weighted fair queueing (operator 3).

Each source's documents stand in a shuffled queue, over again for each repeat. A copy's virtual finish time is the
source's tokens up to and with it, divided by the source's target. All copies are sorted by that time over the whole
corpus, and the mix is the longest prefix within the total budget. Both running sums are taken in two steps, sums of
bounded buckets first and sums inside a bucket last, so no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Table, col, free_name, word_count


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(source, size) of all sources to (source, source_size, weight, target).

    Sources by code point, null last, take the weights in turn. They share the sum of all sizes by weight; a target
    above ``max_repeats`` times its source's size stops there, and the excess is shared by weight among the others
    until none is above. That end state is one level L with target = min(limit, L * weight): with sources in order of
    limit / weight, L is the first level that the next limit doesn't undercut. One row for each source; the windows
    over all of them run in one task, so sources are taken to be some millions at most.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    weighted = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn.cast("int"))).withColumn("lim", F.col("size").cast("double") * max_repeats)
    order = W.orderBy(F.col("lim") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("size").over(whole).cast("double") - F.coalesce(F.sum("lim").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = weighted.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("lim"))
    final = F.coalesce(F.max(F.when(F.col("open"), F.col("level"))).over(whole), F.lit(float("inf")))
    return leveled.withColumn("final", final).select("source", F.col("size").alias("source_size"), "weight", F.when(F.col("final") == float("inf"), F.col("lim")).otherwise(F.least(F.col("lim"), F.col("final") * F.col("weight"))).alias("target"))


def _prefix(df: DataFrame, keys: list[str], bucket: str, value: str) -> DataFrame:
    """(keys, bucket) as _k_.. and _b, with _base, the sum of ``value`` in the buckets before. The window runs over
    buckets, not rows."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_s"))
    before = F.sum("_s").over(W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1))
    return sums.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col(bucket).alias("_b"), F.coalesce(before, F.lit(0)).alias("_base"))


def _running(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str, prefix: DataFrame | None = None) -> DataFrame:
    """``out``: the running sum of ``value`` by ``keys`` in the order (bucket, *order), the row included."""
    prefix = _prefix(df, keys, bucket, value) if prefix is None else prefix
    same = F.col(bucket) == F.col("_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = df.withColumn("_in", F.sum(value).over(inside))
    return summed.join(prefix, same).withColumn(out, F.col("_in") + F.col("_base")).drop("_in", "_b", "_base", *(f"_k_{k}" for k in keys))


def _text_hash(text: Column) -> Column:
    return F.coalesce(F.xxhash64(text), F.lit(0))


def _decisions(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], max_repeats: int, seed: int, bucket_rows: int) -> DataFrame:
    """``plan`` with the hash of the text, and n and r, the number of rows equal in id, source and text, and which of
    them it is."""
    text = col(text_col).cast("string")
    narrow = docs.select(col(id_col).cast("long").alias("id"), col(source_col).cast("string").alias("source"), word_count(text).alias("size"), _text_hash(text).alias("th"))
    rows = Table(narrow.groupBy("id", "source", "size", "th").agg(F.count(F.lit(1)).alias("n")).withColumn("size_all", F.col("size") * F.col("n")), "sizes").df
    aimed = Table(targets(rows.groupBy("source").agg(F.sum("size_all").alias("size")), weights, max_repeats), "targets").df
    totals = rows.agg(F.sum("size_all"), F.sum("n")).first()
    budget, count = totals[0] or 0, totals[1] or 0
    buckets = max(1, -(-count // bucket_rows))
    # Rows that share an id with other texts, or have none, are dealt by their texts too.
    again = rows.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("id").alias("_id"))
    named = rows.join(again, F.col("id") == F.col("_id"), "left")
    own = F.when(F.col("id").isNull() | F.col("_id").isNotNull(), F.concat(F.lit(":"), F.col("th").cast("string"))).otherwise(F.lit(""))
    each = named.withColumn("r", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    each = each.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("r").cast("string"), own))).drop("_id", "size_all")
    u = F.pmod(F.conv(F.substring("h", 1, 15), 16, 10).cast("long"), F.lit(1 << 60)) / F.lit(float(1 << 60))
    each = each.withColumn("u", u).withColumn("b", F.least(F.floor(F.col("u") * buckets), F.lit(buckets - 1)).cast("long"))
    queued = _running(each, ["source"], "b", ["h", "id", "size", "th", "r"], "size", "upto")
    aims = aimed.select(F.col("source").alias("_src"), "source_size", "target")
    joined = queued.join(F.broadcast(aims) if aims.count() <= 100_000 else aims, F.col("source").eqNullSafe(F.col("_src"))).drop("_src", "b")
    queue = Table(joined, "queue").df

    # Documents without words take no place; they stand in their queue evenly, not all where a document with words ends.
    pace = F.when(F.col("target") > 0, F.col("source_size") / F.col("target")).otherwise(F.lit(1.0))
    at_words = (F.col("upto") + F.col("turn") * F.col("source_size")).cast("double") / F.col("target")
    copies = queue.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    timed = copies.withColumn("finish", F.when((F.col("target") > 0) & (F.col("size") > 0), at_words).otherwise((F.col("u") + F.col("turn")) * pace)).drop("u", "upto")
    # Slices of time take equal words, not equal rows: one with many rows is cut into as many spans as its rows ask for.
    place = F.col("finish") * buckets
    timed = timed.withColumn("slice", F.floor(place).cast("long"))
    slices = Table(timed.groupBy("slice").agg(F.count(F.lit(1)).alias("rows")).select(F.col("slice").alias("_sl"), F.ceil(F.col("rows") / bucket_rows).cast("long").alias("_cuts")), "slices").df
    small = slices.count() <= 500_000
    spans = timed.join(F.broadcast(slices) if small else slices, F.col("slice") == F.col("_sl"))
    sub = F.least(F.floor((place - F.col("slice")) * F.col("_cuts")).cast("long"), F.col("_cuts") - 1)
    spans = spans.withColumn("span", F.struct(F.col("slice").alias("a"), sub.alias("b"))).drop("_sl", "_cuts", "slice")
    prefix = Table(_prefix(spans, [], "span", "size"), "spans").df
    # Spans that begin beyond the budget hold nothing that is taken, and are not sorted.
    last = prefix.where(F.col("_base") <= budget).agg(F.max("_b")).first()[0]
    within = F.col("span") <= (F.struct(F.lit(last[0]).alias("a"), F.lit(last[1]).alias("b")) if last is not None else F.col("span"))
    mixed = _running(spans.where(within), [], "span", ["finish", "source", "turn", "h", "id", "size", "th", "r"], "size", "place", prefix)
    rest = spans.where(~within).withColumn("place", F.lit(budget + 1).cast("long"))
    taken = F.col("place") <= budget
    every = mixed.select(*rest.columns).unionByName(rest)
    return every.groupBy("id", "source", "size", "th", "n", "r", "source_size", "target").agg(F.sum(taken.cast("long")).alias("copies"), F.min(F.when(taken, F.col("place"))).alias("position"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 7, bucket_rows: int = 4096) -> DataFrame:
    """The mix as (id, source, size, source_size, target, copies, position): one row for each row of ``docs``.

    ``copies`` is how often the mix takes the document (0 to max_repeats), ``position`` the place in tokens where its
    first copy ends in the mix (null if none is taken). The queue's order is the MD5 of seed, id and the number among
    equal rows, for rows without an id or with an id of several texts of the text's hash too, so reruns agree.
    Null texts count 0 words and null sources form a source. Documents without words, and those of a source without
    any (target 0), are spread evenly. Equal finish times are ordered by source, repeat, queue, id and text. Rows that
    repeat an id are documents of their own. An empty table gives no rows; other columns play no part.
    """
    return _decisions(docs, id_col, text_col, source_col, weights, max_repeats, seed, bucket_rows).drop("th", "n", "r")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 7) -> DataFrame:
    """The mix itself: each document as often as ``plan`` takes it, with its columns as they were.

    Rows equal in id, source and text are told apart by their number, so the mix holds as many words as the plan, null
    ids, null sources and repeated rows included. Null and empty texts are documents without words. An empty table
    gives no rows; other columns, also clashing ones, stay as they are."""
    every = _decisions(docs, id_col, text_col, source_col, weights, max_repeats, seed, 4096)
    chosen = Table(every.where("copies > 0 or n > 1").select(*(F.col(c).alias(f"_rx_{c}") for c in ("id", "source", "th", "n", "r", "copies"))), "mix").df
    names = [col(c) for c in docs.columns]
    key = [col(id_col).cast("long").eqNullSafe(F.col("_rx_id")), col(source_col).cast("string").eqNullSafe(F.col("_rx_source")), _text_hash(col(text_col).cast("string")) == F.col("_rx_th")]
    same = key[0] & key[1] & key[2]
    turn = free_name([*docs.columns, "_rx_copies"], "_rx_turn")

    def repeated(rows: DataFrame) -> DataFrame:
        return rows.where("_rx_copies > 0").withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rx_copies")))).select(*names)

    # Merged, however small: for each broadcast on several columns the driver sets 16 MB aside.
    single = repeated(docs.join(chosen.where("_rx_n = 1").hint("merge"), same))
    again = chosen.where("_rx_n > 1")
    if again.isEmpty():
        return single
    # Equal rows are numbered within the task that reads them, and on from the counts of the tasks before it.
    keys = again.where("_rx_r = 1").select("_rx_id", "_rx_source", "_rx_th")
    part, mark = free_name(docs.columns, "_rx_part"), free_name(docs.columns, "_rx_mark")
    here = Table(docs.join(keys.hint("merge"), same).withColumns({part: F.spark_partition_id(), mark: F.monotonically_increasing_id()}), "repeated").df
    own = ["_rx_id", "_rx_source", "_rx_th"]
    counts = here.groupBy(*own, part).agg(F.count(F.lit(1)).alias("_rx_c"))
    before = F.sum("_rx_c").over(W.partitionBy(*own).orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    based = counts.select(*(F.col(c).alias(f"{c}2") for c in own), F.col(part).alias("_rx_p2"), F.coalesce(before, F.lit(0)).alias("_rx_base"))
    numbered = here.withColumn("_rx_in", F.row_number().over(W.partitionBy(*own, part).orderBy(mark)))
    at = (F.col(part) == F.col("_rx_p2")) & F.col("_rx_id").eqNullSafe(F.col("_rx_id2")) & F.col("_rx_source").eqNullSafe(F.col("_rx_source2")) & (F.col("_rx_th") == F.col("_rx_th2"))
    numbered = numbered.join(based.hint("merge"), at).withColumn("_rx_row", F.col("_rx_in") + F.col("_rx_base")).select(*docs.columns, "_rx_row")
    return single.unionByName(repeated(numbered.join(again.hint("merge"), same & (F.col("_rx_row") == F.col("_rx_r")))))


__all__ = ["mix", "plan", "targets"]
