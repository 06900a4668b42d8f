"""Personal data by fixed patterns and information-theoretic sanitisation, with DataFrame operations only (operator 10).

Fixed patterns find the protected entities: mail addresses, IP addresses, card and phone numbers. The method adds terms
that give an entity away: a term that stands near an entity in several documents reveals the share PMI / IC of what
there is to know about it, where PMI is their pointwise mutual information over the documents of the corpus and IC the
entity's information content. Terms at or above one threshold are generalised, at or above a second one removed, in the
documents that hold the entity.

A pattern's matches and the pieces between them give all places without Python: a match starts after the lengths of
what stands before it. The patterns below are those of the contract with possessive loops and a check that a match
doesn't start inside a run that failed already; they match the same texts, and long runs take linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, col

KINDS = ("email", "ip", "card", "phone")
_MAIL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_MAIL})|\G){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}{3,}"
MIN_DOCS, GENERALISE, REMOVE = 3, 0.8, 0.95
_BROADCAST_ROWS = 500_000


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    value = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, doubled(value(i))).otherwise(value(i)))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        short = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
        return F.forall(F.split(m, r"\."), lambda x: F.when(F.length(short(x)) <= 3, short(x).cast("int") <= 255).otherwise(F.lit(False)))
    if kind == "card":
        return _luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


_SPAN = "array<struct<start:int,rank:int,stop:int,value:string>>"


def _running(steps: Column) -> Column:
    """Running sums of an array of whole numbers, the element included. An array that grows by one element is copied each
    time, so sums are taken in blocks of about the root of the length first: n ** 1.5 steps, not n ** 2."""
    nothing = lambda: F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(steps))).cast("int"))
    starts = F.sequence(F.lit(1), F.size(steps), block)
    inside = lambda x: F.aggregate(x, nothing(), lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"] + v)).alias("out")))["out"]
    sums = F.transform(starts, lambda i: inside(F.slice(steps, i, block)))
    # One binding, so that the blocks are summed once.
    whole = lambda blocks: F.flatten(F.zip_with(blocks, F.aggregate(blocks, nothing(), lambda acc, x: F.struct((acc["at"] + F.element_at(x, -1)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"], lambda x, base: F.transform(x, lambda v: v + base)))
    return F.when(F.size(steps) > 0, F.element_at(F.transform(F.array(sums), whole), 1)).otherwise(F.array().cast("array<int>"))


def _places(text: Column, pattern: str, rank: int, valid=None) -> Column:
    """Matches of a pattern as spans, by code points; without a match nothing is built."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))

    def spans_of(x: Column) -> Column:
        found = x["found"]
        stops = _running(F.zip_with(found, F.slice(x["between"], 1, F.size(found)), lambda m, gap: F.length(gap) + F.length(m)))
        every = F.zip_with(found, stops, lambda m, stop: F.struct((stop - F.length(m)).alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), m.alias("value")))
        return F.filter(every, lambda s: valid(s["value"])) if valid else every

    return F.when(text.rlike(pattern), F.element_at(F.transform(F.array(both), spans_of), 1).cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """All valid matches of the four patterns, by start and then by kind."""
    parts = []
    for rank, kind in enumerate(KINDS):
        own = _places(text, PATTERNS[kind], rank, lambda m, k=kind: _valid(k, m))
        sign = {"email": "@", "phone": "+", "ip": "."}.get(kind)
        parts.append(F.when(F.contains(text, F.lit(sign)), own).otherwise(F.array().cast(_SPAN)) if sign else own)
    return F.array_sort(F.concat(*parts))


def _names(spans: Column, names: tuple[str, ...]) -> Column:
    kinds = F.array(*(F.lit(k) for k in names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["stop"])), ",")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    return docs.select(col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("h", F.xxhash64("text"))


def disclosing_terms(source: DataFrame, found: DataFrame, generalise: float = GENERALISE, min_docs: int = MIN_DOCS) -> DataFrame:
    """(entity, term, share) of the terms that reveal at least the share ``generalise`` of an entity.

    ``found`` has (id, h, entity) for each entity found. Every row of the corpus counts as a document, for terms, entities
    and both alike. A term must stand in ``min_docs`` documents of the entity, anywhere in them: fewer give no estimate.
    An entity of fewer documents has no such term, so only texts that hold one of enough documents are read for this."""
    held = found.groupBy("id", "h", "entity").agg(F.count(F.lit(1)).alias("n"))
    with_entity = Table(held.groupBy("entity").agg(F.sum("n").alias("df_e")).where(F.col("df_e") >= min_docs), "entities").df
    often = with_entity.select("entity")
    holders = Table(held.join(F.broadcast(often) if often.count() <= _BROADCAST_ROWS else often, "entity").groupBy("id", "h").agg(F.collect_list("entity").alias("entities"), F.max("n").alias("n")).withColumnsRenamed({"id": "i2", "h": "h2"}), "holders").df
    side = F.broadcast(holders) if holders.count() <= _BROADCAST_ROWS // 10 else holders
    texts = source.join(side, F.col("id").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2"))).dropDuplicates(["id", "h"])
    terms = texts.select("entities", "n", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    joint = Table(terms.select(F.explode("entities").alias("entity"), "term", "n").groupBy("entity", "term").agg(F.sum("n").alias("both")).where(F.col("both") >= min_docs), "joint").df
    wanted = joint.select("term").distinct()
    if wanted.count() <= _BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    words = source.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    # Counted before the join, so that each task sums its own words and only sums meet the wanted terms. An inner join
    # with distinct terms: a semi join would be pushed below the sums again.
    with_term = words.groupBy("term").agg(F.count(F.lit(1)).alias("df_t")).join(wanted, "term")
    total = F.lit(float(source.count()))
    content = F.log(total / F.col("df_e"))
    share = F.when(content > 0, 1 + F.log(F.col("both") / F.greatest("df_t", "both")) / content).otherwise(F.lit(0.0))
    rated = joint.join(with_entity, "entity").join(with_term, "term").withColumn("share", share)
    return rated.where(F.col("share") >= generalise).select("entity", "term", "share")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """What is found: (id, h, base) of every row, and (id, h, terms) of the documents with disclosing terms.

    h is the hash of the text; base and terms are spans (start, rank, stop, value), the terms' without those that
    overlap a base span, with their share as rank 4 (generalise) or 5 (remove)."""
    source = _source(docs, id_col, text_col)
    entities = F.transform("base", lambda s: F.concat_ws(":", F.element_at(F.array(*(F.lit(k) for k in KINDS)), s["rank"] + 1), F.lower(s["value"])))
    base = Table(source.select("id", "h", base_spans(F.col("text")).alias("base")).select("id", "h", "base", F.when(F.size("base") > 0, F.array_distinct(entities)).alias("entities")), "pii").df
    found = base.where("entities is not null").select("id", "h", F.explode("entities").alias("entity"))
    telling = Table(disclosing_terms(source, found, generalise, min_docs), "disclosing").df
    flagged = found.select("id", "h", "entity").join(telling, "entity").groupBy("id", "h", "term").agg(F.max("share").alias("share")).groupBy("id", "h").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares"))
    flagged = Table(flagged.join(base.select("id", "h", "base").dropDuplicates(["id", "h"]).withColumnsRenamed({"id": "i2", "h": "h2"}), F.col("id").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2"))).select("id", "h", "shares", "base"), "flagged").df
    side = flagged.withColumnsRenamed({"id": "i2", "h": "h2"})
    if flagged.count() <= _BROADCAST_ROWS // 10:
        side = F.broadcast(side)
    texts = source.join(side, F.col("id").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2"))).dropDuplicates(["id", "h"])
    places = _places(F.col("text"), TERM, len(KINDS))
    told = F.filter(places, lambda s: F.map_contains_key(F.col("shares"), F.lower(s["value"])) & ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    rated = F.transform(told, lambda s: F.struct(s["start"].alias("start"), F.when(F.element_at(F.col("shares"), F.lower(s["value"])) >= REMOVE, F.lit(5)).otherwise(F.lit(4)).alias("rank"), s["stop"].alias("stop"), s["value"].alias("value")))
    return base.select("id", "h", "base"), texts.select("id", "h", rated.alias("terms"))


def _count(rank: int) -> Column:
    return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    Null and empty texts have no spans. Rows that repeat an id are judged by their own texts, and each row counts
    as a document. Rows without an id stay. An empty table gives no rows; other columns
    play no part."""
    base, terms = spans(docs, id_col, text_col)
    terms = terms.withColumnsRenamed({"id": "i2", "h": "h2"})
    joined = base.join(terms, F.col("id").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2")), "left")
    counts = [_count(r).alias(f"n_{k}") for r, k in enumerate(KINDS)]
    every = F.array_sort(F.concat("base", F.coalesce("terms", F.array().cast(_SPAN))))
    return joined.select("id", *counts, F.sha2(_names(F.col("base"), KINDS), 256).alias("base_sha256"), _names(every, (*KINDS, "term", "term")).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with entities replaced by their kind in capitals, terms above the first threshold by [TERM], and
    terms above the second removed. Overlapping spans of different kinds are replaced once, by the first."""
    base, terms = spans(docs, id_col, text_col)
    terms = terms.withColumnsRenamed({"id": "i2", "h": "h2"})
    marks = base.join(terms, F.col("id").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2")), "left").select("id", "h", F.array_sort(F.concat("base", F.coalesce("terms", F.array().cast(_SPAN)))).alias("marks")).where(F.size("marks") > 0).dropDuplicates(["id", "h"]).withColumnsRenamed({"id": "_rx_id", "h": "_rx_h", "marks": "_rx_marks"})
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    joined = docs.join(marks, col(id_col).cast("long").eqNullSafe(F.col("_rx_id")) & (F.xxhash64(text) == F.col("_rx_h")), "left")
    words = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS), F.lit("[TERM]"), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["stop"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(words, s["rank"] + 1)).alias("out")))
    done = F.aggregate(F.col("_rx_marks"), start, step)
    clean = F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    return joined.select(*(F.when(F.col("_rx_marks").isNull(), col(c)).otherwise(clean).alias(c) if c == text_col else col(c) for c in docs.columns))
