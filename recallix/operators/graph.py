"""Graph expansion, traces, communities, and the facts of an episode graph. Edges are (edge_id, src, dst, edge_type, weight)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored




def expand_one_hop(seeds: DataFrame, edges: DataFrame, types: Sequence[str] = ()) -> DataFrame:
    """Edges with either end among the seeds (one column id). Two equi-joins, as an OR would compare all pairs."""
    allowed = edges.where(F.col("edge_type").isin(*types)) if types else edges
    ids = seeds.select("id").distinct()
    out = allowed.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(allowed.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return out.select(*edges.columns).dropDuplicates(["edge_id"])


def touched_nodes(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    return seeds.select("id").unionByName(edges.select(F.col("src").alias("id"))).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def trace(seeds: DataFrame, edges: DataFrame, max_depth: int = 8, directed: bool = True, types: Sequence[str] = (), min_weight: float = 0.0) -> DataFrame:
    """Breadth-first edges from the seeds: (edge_id, depth), each edge once at its smallest depth, ``max_depth`` hops.

    Each hop joins the frontier with the edges; nodes seen before leave it by an anti join. Stops on an empty
    frontier."""
    allowed = edges.where((F.col("weight") >= min_weight) & (F.col("edge_type").isin(*types) if types else F.lit(True))).select("edge_id", "src", "dst")
    if not directed:
        allowed = allowed.unionByName(allowed.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = stored(seeds.select("id").distinct())
    frontier, steps = seen, None
    for depth in range(1, max_depth + 1):
        met = stored(allowed.join(frontier.withColumnRenamed("id", "src"), "src").select("edge_id", "dst").distinct())
        new = met.select("edge_id").distinct().withColumn("depth", F.lit(depth).cast("long"))
        steps = new if steps is None else steps.unionByName(new)
        frontier = stored(met.select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return steps.groupBy("edge_id").agg(F.min("depth").alias("depth"))


def communities(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, community = smallest node reachable) over undirected edges (src, dst).

    Each round takes the smallest label among a node, its neighbours and its label's own label, so that long paths
    close in a logarithmic number of rounds."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = stored(both)
    label = stored(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("label")).withColumnRenamed("src", "node"))
    for _ in range(max_rounds):
        near = both.join(label.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        jump = label.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = label.join(near, "node", "left").join(jump, "label", "left").select("node", F.col("label").alias("old"), F.least("label", "near", "far").alias("label"))
        step = stored(step)
        label = step.select("node", "label")
        if step.where("old != label").isEmpty():
            break
    return label.select("node", F.col("label").alias("community"))


def bulk_edges(ids: DataFrame, edges: DataFrame) -> DataFrame:
    return expand_one_hop(ids, edges)


def entities(text: Column, owner: Column) -> Column:
    """Entity ids of an episode: its capitalised words and its agent, normalised, sorted."""
    names = F.concat(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9_]+(?![A-Za-z0-9_])"), F.lit(0)), F.filter(F.array(owner), lambda x: x != ""))
    keys = F.transform(names, lambda w: F.lower(F.trim(F.regexp_replace(w, r"[^A-Za-z0-9_]+", " "))))
    return F.array_sort(F.array_distinct(F.transform(F.filter(keys, lambda k: k != ""), lambda k: F.concat(F.lit("ent_"), F.replace(k, F.lit(" "), F.lit("_"))))))


def predicate(text: Column) -> Column:
    low = F.lower(text)
    has = lambda *ws: F.greatest(*(F.contains(low, F.lit(w)) for w in ws))
    return F.when(has(" not ", " no "), "NEGATES").when(has(" works ", "work at"), "WORKS_WITH").when(has(" likes ", "love"), "PREFERS").otherwise("RELATED_TO")


def facts(episodes: DataFrame, max_entities: int | None = None) -> DataFrame:
    """One fact for each pair of an episode's entities (episode_id, entities, predicate, valid_at), smaller id first.

    Pairs stay inside one episode's array, whose size is the episode's."""
    own = F.slice("entities", 1, max_entities) if max_entities else F.col("entities")
    pairs = F.flatten(F.transform(own, lambda a, i: F.transform(F.filter(own, lambda b: b > a), lambda b: F.struct(a.alias("src"), b.alias("dst")))))
    return episodes.select("episode_id", "predicate", "valid_at", F.explode(pairs).alias("p")).select("episode_id", "predicate", "valid_at", "p.src", "p.dst")


def close_contradicted(fact: DataFrame) -> DataFrame:
    """invalid_at of each fact: the start of the first later fact of the pair with the other polarity."""
    polarity = F.col("predicate") == "NEGATES"
    later = W.partitionBy("src", "dst").orderBy("valid_at", "episode_id").rowsBetween(1, W.unboundedFollowing)
    yes = F.min(F.when(polarity, F.col("valid_at"))).over(later)
    no = F.min(F.when(~polarity, F.col("valid_at"))).over(later)
    return fact.withColumn("invalid_at", F.when(polarity, no).otherwise(yes))


def temporal_start(text: Column, reference: Column) -> Column:
    """The reference time moved back by "N years ago" or "N days ago" if the text says so."""
    low = F.lower(text)
    years = F.regexp_extract(low, r"(\d{1,4})\s+years?\s+ago", 1)
    days = F.regexp_extract(low, r"(\d{1,6})\s+days?\s+ago", 1)
    return F.when(years != "", F.add_months(reference, -12 * years.cast("int")).cast("timestamp_ntz") + (reference - F.date_trunc("day", reference).cast("timestamp_ntz"))).when(days != "", reference - F.make_dt_interval(days.cast("int"))).otherwise(reference)
