"""Operators by themselves: formulas, limits, order of input, approximate searches against exact ones."""

import math
import struct
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallix.functions import columns as fc
from recallix.operators import filters as fl
from recallix.operators import graph, retrieval
from recallix.operators import materialize as mz
from recallix.operators import memory_algorithms as ma
from recallix.plans import tiers
from recallix.plans.fixtures import Tables
from recallix.plans.planner import QueryRequest, plan
from recallix.sources import files
from recallix.streaming import wal


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def fnv(word):
    h = 2166136261
    for b in word.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def test_hash_and_polarity(spark):
    for w in ("a", "hello", "straße", "漢"):
        assert one(spark, fc.fnv1a(F.lit(w))) == fnv(w)
    assert one(spark, fc.polarity(F.lit(" Never "))) == "negative"
    assert one(spark, fc.space_out(F.lit("a b 漢字"))) == "a b 漢 字"


def test_lexical_scores(spark):
    assert one(spark, fc.lexical_score(F.lit("quick fox"), F.lit("The quick brown fox"))) == 1.0
    assert one(spark, fc.lexical_score(F.lit("quick cat"), F.lit("The quick brown fox"))) == 0.5
    assert one(spark, fc.lexical_score(F.lit(""), F.lit("x"))) == 0.0
    assert one(spark, fc.cold_lexical_score(F.lit("quic fox"), F.lit("quick fox"), F.lit(""))) == 0.5


def test_final_scores_and_seeds(spark):
    rows = [("high", 1 / 61, 0.1), ("mid", 1 / 62, 0.5), ("low", 1 / 63, 1.0)]
    df = spark.createDataFrame(rows, "object_id string, rrf double, f double").withColumns({"importance": F.col("f"), "freshness": F.col("f"), "confidence": F.col("f")})
    got = {r["object_id"]: r for r in retrieval.mark_seeds(retrieval.final_scores(df)).collect()}
    assert max(got, key=lambda k: got[k]["final_score"]) == "low" and got["low"]["is_seed"] and not got["high"]["is_seed"]
    assert math.isclose(got["mid"]["final_score"], 0.125 / 62, abs_tol=1e-9)


def test_admission(spark):
    base = dict(importance=0.8, source_event_ids=["a", "b", "c"], level=2, confidence=0.9)
    df = spark.createDataFrame([(base["importance"], base["source_event_ids"], base["level"], base["confidence"], t) for t in ([], ["noise"])], "importance double, source_event_ids array<string>, level int, confidence double, policy_tags array<string>")
    quiet, noisy = (r["s"] for r in df.select(ma.admission_score().alias("s")).collect())
    assert math.isclose(quiet, 0.25 * 0.8 + 0.2 * 0.6 + 0.25 * 2 / 3 + 0.15 * 0.9) and math.isclose(quiet - noisy, 0.15)


def test_lifecycle_matrix(spark):
    cases = [("", "", 0.5, "candidate"), ("candidate", "active", 0.5, "active"), ("active", "", 0.2, "stale"), ("stale", "", 0.05, "archived"), ("quarantined", "active", 0.9, "active"), ("quarantined", "", 0.9, "quarantined"), ("compressed", "", 0.3, "compressed"), ("odd", "", 0.3, "odd")]
    df = spark.createDataFrame(cases, "c string, s string, r double, want string").withColumn("got", ma.next_lifecycle(F.col("c"), F.col("s"), F.col("r")))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_conflict_rules(spark):
    schema = "memory_id string, agent_id string, memory_type string, content string, confidence double, valid_from timestamp_ntz, valid_to timestamp_ntz, source_event_ids array<string>, lsn long"
    from datetime import datetime as d

    a, b, c = d(2024, 1, 1), d(2024, 1, 2), d(2024, 1, 5)
    rows = [("m1", "x", "preference_constraint", "yes", 0.5, a, b, ["e1"], 1), ("m2", "x", "preference_constraint", "no", 0.5, c, None, ["e2"], 2), ("m3", "x", "factual", "sky", 0.95, a, b, ["e3"], 3), ("m4", "x", "episodic", "sea", 0.1, c, None, ["e9"], 4), ("m5", "y", "episodic", "sea", 0.9, c, None, ["e9"], 5)]
    got = {(r["left_id"], r["right_id"]): r["rule"] for r in ma.conflicts(spark.createDataFrame(rows, schema), F.expr("timestamp_ntz '2024-02-01 00:00:00'")).collect()}
    assert got == {("m1", "m2"): "preference", ("m3", "m4"): "factual"}


def test_trace_and_communities(spark):
    edges = spark.createDataFrame([("e1", "a", "b", "t", 1.0), ("e2", "b", "c", "t", 0.2), ("e3", "c", "a", "t", 1.0), ("e4", "x", "y", "u", 1.0)], "edge_id string, src string, dst string, edge_type string, weight double")
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {(r[0], r[1]) for r in graph.trace(seeds, edges).collect()} == {("e1", 1), ("e2", 2), ("e3", 3)}
    assert {r[0] for r in graph.trace(seeds, edges, 1, directed=False).collect()} == {"e1", "e3"}
    assert {r[0] for r in graph.trace(seeds, edges, min_weight=0.5).collect()} == {"e1"}
    assert {(r[0], r[1]) for r in graph.communities(edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}


def test_long_chain_is_one_community(spark):
    chain = spark.range(1, 300).select(F.format_string("n%04d", "id").alias("src"), F.format_string("n%04d", F.col("id") - 1).alias("dst"))
    assert {r[1] for r in graph.communities(chain).collect()} == {"n0000"}


def test_temporal(spark):
    from datetime import datetime

    ref = F.expr("timestamp_ntz '2024-03-10 08:30:00'")
    assert one(spark, graph.temporal_start(F.lit("It was 2 years ago"), ref)) == datetime(2022, 3, 10, 8, 30)
    assert one(spark, graph.temporal_start(F.lit("3 days ago"), ref)) == datetime(2024, 3, 7, 8, 30)


def test_block_search_equals_columns(spark, folder):
    t = Tables(spark, folder)
    q = t.embeddings.where("vec_id < 7")
    for metric in ("ip", "cosine", "l2"):
        a = {(r["query_id"], r["rank"]): (r["object_id"], round(r["score"], 5)) for r in retrieval.knn(t.embeddings, q, 5, metric).collect()}
        b = {(r["query_id"], r["rank"]): (r["object_id"], round(r["score"], 5)) for r in retrieval.knn_columns(t.embeddings, q, 5, metric).collect()}
        assert a == b
    small = {tuple(r) for r in retrieval.knn(t.embeddings, q, 5, max_query_bytes=1100).collect()}
    assert small == {tuple(r) for r in retrieval.knn(t.embeddings, q, 5).collect()}


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_search_by_either_side_equals_all_products(spark, metric):
    """Ties at the last place, null and narrow vectors, vectors of zeros; rows sent whole, rows in blocks, queries sent."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(900, 4)), 1)
    x[::3], x[5] = x[0], 0
    rows = [(i * 7 % 900, v.tolist()) for i, v in enumerate(x)]
    odd = [(1001, None), (1002, [1.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(5)
    ids = np.array([r[0] for r in rows])
    norm = np.sqrt((x * x).sum(axis=1))
    s = x @ x.T
    if metric == "l2":
        s = -((x[:, None] - x[None]) ** 2).sum(axis=2)
    elif metric == "cosine":
        s = np.divide(s, norm[:, None] * norm[None], out=np.zeros_like(s), where=(norm[:, None] * norm[None]) != 0)
    s = np.round(s, 6) + 0.0
    want = {(int(ids[i]), int(ids[j]), place + 1) for i in range(len(x)) for place, j in enumerate(np.lexsort((ids, -s[i]))[:9])}
    for most in (64 << 20, 9_000):
        got = {(r["query_id"], r["object_id"], r["rank"]) for r in retrieval.knn(df, df, 9, metric, max_query_bytes=most).collect()}
        assert got == want
    few = {(r["query_id"], r["object_id"], r["rank"]) for r in retrieval.knn(df, df.where("vec_id % 10 = 0"), 9, metric).collect()}
    assert few == {w for w in want if w[0] % 10 == 0}


def test_search_of_many_queries_takes_bounded_memory(spark, monkeypatch, tmp_path):
    """A task's scores of all queries with a batch of rows would take 240 MB here, and were held several times over."""
    import os

    rng = np.random.default_rng(4)
    ids = range(6000)
    df = spark.createDataFrame([(i, v) for i, v in zip(ids, rng.normal(size=(6000, 8)).tolist(), strict=True)], "vec_id long, embedding array<double>").repartition(1)
    path = str(tmp_path)
    mapped, pandas = type(df).mapInArrow, type(df).mapInPandas

    def watched(f):
        def run(batches):
            import tracemalloc

            tracemalloc.start()
            yield from f(batches)
            with open(os.path.join(path, str(os.getpid())), "w") as out:
                out.write(str(tracemalloc.get_traced_memory()[1]))
            tracemalloc.stop()

        return run

    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: mapped(self, watched(f), schema))
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, f, schema: pandas(self, watched(f), schema))
    assert retrieval.knn(df, df, 3).count() == 18000
    peaks = [int(open(os.path.join(path, x)).read()) for x in os.listdir(path)]
    assert peaks and max(peaks) < 150 << 20


def test_inverted_lists_recall(spark, folder):
    t = Tables(spark, folder)
    q = t.embeddings.where("vec_id % 50 = 0")
    exact = {(r["query_id"], r["object_id"]) for r in retrieval.knn(t.embeddings, q, 10).collect()}
    near = {(r["query_id"], r["object_id"]) for r in retrieval.InvertedLists(t.embeddings, 8).search(q, 10, probes=8).collect()}
    assert near == exact
    some = {(r["query_id"], r["object_id"]) for r in retrieval.InvertedLists(t.embeddings, 8).search(q, 10, probes=6).collect()}
    assert len(some & exact) / len(exact) >= 0.9


def test_mmr_prefers_variety(spark):
    df = spark.createDataFrame([(1, "a", 1.0, ["x", "y"]), (1, "b", 0.99, ["x", "y"]), (1, "c", 0.9, ["z"])], "query_id long, object_id string, score double, tokens array<string>")
    assert [r["object_id"] for r in retrieval.mmr(df, 3).orderBy("place").collect()] == ["a", "c", "b"]


def test_order_of_input_does_not_matter(spark, folder):
    t = Tables(spark, folder)
    mixed = t.doc.repartition(7, F.rand(3))
    req = QueryRequest(query_text="the eron of thion")
    assert [tuple(r) for r in plan(req, t.doc).orderBy("rank").collect()] == [tuple(r) for r in plan(req, mixed).orderBy("rank").collect()]


def test_filter_first_fills_the_list(spark, folder):
    t = Tables(spark, folder)
    first = plan(QueryRequest(query_text="the", filter_first=True), t.doc)
    assert first.count() == 10 and plan(QueryRequest(mode="filter_only"), t.doc).count() <= 10


def test_documents_from_parts(spark):
    parts = spark.createDataFrame([("b1", 1, 2, "world"), ("b1", 0, 2, "hello "), ("b1", 0, 2, "hello "), ("b2", 0, 2, "half")], "batch_id string, idx int, total int, text string")
    assert [tuple(r) for r in files.assemble_documents(parts).collect()] == [("b1", "hello world")]


@pytest.mark.parametrize("kind", ["fvecs", "fbin"])
def test_vector_files(spark, tmp_path, kind):
    x = np.arange(12, dtype="<f4").reshape(3, 4)
    raw = b"".join(struct.pack("<i", 4) + r.tobytes() for r in x) if kind == "fvecs" else struct.pack("<ii", 3, 4) + x.tobytes()
    (tmp_path / f"v.{kind}").write_bytes(raw)
    got = sorted((r["vec_id"], list(r["embedding"])) for r in files.read_vectors(spark, str(tmp_path), kind).collect())
    assert got == [(i, [float(v) for v in x[i]]) for i in range(3)]


def test_json_events_and_lsn(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"event_id":"e2","event_time":"2024-01-02"}\nnot json\n{"event_id":"e1","event_time":"2024-01-01","payload":{"text":"hi"}}\n')
    ev = files.with_lsn(files.read_events(spark, str(tmp_path)), 100, ["event_time"])
    assert sorted((r["event_id"], r["lsn"]) for r in ev.collect()) == [("e1", 101), ("e2", 102)]


def test_purge_cascades(spark, folder):
    t = Tables(spark, folder)
    stay, dep = files.purge(t.memory, F.col("importance") < 0.2, {"policy": (t.policy, "object_id")}, "memory_id")
    left = {r[0] for r in stay.select("memory_id").collect()}
    assert {r[0] for r in dep["policy"].select("object_id").collect()} <= left


def test_partial_upsert_versions(spark, folder):
    t = Tables(spark, folder)
    twice = t.ev.unionByName(t.ev.withColumn("lsn", F.col("lsn") + 999_999))
    a = mz.state_versions(mz.states(t.ev)).select("state_id", "event_id", "version", "valid_to")
    assert a.exceptAll(mz.state_versions(mz.states(twice)).select("state_id", "event_id", "version", "valid_to")).isEmpty()


def test_stream_equals_batch(spark, folder, tmp_path):
    t = Tables(spark, folder)
    src = tmp_path / "log"
    t.ev.repartition(3).write.parquet(str(src))
    stream = spark.readStream.schema(t.ev.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    for _ in range(2):  # the second run finds nothing new
        wal.project(stream, str(tmp_path / "cp"), str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "edges")).drop("batch")
    want = mz.derived_edges(t.ev)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_stream_counts_state(spark, folder, tmp_path):
    t = Tables(spark, folder)
    t.ev.repartition(2).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(t.ev.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    q = wal.every_nth(stream, 5).writeStream.format("memory").queryName("nth").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r[0], r[1]) for r in spark.table("nth").collect()}
    want = {(r["agent_id"], i) for r in t.ev.groupBy("agent_id").count().collect() for i in range(5, r["count"] + 1, 5)}
    assert got == want


def test_watermark_modes(spark):
    log = spark.createDataFrame([(i,) for i in range(1, 11)], "lsn long")
    assert wal.visible_watermark(log, log.where("lsn != 7")).first()[0] == 6
    assert [wal.read_at(log, m, 6, 2).count() for m in ("strict", "bounded", "eventual")] == [6, 8, 10]


def test_scan_reads_only_what_it_needs(spark, folder):
    t = Tables(spark, folder)
    text = t.raw("lineitem").where("l_quantity > 45").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in text and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


def test_retries_settle_every_row_once(spark):
    rows = spark.createDataFrame([(1, 1), (2, 3), (3, 9), (3, 9), (4, None)], "id int, works_at int")
    calls = []

    def attempt(open_rows, n):
        calls.append(open_rows.count())
        return open_rows.withColumn("ok", F.col("works_at") <= n)

    got = sorted(tuple(r) for r in wal.project_with_retry(rows, attempt, 3, 0).select("id", "attempts", "outcome").collect())
    assert got == [(1, 1, "visible"), (2, 3, "visible"), (3, 3, "dead_letter"), (3, 3, "dead_letter"), (4, 3, "dead_letter")] and calls == [5, 4, 4]
    assert wal.project_with_retry(rows.where("id = 1"), attempt, 3, 0).count() == 1 and wal.project_with_retry(rows.limit(0), attempt, 3, 0).count() == 0


def test_shares_need_owner_and_contract(spark):
    contracts = spark.createDataFrame([("c1", "w1", ["a"], [], "", [], ["reader"], ""), ("c2", "", [], [], "agent:a", [], [], "*")], "contract_id string, workspace_id string, derive_agents array<string>, derive_roles array<string>, derive_acl string, read_agents array<string>, read_roles array<string>, read_acl string")
    agents = spark.createDataFrame([("b", "reader"), ("c", "writer")], "agent_id string, role string")
    asked = [("m", "a", "w1", "a", "b", "c1", "shared"), ("m", "a", "w1", "a", "c", "c1", "read_denied"), ("m", "a", "w2", "a", "b", "c1", "other_scope"), ("m", "a", None, "a", "b", "c1", "other_scope"), ("m", "z", "w1", "a", "b", "c1", "not_owner"), ("m", "a", "w1", "a", "a", "c9", "no_op"), ("m", "a", "w1", "a", "b", "c9", "contract_not_found"), ("m", "", "w1", "z", "c", "c2", "derive_denied"), ("m", None, "", "a", "z", "c2", "shared"), ("m", "a", "", "a", "z", None, "shared"), ("m", "a", "", "a", " ", "", "invalid"), (None, "a", "", "a", "b", "", "invalid")]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(asked)], "i int, memory_id string, owner string, workspace_id string, from_agent string, to_agent string, contract_id string, want string")
    got = fl.share_requests(rows, contracts, agents).orderBy("i").collect()
    assert [r["outcome"] for r in got] == [r[-1] for r in asked]
    assert [r["shared_id"] for r in got if r["outcome"] == "shared"] == ["shared_m_to_b", "shared_m_to_z", "shared_m_to_z"]


def test_tiers(spark):
    docs = spark.createDataFrame([("h1", "alpha beta", "", 1, "hot"), ("h2", "alpha", "", 1, "hot"), ("w1", "alpha beta", "", 1, "warm"), ("c1", "beta", "alpha beta", 5, "cold"), ("c2", "alpha", "", 10, "cold"), ("c3", None, None, 3, "cold")], "memory_id string, content string, summary string, version int, tier string")
    ids = lambda df: [r["object_id"] for r in df.orderBy("rank").collect()]
    assert ids(tiers.tiered_search(docs, "alpha beta", 2)) == ["h1", "h2"]
    assert ids(tiers.tiered_search(docs, "alpha beta", 2, True)) == ["h1", "h2"]
    assert set(ids(tiers.tiered_search(docs, "alpha beta", 3))) == {"h1", "h2", "w1"}
    assert set(ids(tiers.tiered_search(docs, "alpha beta", 9, True))) == {"h1", "h2", "w1", "c1", "c2"}
    cold = docs.where("tier = 'cold'")
    assert [(r["object_id"], r["lexical"], r["recency"], r["score"]) for r in tiers.cold_candidates(cold, "alpha beta", 9).collect()] == [("c1", 1.0, 0.5, 1.05), ("c2", 0.5, 1.0, 0.6)]
    assert ids(tiers.cold_candidates(cold, " ", 9)) == ["c2", "c1", "c3"] and tiers.cold_candidates(cold.limit(0), "alpha", 9).count() == 0


def test_handoffs_change_roles_in_order(spark):
    agents = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "agent_id string, role string")
    rows = [(1, "a", "b", "s", "planner", "executor"), (2, "b", "a", "s", "critic", ""), (3, "", "c", "s", "p", "q"), (4, "a", "z", None, "", "q"), (5, "c", "c", "s", "giver", "receiver")]
    handoffs = spark.createDataFrame(rows, "seq long, from_agent string, to_agent string, session_id string, role_from string, role_to string")
    assert sorted(tuple(r) for r in mz.apply_handoffs(agents, handoffs).collect()) == [("a", "planner"), ("b", "critic"), ("c", "giver")]
    events = mz.handoff_events(handoffs).orderBy("seq").collect()
    assert [(r["event_id"], r["agent_id"], r["payload"]["to_agent"]) for r in events] == [("handoff_1", "a", "b"), ("handoff_2", "b", "a"), ("handoff_4", "a", "z"), ("handoff_5", "c", "c")]


def test_blocks_of_rows_leave_k_hits_of_a_query_in_all(spark, monkeypatch):
    """Each block's k hits of each query were written and ranked together at the end: blocks x queries x k rows."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(700, 4)).tolist())], "vec_id long, embedding array<double>").repartition(3)
    ranked, rows = retrieval.top_k_per, []
    monkeypatch.setattr(retrieval, "top_k_per", lambda found, *rest: rows.append(found.count()) or ranked(found, *rest))
    got = retrieval.knn(df, df, 6, max_query_bytes=4_000)
    assert rows == [700 * 6]
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in retrieval.knn(df, df, 6).collect()}


def test_grouped_hits_are_dealt_out_once(spark):
    """Heads were joined back, so the hits, and the search they come from, were computed and shuffled twice."""
    rng = np.random.default_rng(6)
    rows = [(int(q), int(i), float(s), None if g == 3 else int(g)) for i, (q, s, g) in enumerate(zip(rng.integers(0, 20, 400), np.round(rng.normal(size=400), 1), rng.integers(0, 6, 400), strict=True))]
    hits = spark.createDataFrame(rows, "query_id long, object_id long, score double, label int")
    found = retrieval.grouped_hits(hits, "label", limit=3, offset=1, group_size=2)
    assert found._jdf.queryExecution().sparkPlan().toString().count("LogicalRDD") + found._jdf.queryExecution().sparkPlan().toString().count("Scan ExistingRDD") == 1
    want = set()
    for q in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        labels = list(dict.fromkeys(r[3] for r in own))
        for no, label in enumerate(labels, 1):
            if 1 < no <= 4 and label is not None:
                want |= {(q, r[1], place, no) for place, r in enumerate([r for r in own if r[3] == label][:2], 1)}
    assert {(r["query_id"], r["object_id"], r["in_group"], r["group_no"]) for r in found.collect()} == want


@pytest.mark.parametrize("name, k", [("r38_reduce_results", 15), ("r41_sub_request_reduce", 8)])
def test_pages_of_hits_take_no_more_than_their_end(spark, folder, monkeypatch, name, k):
    """Both kept 40 hits of each query, joined them with labels that they don't return, and ranked them again."""
    from recallix import catalog

    asked, knn = [], retrieval.knn
    monkeypatch.setattr(retrieval, "knn", lambda base, queries, most, *rest: asked.append(most) or knn(base, queries, most, *rest))
    plan = catalog.queries()[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert asked == [k] and "Join" not in plan


@pytest.mark.parametrize("case", ["equal", "nan", "carried"])
def test_search_memory_is_bounded_where_scores_are_equal(case):
    rng = np.random.default_rng(5)
    q, b = rng.integers(-3, 4, (512, 16)).astype(np.float32), rng.integers(-3, 4, (8192, 16)).astype(np.float32)
    if case != "nan":
        b[:] = b[0]
    else:
        b[7] = np.nan
    ids = np.arange(8192)
    none = (np.zeros((512, 0)), np.zeros((512, 0), np.int64))
    screens = retrieval._screen(q, "ip"), retrieval._screen(b, "ip")
    best = retrieval._keep_best(none, q, b, ids, screens, 3, "ip", False) if case == "carried" else none
    tracemalloc.start()
    score, own = retrieval._keep_best(best, q, b, ids - 4000 if case == "carried" else ids, screens, 3, "ip", False)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 60, f"{peak:.0f} MB for one tile"
    s = np.round(q.astype(np.float64) @ b.astype(np.float64).T, 6)
    for i in range(0, 512, 37):
        if case == "nan":
            s[i, 7] = -np.inf
        all_ids, all_s = (np.concatenate([ids, ids - 4000]), np.tile(s[i], 2)) if case == "carried" else (ids, s[i])
        want = np.lexsort((all_ids, -all_s))[:3]
        assert own[i].tolist() == all_ids[want].tolist() and score[i].tolist() == all_s[want].tolist()


@pytest.mark.parametrize("metric, odd", [("ip", None), ("cosine", None), ("ip", "nan"), ("ip", "repeated id"), ("ip", "distinct")])
def test_copies_of_vectors_are_searched_once(spark, monkeypatch, metric, odd):
    """All rows were scored against all rows, however many of them were copies."""
    rng = np.random.default_rng(7)
    x = rng.integers(-2, 3, (90, 3)).astype(float)[rng.integers(0, 90, 600)]
    x[550:], x[5], x[6] = x[0], -0.0, 0.0
    if odd == "distinct":
        x = rng.normal(size=(600, 3))
    rows = [(i * 7 % 600, v.tolist()) for i, v in enumerate(x)] + [(900, None), (None, [1.0, 2.0, 3.0]), (901, [1.0])]
    rows += {"nan": [(902, [1.0, float("nan"), 0.0])], "repeated id": [(0, [9.0, 9.0, 9.0])]}.get(odd, [])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)

    def found():
        totals = retrieval.knn(df, df, 5, metric, each=lambda hits: hits.groupBy("query_id", (F.col("object_id") % 3).alias("label")).agg(F.count("score").alias("n"), F.max("score").alias("best")))
        return [sorted(map(repr, made.collect())) for made in (retrieval.knn(df, df.where("vec_id < 560 or vec_id > 890"), 5, metric), totals)]

    want, searched, search = found(), [], retrieval._knn_of_rows
    monkeypatch.setattr(retrieval, "_MANY_PAIRS", 1)
    monkeypatch.setattr(retrieval, "_knn_of_rows", lambda base, queries, n, *rest: searched.append(n) or search(base, queries, n, *rest))
    assert found() == want
    assert max(searched) <= 91 if odd is None else min(searched) >= 500
