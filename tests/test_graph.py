import pytest

from lamina.config import Retrieval
from lamina.operators import graph, quality, security
from pyspark.sql import functions as F


def test_merges(spark):
    stored = spark.createDataFrame([("a", "old", 1)], "id string, title string, n int")
    new = spark.createDataFrame([("a", "new", None, 1), ("a", "newer", None, 2), ("b", "x", "k", 1), (None, "y", "k", 1)], "id string, title string, kind string, seq int")
    got = {r.id: (r.title, r.n, r.kind) for r in graph.merge_nodes(stored, new, "id", "seq").collect()}
    assert got == {"a": ("newer", 1, None), "b": ("x", None, "k")}
    e = spark.createDataFrame([("a", "R", "b"), ("a", "R", "b"), ("a", "R", "z"), (None, "R", "b")], "s string, k string, t string")
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    assert sorted((r.status, r.t) for r in graph.merge_edges(e, nodes, "s", "t", "k").collect()) == [("merged", "b"), ("source_missing", "b"), ("target_missing", "z")]


def test_hops_on_the_small_graph(spark):
    edges = spark.createDataFrame([("163441", "112025"), ("112924", "95652"), ("117310", "25692"), ("25692", "174218"), ("a", "a"), ("x", None)], "src string, dst string")
    seeds = spark.createDataFrame([("163441",), ("117310",)], "seed string")
    got = {(r.seed, r.node): r.depth for r in graph.reach(seeds, edges, 2).collect()}
    assert got == {("163441", "112025"): 1, ("117310", "25692"): 1, ("117310", "174218"): 2}
    assert graph.reach(seeds, edges, 1).count() == 2
    assert graph.touching(edges, spark.createDataFrame([("25692",)], "id string"), "src", "dst").count() == 2


def test_risk_graph_reconstruction(spark):
    risks = spark.createDataFrame([(f"RR-{i:03d}",) for i in range(1, 13)], "id string")
    controls = spark.createDataFrame([(f"KS-{i:03d}", f"RR-{i:03d}") for i in range(1, 11)], "src string, dst string")
    events = spark.createDataFrame([(f"RR-{i:03d}", f"SK-{i:03d}") for i in range(1, 13)], "src string, dst string")
    assert graph.chain(controls, events).count() == 10
    assert sorted(r.id for r in risks.join(controls.select(F.col("dst").alias("id")), "id", "left_anti").collect()) == ["RR-011", "RR-012"]


def test_roles_fail_closed(spark):
    rows = spark.createDataFrame([("quy chế tiền lương và rủi ro", None), ("Rủi ro", ""), ("khác", "x"), (None, None)], "title string, text string")
    assert [len(r.r) for r in rows.select(security.allowed_roles("title", "text").alias("r")).collect()] == [2, 3, 5, 5]
    parsed = spark.createDataFrame([('["HR"]',), ("nonsense",), ("",), (None,)], "j string").select(security.parse_roles("j").alias("r"))
    assert [r.x for r in parsed.select(security.may_see("r", ["HR", "Staff"]).alias("x")).collect()] == [True, False, False, False]
    assert parsed.filter(security.may_see("r", [])).count() == 0


def test_leakage_is_caught(spark):
    cases = spark.createDataFrame([(1, "a", True), (2, "L", False), (3, "c", True), (4, "M", False)], "query_id int, target string, by_chunk boolean")
    bad = spark.createDataFrame([(2, "b", "L"), (1, "x", "a")], "query_id int, id string, document string")
    good = spark.createDataFrame([(1, "a", None), (2, "b", "L"), (4, "z", "M"), (4, "y", None)], "query_id int, id string, document string")
    assert {r.query_id: (r.leaked, r.found, r.passed) for r in security.leakage(cases, bad, good).collect()} == {
        1: (False, True, True), 2: (True, True, False), 3: (False, False, False), 4: (False, True, True)
    }


def test_planted_leak(spark):
    """A sensitive row whose stored roles were opened by mistake reaches guests, and the audit tells."""
    from lamina.api import SecureRetriever

    rows = [(1, "quy chế tiền lương", ["Admin", "HR"]), (2, "thưởng cuối năm cho cán bộ", ["Admin", "HR", "Guest"]), (3, "lịch làm việc", ["Admin", "HR", "Guest"])]
    corpus = spark.createDataFrame([(i, None, None, None, t, r) for i, t, r in rows], "id long, title string, so_ky_hieu string, article string, text string, roles array<string>")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in (1, 2, 3)], "id long, embedding array<float>")
    s = SecureRetriever(corpus, vectors, lambda df: df.withColumn("logit", F.lit(1.0)))
    asked = corpus.filter("id < 3").select(F.col("id").alias("query_id"), F.col("text").alias("question"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))
    cases = asked.select("query_id", F.col("query_id").cast("string").alias("target"), F.lit(True).alias("by_chunk"))
    got = lambda role: s.ranked(asked, [role], "hybrid_rerank", 10).select("query_id", F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("document"))
    assert {r.query_id: (r.leaked, r.passed) for r in security.leakage(cases, got("Guest"), got("HR")).collect()} == {1: (False, True), 2: (True, False)}


def test_edges_that_roles_may_see(spark):
    nodes = spark.createDataFrame([("a", ["Staff"]), ("b", ["Staff", "HR"]), ("c", ["HR"])], "id string, roles array<string>")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert [tuple(r) for r in graph.allowed_edges(edges, nodes, "src", "dst", ["Staff"]).collect()] == [("a", "b")]
    hits = spark.createDataFrame([(1, "a"), (1, "z")], "query_id int, id string")
    assert [tuple(r) for r in graph.next_hop(hits, edges).collect()] == [(1, "a", "b")]
    assert graph.wipe({"n": nodes})["n"].count() == 0


def test_quality_rows(spark):
    df = spark.createDataFrame([(1, None), (1, "x"), (None, None)], "a int, b string")
    assert {r.column_name: r.n_null for r in quality.null_counts(df, "t").collect()} == {"a": 1, "b": 2}
    assert quality.duplicate_keys(df, ["a"]).collect()[0].n == 2
    e = spark.createDataFrame([("a", "b", "R", "x"), ("a", "a", "R", "x"), ("z", "b", "R", "x"), ("a", "b", "Q", "x"), ("b", "a", "R", " "), ("a", "z", "R", "x")], "source string, target string, relationship_type string, evidence string")
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    got = sorted(str(r.reason) for r in quality.validate_relations(e, nodes, ("R",)).collect())
    assert got == sorted(["None", "self_loop", "unknown_source", "type_not_allowed", "no_evidence", "unknown_target"])


def test_keywords_and_audit(spark):
    rows = spark.createDataFrame([(1, "Bảo hiểm", "rủi ro"), (2, None, "phê duyệt hạn mức"), (3, None, "lao động"), (4, "x", None)], "id int, title string, text string").withColumn("roles", security.allowed_roles("title", "text"))
    assert {r.id: len(r.roles) for r in rows.collect()} == {1: 2, 2: 3, 3: 2, 4: 5}
    assert {r.pattern: (r.n, r.sample) for r in security.tag_audit(rows, "id").collect()}["Admin,HR"] == (2, 1)


def test_parameters():
    Retrieval()
    assert Retrieval.load({"FINAL_TOP_K": " 7 ", "MAX_DISTANCE": "0.5", "RRF_K": ""}) == Retrieval(final_top_k=7, max_distance=0.5)
    for wrong in ({"FINAL_TOP_K": "x"}, {"RERANKER_BATCH": "65"}, {"EMBEDDING_SIZE": "64"}, {"FINAL_TOP_K": "1.5"}):
        with pytest.raises(ValueError):
            Retrieval.load(wrong)
    for wrong in ({"chunk_overlap": 1200}, {"final_top_k": 30}, {"bm25_weight": 0, "semantic_weight": 0}, {"min_rerank_score": 2}, {"context_max_chars": 1000}):
        with pytest.raises(ValueError):
            Retrieval(**wrong)
