import math

import pytest

from lamina.operators import dense, fusion, lexical, metrics
from lamina.functions.scores import sigmoid, vector_problem
from pyspark.sql import functions as F


def test_bm25_against_plain_okapi_and_ties(spark, tmp_path):
    docs = {1: "lãi suất tài sản", 2: "tài sản bảo đảm", 3: "bảo đảm bảo đảm", 5: "tài sản bảo đảm", 6: None, 7: "...", 8: " \n", 9: "khác hẳn"}
    corpus = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    asked = spark.createDataFrame([(1, "Tài sản, tài sản suất"), (2, "chưa gặp"), (3, ",.")], "query_id long, question string")
    lexical.write_index(corpus, "doc_id", "text", str(tmp_path / "i"))
    index = lexical.read_index(spark, str(tmp_path / "i"))
    got = {r.id: r.score for r in lexical.bm25_scores(index, lexical.asked_terms(asked)).collect()}
    words = {k: v.split() if v != "..." else [] for k, v in docs.items() if v and v.strip()}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    df = {t: sum(t in w for w in words.values()) for w in words.values() for t in w}
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}
    want = {}
    for k, w in words.items():
        s = sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in "tài sản tài sản suất".split() if t in idf)
        if set(w) & {"tài", "sản", "suất"}:
            want[k] = round(s, 6)
    assert got == pytest.approx(want, abs=2e-6)
    # all documents are ranked: those without a shared term at 0, before negative scores; a question of unknown terms gets the least ids
    every = sorted(((want.get(k, 0.0), k) for k in words), key=lambda x: (-x[0], x[1]))
    ranked = lexical.bm25_top_k(index, asked, 6).orderBy("query_id", "rank").collect()
    assert [r.id for r in ranked if r.query_id == 1] == [k for _, k in every[:6]]
    assert [(r.id, r.score) for r in ranked if r.query_id == 2] == [(k, 0.0) for k in sorted(words)[:6]] and not any(r.query_id == 3 for r in ranked)
    few = spark.createDataFrame([(3,), (7,)], "id long")
    assert [r.id for r in lexical.bm25_top_k(index, asked, 6, few).orderBy("rank").collect() if r.query_id == 1] == [3, 7]
    top = lexical.top_k(spark.createDataFrame([(1, 5, 0.5), (1, 2, 0.5), (1, 9, 0.1)], "query_id long, id long, score double"), 2)
    assert [r.id for r in top.orderBy("rank").collect()] == [2, 5]


def test_bm25_best_are_taken_where_documents_lie(spark, tmp_path, monkeypatch):
    """In small blocks and parts the k best are those of all pairs, which are never made."""
    import random

    rng = random.Random(3)
    words = [f"t{i}" for i in range(12)]
    rows = [(f"d{i:03d}", " ".join(rng.choices(words, weights=range(12, 0, -1), k=rng.randint(1, 9)))) for i in range(400)]
    asked = spark.createDataFrame([(q, " ".join(rng.choices(words, k=4))) for q in range(9)] + [(9, "xa lạ")], "query_id long, question string")
    lexical.write_index(spark.createDataFrame(rows, "id string, text string").repartition(3), "id", "text", str(tmp_path / "i"))
    index = lexical.read_index(spark, str(tmp_path / "i"))
    scores = {(r.query_id, r.id): r.score for r in lexical.bm25_scores(index, lexical.asked_terms(asked)).collect()}
    want = {q: sorted((-scores.get((q, i), 0.0), i) for i, _ in rows)[:7] for q in range(10)}

    def refused(*_):
        raise AssertionError("all pairs of a question and a document")

    monkeypatch.setattr(lexical, "bm25_scores", refused)
    for name, value in (("PART", 10), ("BLOCK", 64), ("CELLS", 1)):
        monkeypatch.setattr(lexical, name, value, raising=False)
    got = lexical.bm25_top_k(index, asked, 7).orderBy("query_id", "rank").collect()
    assert {q: [(-r.score, r.id) for r in got if r.query_id == q] for q in range(10)} == want


def test_dense_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [(99, [0.0] * 8)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = spark.createDataFrame(rows[:3], "query_id long, vector array<float>")
    got = {(r.query_id, r.rank): r.id for r in dense.dense_top_k(corpus, asked, 5).collect()}
    m = np.array([r[1] for r in rows[:60]], dtype="float32").astype("float64")
    for q in range(3):
        d = np.round(1 - m @ m[q] / np.linalg.norm(m, axis=1) / np.linalg.norm(m[q]), 6)
        assert [got[q, r] for r in range(1, 6)] == [int(i) for i in np.lexsort((np.arange(60), d))[:5]]


def test_dense_in_parts_and_through_lists(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.2 * rng.normal(size=8)]) for i in range(240)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = spark.createDataFrame(rows[::5], "query_id long, vector array<float>")
    exact = sorted(map(tuple, dense.dense_top_k(corpus, asked, 5).collect()))
    found = dense.fit_lists(corpus, lists=6, sample=100)
    stored, probing = dense.with_lists(corpus, found, "embedding"), dense.with_lists(asked, found, "vector", 2)
    got = dense.dense_top_k(stored, probing, 5)
    assert stored.filter("lists IS NOT NULL").count() == 240 and dense.recall(got, dense.dense_top_k(corpus, asked, 5)).first().recall >= 0.9
    monkeypatch.setattr(dense, "QUERY_BYTES", 1000)
    monkeypatch.setattr(dense, "BLOCK", 3)
    assert sorted(map(tuple, dense.dense_top_k(corpus, asked, 5).collect())) == exact
    assert dense.dense_top_k(corpus.limit(0), asked, 5).count() == 0 and dense.dense_top_k(corpus, asked.limit(0), 5).count() == 0


def test_collection(spark, tmp_path):
    from datetime import datetime

    store = dense.Collection.open(spark, str(tmp_path), "semantic", "m", 2)
    schema = "id string, embedding array<float>, arrived timestamp"
    store.upsert(spark.createDataFrame([("a", [1.0, 0.0], datetime(2024, 1, 1)), ("b", [1.0, 1.0], datetime(2024, 1, 1))], schema))
    store.upsert(spark.createDataFrame([("a", [0.0, 1.0], datetime(2024, 1, 2))], schema))
    again = dense.Collection.open(spark, str(tmp_path), "semantic", "m", 2)
    assert {r.id: r.embedding for r in again.read().collect()} == {"a": [0.0, 1.0], "b": [1.0, 1.0]}
    with pytest.raises(Exception, match="bad vector"):
        again.upsert(spark.createDataFrame([("c", [0.0, 0.0], datetime(2024, 1, 2))], schema))
    assert again.count() == 2 and dense.Collection.open(spark, str(tmp_path), "semantic", "m", 2, reset=True).count() == 0


def test_upsert_and_manifest(spark):
    schema = "id string, embedding array<double>, arrived int"
    stored = spark.createDataFrame([("a", [1.0, 0.0], 0)], schema)
    new = spark.createDataFrame([("a", [0.0, 1.0], 1), ("a", [0.5, 1.0], 2), ("b", [1.0, 1.0], 1)], schema)
    assert {r.id: r.embedding for r in dense.upsert_vectors(stored, new, 2).collect()} == {"a": [0.5, 1.0], "b": [1.0, 1.0]}
    bad = spark.createDataFrame([("c", [0.0, 0.0], 1)], schema)
    with pytest.raises(Exception, match="bad vector: zero"):
        dense.upsert_vectors(stored, bad, 2).collect()
    with pytest.raises(ValueError):
        dense.check_manifest({"strategy": "a"}, {"strategy": "b"})
    assert dense.collection_name("Semantic", 768, "m") == dense.collection_name("semantic", 768, "m")
    problems = spark.createDataFrame([([],), ([1.0],), ([float("nan"), 1.0],), ([0.0, 0.0],), ([1.0, 2.0],), (None,)], "v array<double>").select(vector_problem("v", 2).alias("p")).collect()
    assert [r.p for r in problems] == ["empty", "dimension", "not_finite", "zero", None, "empty"]


def test_rrf_expected_values(spark):
    lex = spark.createDataFrame([(1, "c1", 1, 2.0), (1, "c2", 2, 1.0)], "query_id int, id string, rank int, score double")
    sem = spark.createDataFrame([(1, "c3", 1, 0.1), (1, "c1", 2, 0.2)], "query_id int, id string, rank int, distance double")
    got = {r.id: (round(r.rrf_score, 6), r.fused_rank) for r in fusion.fuse_two(lex, sem).collect()}
    assert got == {"c1": (round(1 / 61 + 1 / 62, 6), 1), "c3": (round(1 / 61, 6), 2), "c2": (round(1 / 62, 6), 3)}
    assert fusion.fuse_two(lex, None, weights=(1.0, 0.0)).count() == 2
    with pytest.raises(ValueError):
        fusion.fuse_two(lex, sem, weights=(0.0, 0.0))
    told = lex.withColumn("text", F.lit("x")), sem.withColumn("text", F.lit("x"))
    assert fusion.fuse_two(*told, payload=("text",)).filter("text = 'x'").count() == 3
    with pytest.raises(Exception, match="metadata mismatch for c1"):
        fusion.fuse_two(told[0], sem.withColumn("text", F.lit("y")), payload=("text",)).collect()
    tie = fusion.fuse_two(lex.filter("id = 'c2'").withColumn("rank", F.lit(1)), sem.filter("id = 'c3'"), secure=True)
    assert [r.id for r in tie.orderBy("fused_rank").collect()] == ["c2", "c3"]  # lexical rows first
    t = fusion.fusion_trace(fusion.fuse_two(lex, sem)).first()
    assert (t.bm25_candidates, t.semantic_candidates, t.union_count, t.overlap_count) == (2, 2, 3, 1)


def test_multi_query_expected_values(spark):
    hits = spark.createDataFrame([(1, "Q0", "c1", 1), (1, "Q0", "c2", 2), (1, "Q1", "c1", 2), (1, "Q1", "c3", 1)], "query_id int, variant_id string, id string, rank int")
    rows = {r.id: r for r in fusion.fuse_many(hits).collect()}
    assert rows["c1"].score == pytest.approx(1.5 / 61 + 1 / 62, abs=1e-8) and rows["c1"].variants == ["Q0", "Q1"] and rows["c1"].ranks == {"Q0": 1, "Q1": 2}
    assert [x for x, _ in sorted(rows.items(), key=lambda x: x[1].fused_rank)] == ["c1", "c2", "c3"]


def test_multi_query_mismatch_and_status(spark):
    hits = spark.createDataFrame([(1, "Q0", "c1", 1, "x"), (1, "Q10", "c1", 2, "x"), (1, "Q2", "c1", 2, "x")], "query_id int, variant_id string, id string, rank int, text string")
    assert fusion.fuse_many(hits, payload=("text",)).first().variants == ["Q0", "Q2", "Q10"]
    with pytest.raises(Exception, match="metadata mismatch for c1"):
        fusion.fuse_many(hits.withColumn("text", F.col("variant_id")), payload=("text",)).collect()
    variants = spark.createDataFrame([(q, v) for q in (1, 2, 3) for v in ("Q0", "Q1")], "query_id int, variant_id string")
    failed = spark.createDataFrame([(1, "Q1"), (2, "Q0")], variants.schema)
    assert {r.query_id: r.status for r in fusion.multi_query_status(variants, failed).collect()} == {1: "multi_query_partial", 2: "multi_query_failed", 3: "multi_query_success"}


def test_parent_rerank_trace_and_metrics(spark):
    p = spark.createDataFrame([(1, f"p{i}", i, x) for i, x in enumerate([0.1, -2.0, 3.0, 2.0], 1)], "query_id int, parent_id string, parent_rank int, logit double")
    rows = {r.parent_id: r for r in fusion.rerank_parents(p, candidates=4, keep=3).collect()}
    assert [(x, rows[x].rerank_rank, rows[x].rank_change, rows[x].accepted) for x in ("p3", "p4", "p1", "p2")] == [("p3", 1, 2, True), ("p4", 2, 2, True), ("p1", 3, -2, True), ("p2", 4, -2, False)]
    assert round(rows["p2"].rerank_score, 3) == 0.119 and not fusion.rerank_parents(p.filter("logit < 0")).first().accepted
    kids = spark.createDataFrame([(1, "aa"), (1, "bbb")], "query_id int, text string")
    kept = spark.createDataFrame([(1, "x" * 12)], "query_id int, text string")
    t = fusion.parent_trace(kids, p.select("query_id"), kept, 2).first()
    assert (t.n_children, t.n_parents, t.dropped_by_limit, t.dropped_by_budget, t.child_chars, t.parent_chars, t.expansion_factor) == (2, 4, 2, 1, 5, 12, 2.4)
    acc = spark.createDataFrame([(1, "p9", 1, ["a"], "xy"), (1, "p1", 2, ["b", "c"], "z")], "query_id int, parent_id string, rank int, supporting_ids array<string>, text string")
    gold = lambda *x: spark.createDataFrame([(1, i) for i in x], "query_id int, id string")
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    m = {r.query_id: tuple(r)[1:] for r in metrics.parent_metrics(acc, gold("p1", "p2"), gold("a", "b", "q", "r"), asked).collect()}
    assert m == {1: (0.5, 0.5, 0.5, 3), 2: (0.0, 0.0, 0.0, 0)}
    got = metrics.dcg_helper(spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 1, 0)], "query_id int, rank int, relevance int"), 5).orderBy("query_id").collect()
    assert got[0].ndcg == pytest.approx(1 / math.log2(3), abs=1e-6) and got[1].ndcg == 0.0


def test_parent_score_and_budget(spark):
    kids = spark.createDataFrame([(1, f"c{i}", i, ["Q0"]) for i in range(1, 5)], "query_id int, id string, fused_rank int, variants array<string>")
    reg = spark.createDataFrame([("c1", "p1"), ("c2", "p1"), ("c3", "p2"), ("c4", "p3")], "id string, parent_id string")
    rows = {r.parent_id: r.parent_score for r in fusion.score_parents(kids, reg, cap=2).collect()}
    assert rows["p1"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-8)
    first = fusion.score_parents(kids, reg, cap=1).filter("parent_id = 'p1'").first()
    assert (first.scoring_ids, first.supporting_ids, first.support_query_ids, first.anchor_id) == (["c1"], ["c1", "c2"], ["Q0"], "c1")
    with pytest.raises(Exception, match="no parent: c4"):
        fusion.score_parents(kids, reg.filter("id <> 'c4'")).collect()
    for sizes, kept in (((200, 1200, 100), ["p1", "p3"]), ((1200, 200, 100), ["p1"])):
        p = spark.createDataFrame([(1, f"p{i + 1}", i + 1, n) for i, n in enumerate(sizes)], "query_id int, parent_id string, parent_rank int, n_chars int")
        got = fusion.keep_within_budget(p, 1000).orderBy("context_rank").collect()
        assert [r.parent_id for r in got] == kept and got[0].first_exceeds_budget == (sizes[0] > 1000)


def test_rerank_gates_and_sigmoid(spark):
    c = spark.createDataFrame([(1, i, i, x) for i, x in enumerate([0.1, 0.2, 0.3, 0.4, 10.0], 1)], "query_id int, id int, fused_rank int, logit double")
    best = fusion.rerank(c, "logit").orderBy("rerank_rank").first()
    assert best.id == 5 and best.rank_change == 4
    assert round(spark.range(1).select(sigmoid(F.lit(-2.0)).alias("s")).first().s, 3) == 0.119
    rows = spark.createDataFrame([(1, 1, 0.40), (1, 2, 0.9), (2, 3, 0.50), (3, 4, None)], "query_id int, id int, distance double")
    assert {r.id: r.accepted for r in fusion.gate_set(rows).collect()} == {1: True, 2: True, 3: False, 4: False}


def test_metrics_expected_values(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "x", 2), (1, "b", 3), (2, "x", 1)], "query_id int, id string, rank int")
    gold = spark.createDataFrame([(1, "a"), (1, "b")], "query_id int, id string")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    at3 = {r.query_id: r for r in metrics.per_question(ranked, gold, asked, 3).collect()}
    assert at3[1].recall == 1.0 and at3[1].mrr == 1.0 and at3[2].recall == 0.0 and at3[3].out_of_scope
    assert at3[1].dcg == pytest.approx(1 + 1 / math.log2(4), abs=1e-6)
    assert metrics.per_question(ranked, gold, asked, 2).filter("query_id = 1").first().recall == 0.5
    v = spark.createDataFrame([("m", float(x)) for x in (1, 2, 3, 4)], "mode string, ms double")
    assert metrics.upper_median(v, ["mode"], "ms", "p50").first().p50 == 3.0


def test_documents_are_left_out_where_they_lie(spark, monkeypatch):
    """Whichever ids are few, terms are not shuffled; with many on both sides the rows are the same."""
    documents = spark.range(20).selectExpr("id", "array('a') AS terms")
    for most, keep in ((30, range(1, 40)), (3, range(2, 40)), (3, (5, 5, 7)), (1, range(4, 9))):
        monkeypatch.setattr(lexical, "KEYS", most)
        got = lexical._only(documents, spark.createDataFrame([(i,) for i in keep], "id long"))
        assert sorted(r.id for r in got.collect()) == sorted(set(keep) & set(range(20)))
        shuffled = "SortMergeJoin" in got._jdf.queryExecution().optimizedPlan().toString() or "strategy=broadcast" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert shuffled == (most == 1)
