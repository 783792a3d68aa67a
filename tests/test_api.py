import pytest
from pyspark.sql import functions as F

from lamina.api import MODES, PARENT_MODES, Retriever, SecureRetriever, check_questions, check_request
from lamina.config import Retrieval


@pytest.fixture(scope="module")
def parts(spark):
    texts = ["lãi suất cho vay", "tài sản bảo đảm tiền vay", "kỷ luật nhân sự", "rủi ro thanh khoản và bảo đảm", "bảo đảm tiền vay"]
    corpus = spark.createDataFrame([(i, f"s{i}", 1, 2, t, f"t{i}", f"{i}/TT", "Điều 1", ["Admin"] if "kỷ" in t else ["Admin", "Guest"]) for i, t in enumerate(texts)], "id long, source string, page_start int, page_end int, text string, title string, so_ky_hieu string, article string, roles array<string>")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "id long, embedding array<float>")
    asked = spark.createDataFrame([(7, "bảo đảm tiền vay", [1.0, 4.0]), (8, "kỷ luật", [1.0, 2.0])], "query_id long, question string, vector array<float>")
    return corpus, vectors, asked


def logit(df):
    return df.withColumn("logit", (F.length("text") - 20).cast("double"))


def test_modes_and_statuses(parts):
    corpus, vectors, asked = parts
    r = Retriever(corpus, vectors, Retrieval(final_top_k=2), logit)
    assert {x.accepted for x in r.evidence(asked, "bm25").collect()} == {False}
    out = {x.query_id: x for x in r.query_pipeline(asked, "semantic", lambda p: p.withColumn("answer", F.lit("theo [E1] và [E9]"))).collect()}
    assert out[7].status == "answered" and out[7].citations == "E1" and out[7].n_warnings == 1 and "[E9]" not in out[7].answer
    assert out[7].prompt.startswith("Câu hỏi: bảo đảm tiền vay\n\nEvidence:\n[E1]\n--- START ---\nbảo đảm tiền vay\n--- END ---")
    assert {x.status for x in r.query_pipeline(asked, "bm25").collect()} == {"insufficient_evidence"}
    assert set(MODES) <= set(r.compare(asked).columns)
    with pytest.raises(ValueError):
        r.evidence(asked, "other")
    with pytest.raises(ValueError, match="reranker"):
        Retriever(corpus, vectors).evidence(asked, "hybrid_rerank")
    wrong = asked.withColumn("question", F.when(F.col("query_id") == 7, ",.,.").otherwise(F.col("question")))
    assert {x.query_id: x.status for x in r.query_pipeline(wrong, "semantic").collect()} == {7: "retrieval_error", 8: "retrieval_only"}
    lacking = Retriever(corpus, vectors, index=r.index).query_pipeline(asked, "hybrid_rerank").collect()
    assert {x.status for x in lacking} == {"reranker_unavailable"} and all(x.n_evidence > 0 for x in lacking)
    for bad in (" ", ",.,.", "x" * 2001):
        with pytest.raises(Exception, match="question"):
            check_questions(asked.withColumn("question", F.lit(bad))).collect()
    for k, strategy in ((0, "semantic"), (21, "semantic"), (True, "semantic"), (5, "other")):
        with pytest.raises(ValueError):
            check_request(k, strategy)


def test_payload_and_manifest_must_agree(spark, parts):
    corpus, vectors, asked = parts
    told = vectors.join(corpus.select("id", "text", "source"), "id")
    good = Retriever(corpus, told)
    assert good.hybrid_search(asked).count() > 0
    other = told.withColumn("text", F.when(F.col("id") == 4, "khác").otherwise(F.col("text")))
    with pytest.raises(Exception, match="metadata mismatch"):
        Retriever(corpus, other, index=good.index).hybrid_search(asked).collect()
    with pytest.raises(ValueError, match="strategy"):
        Retriever(corpus, vectors, manifest=({"strategy": "a"}, {"strategy": "b"})).semantic_search(asked)


def test_variants_parents_and_context(spark, parts):
    corpus, vectors, asked = parts
    parents = corpus.select(
        "id", F.when(F.col("id") < 2, "p1").otherwise("p2").alias("parent_id"), "source", "page_start", "page_end", F.lit("y" * 9000).alias("text"), F.lit(1).alias("ambiguous_count"),
    )
    r = Retriever(corpus, vectors, Retrieval(context_max_chars=16000), logit, parents)
    v = asked.select("query_id", F.lit("Q0").alias("variant_id"), "question", "vector").unionByName(asked.select("query_id", F.lit("Q1").alias("variant_id"), F.lit("tiền vay").alias("question"), "vector"))
    rows, states = r.execute_pipeline(v, "multi_flat")
    assert {x.status for x in states.collect()} == {"success"} and rows.filter("accepted").groupBy("query_id").count().agg(F.max("count")).first()[0] <= 3
    rows, states = r.execute_pipeline(v, "single_parent", lambda p: p.withColumn("answer", F.lit("theo [P1]")))
    got = {x.query_id: x for x in states.collect()}
    assert got[7].prompt.startswith("Câu hỏi gốc: bảo đảm tiền vay\n\nEvidence:\n[P1]\nyyy") and got[7].answer == "theo [P1]" and got[7].n_accepted == 1
    assert {(x.label, x.parent_rank) for x in rows.collect()} == {("P1", 1)}
    broken = v.withColumn("question", F.when((F.col("variant_id") == "Q1") | (F.col("query_id") == 8), "?").otherwise(F.col("question")))
    children, states = r.multi_query_child_search(broken)
    assert {x.query_id: x.status for x in states.collect()} == {7: "multi_query_partial", 8: "multi_query_failed"}
    assert {x.query_id for x in children.collect()} == {7}
    assert {x.mode for x in r.compare_parent_modes(v).collect()} == set(PARENT_MODES)
    assert {x.status for x in Retriever(corpus, vectors, index=r.index).execute_pipeline(v, "multi_flat")[1].collect()} == {"reranker_unavailable"}
    with pytest.raises(ValueError, match="hierarchy_not_ready"):
        Retriever(corpus, vectors, index=r.index).execute_pipeline(v, "multi_parent")
    docs = corpus.select("id", F.concat(F.lit("d"), F.col("id").cast("string")).alias("document"))
    edges = spark.createDataFrame([("d4", "d0"), ("d0", "d1")], "src string, dst string")
    got = {(x.id, x.hops) for x in r.search_context(asked.filter("query_id = 7"), docs, edges, 1, 2).collect()}
    assert got == {(4, 0), (0, 1), (1, 2)}
    assert r.compare_hops(asked, docs, edges, 1).select("setting").distinct().count() == 3


def test_roles_come_first(parts):
    corpus, vectors, asked = parts
    s = SecureRetriever(corpus, vectors, logit)
    for method in ("bm25", "dense", "graph", "hybrid", "secure"):
        assert s.retrieve(asked, ["Guest"], method).filter("id = 2").count() == 0
        assert s.retrieve(asked, [], method).count() == 0
    held = asked.withColumn("question", F.when(F.col("query_id") == 7, "ĐẢM tiền").otherwise("4/tt"))
    assert {(x.query_id, x.id) for x in s.retrieve(held, ["Guest"], "graph").collect()} == {(7, 1), (7, 4), (8, 4)}
    assert s.retrieve(asked, ["Admin"], "bm25").filter("id = 2 AND query_id = 8").count() == 1
    with pytest.raises(ValueError):
        s.retrieve(asked, ["Admin"], "other")
