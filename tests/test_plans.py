from lamina import session
from lamina.operators import hierarchy
from lamina.plans import corpus, law, retrieval


def folder(spark, tmp_path, **tables):
    """Small tables as a test folder: rows and schema of each."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_prompts_hold_the_whole_evidence(spark, tmp_path):
    text = "Tài sản bảo đảm.\n" + "x " * 200 + "hết"
    d = folder(spark, tmp_path, documents=([(100, "a", text, "Tài sản"), (2, "b", "khác", None), (200, "c", "nữa", "...")], "doc_id long, source string, text string, title string"))
    got = {r.query_id: r.prompt for r in retrieval.prompt_text(spark, d).collect()}
    assert set(got) == {100} and text in got[100]


def test_review_queue_has_every_relation(spark, tmp_path):
    rows = [(f"r{i:03}", "A", "B", "llm", i / 100) for i in range(80)] + [("x", "A", "B", "rule", 0.5), ("y", "A", "C", "llm", 0.5)]
    d = folder(spark, tmp_path, law_metadata=([("1", "A"), ("2", "B")], "id string, so_ky_hieu string"), relationships=(rows, "rel_id string, source string, target string, method string, confidence double"))
    assert [r.rel_id for r in law.review_queue(spark, d).collect()] == [f"r{i:03}" for i in reversed(range(80))]


def test_html_keeps_documents_with_marks(spark, tmp_path):
    texts = ["nhóm hai, <C> là nợ cần chú ý & &lt;theo dõi&gt;", "đoạn một không có dấu gì cả", "dòng thứ hai: a < b và c > d, x & y"]
    d = folder(spark, tmp_path, documents=([(1, texts[0]), (2, "\n".join(texts[1:])), (3, None)], "doc_id long, text string"))
    assert sorted(r.text for r in corpus._html(spark, d).collect()) == sorted(texts)
    assert {(r.doc_id, r.number) for r in corpus.html_chunks(spark, d).collect()} == {(1, 0), (2, 0), (2, 1)}
    assert {(r.src, r.dst, r.kind) for r in corpus.chunk_edges(spark, d).collect()} == {("2_chunk_0", "2_chunk_1", "NEXT"), ("2_chunk_0", "2_chunk_1", "PARENT_OF")}


def test_variants_are_whole_titles(spark, tmp_path):
    long = "Quy định về " + "tài sản " * 10
    rows = [(100, "Hỏi"), (1, long + "bảo đảm"), (2, long + "theo Điều 9"), (3, "dài " * 80)]
    d = folder(spark, tmp_path, documents=(rows, "doc_id long, title string"))
    assert [(r.variant_id, r.text) for r in corpus.variant_filter(spark, d).orderBy("variant_id").collect()] == [("Q0", "Hỏi"), ("Q1", long + "bảo đảm")]


CHUNK = "chunk_id string, strategy string, source string, page_start int, page_end int, text string, structure struct<chapter:string,section:string,article:string,clause:string,point:string>"


def law_chunks(spark, tmp_path):
    none = (None, None, None, None, None)
    rows = [(f"s{s}:hierarchical:{n:04}", "hierarchical", f"s{s}.pdf", n, n + 1, f"Điều {n // 3 + 1} tài sản {s} " + "x " * (900 * (n % 3)), none) for s in range(3) for n in range(7)]
    rows = [*rows, rows[4], ("s0:hierarchical:0009", "hierarchical", "s0.pdf", 9, 9, None, none)]
    docs = [(100, "Điều 1 tài sản", "a"), (200, "tài sản 2 Điều 3", "b"), (3, "khác", None)]
    return folder(spark, tmp_path, chunks=(rows, CHUNK), documents=(docs, "doc_id long, title string, so_ky_hieu string"))


def test_no_text_of_a_chunk_or_parent_is_carried_along(spark, tmp_path, monkeypatch):
    """Texts are not stored between steps, and parents and sizes are those of parents with texts."""
    d, cut = law_chunks(spark, tmp_path), retrieval.cut_lineage

    def small(df):
        assert "text" not in df.columns
        return cut(df)

    monkeypatch.setattr(retrieval, "cut_lineage", small)
    kept = {(r.query_id, r.parent_id) for r in retrieval.parent_budget(spark, d).collect()}
    assert {q for q, _ in kept} == {100, 200}
    whole = {r.parent_id: r for r in hierarchy.parent_windows(retrieval.children(spark, d)).collect()}
    light = retrieval.parents(spark, d)
    assert {r.parent_id: (r.child_ids, r.char_count, r.oversize) for r in light.collect()} == {k: (r.child_ids, r.char_count, r.oversize) for k, r in whole.items()}
    # a chunk that is stored twice stands once in a parent's text
    texts = {r.parent_id: r.text for r in hierarchy.parent_texts(light, retrieval.chunk_rows(spark, d)).collect()}
    assert texts == {k: r.text for k, r in whole.items()} and {p for _, p in kept} <= set(texts)


def test_prompt_finds_texts_where_they_lie(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "id long, text string")
    wanted = spark.createDataFrame([(1,), (1,), (3,), (9,)], "id long")
    assert sorted(r.id for r in session.among(docs, wanted, "id").collect()) == [1, 3]
    monkeypatch.setattr(session, "KEYS", 2)
    assert session.among(docs, wanted, "id").count() == 5  # left to the join


def test_labels_are_counted_without_pairs(spark, tmp_path):
    """All pairs of documents about one law are never made; a document under two laws counts once."""
    rows = [(i, "A") for i in range(100, 140)] + [(200, "B"), (201, "B"), (110, "B"), (200, "A"), (300, None), (400, "C")]
    d = folder(spark, tmp_path, documents=(rows, "doc_id long, so_ky_hieu string"))
    pairs = {(q, i) for q, a in rows for i, b in rows if a and a == b and q % 100 == 0}
    ranked = spark.createDataFrame([(q, i, 1) for q in (100, 200, 300, 400) for i in (110, 139, 201, 300, 400)], "query_id long, id long, rank int")
    got = [(r.query_id, r.id) for r in retrieval.gold(spark, d, ranked).collect()]
    assert sorted(got) == sorted(pairs & {(r.query_id, r.id) for r in ranked.collect()})
    assert {r.query_id: r.n_gold for r in retrieval.gold_counts(spark, d).collect()} == {q: sum(a == q for a, _ in pairs) for q in (100, 200, 400)}
