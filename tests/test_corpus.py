import json

import pytest
from pyspark.sql import functions as F

from lamina.functions import text as t
from lamina.operators import answers, chunking, hierarchy, quality
from lamina.sources import files
from lamina.streaming.incremental import index_stream


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, t.tokens("s"), s="Lãi suất tài sản bảo đảm.") == ["lãi", "suất", "tài", "sản", "bảo", "đảm"]
    assert one(spark, t.tokens("s"), s="Điều 7, Khoản 2") == ["điều", "7", "khoản", "2"]
    assert one(spark, t.tokens("s"), s=None) == [] and one(spark, t.tokens("s"), s=",.,.") == []
    assert one(spark, t.normalise("s"), s="ế\r\n") == "ế\n"
    assert one(spark, t.squeeze("s"), s=None) == ""
    levels = {"Điều 5. Lãi": "article", "xem Điều 5": None, "PHẦN II CHUNG": "chapter", "Mục IV": "section", "mục 3": "section", "Điều 5a": None, "1. Khoản": "clause", "1.": None, "đ) điểm": "point", " Chương\u00a0III": "chapter"}
    assert {x: one(spark, t.heading_level("s"), s=x) for x in levels} == levels
    assert one(spark, t.squeeze("s"), s=" e\u0302\u0301  b\u00a0\n") == "ế b" and one(spark, t.tokens("s"), s="Tie\u0302\u0300n") == ["tiền"]
    assert one(spark, t.leading_heading("s"), s="\n Điều  12 của") == "Điều  12"
    assert one(spark, t.trailing_number(F.concat("s", F.lit(":12"))), s="a:7") == 12 and one(spark, t.trailing_number("s"), s="a:x") == 0
    assert one(spark, t.scored_citation(F.lit("P1"), "s", "a", "b", F.lit(0.876)), s="f.pdf", a=2, b=2) == "[P1] Nguồn: f.pdf (p.2-2) - Rerank Score: 0.88"
    assert one(spark, F.concat_ws("-", *t.page_range(F.lit(True), F.lit(9), "a", "b")), a=2, b=3) == "1-9" and one(spark, F.concat_ws("-", *t.page_range(F.lit(None).cast("boolean"), F.lit(9), "a", "b")), a=2, b=3) == "2-3"
    assert one(spark, t.leading_heading("s"), s="Chương II quy định") == "Chương II"
    assert one(spark, t.legal_references("s"), s="Theo Điều 5 và khoản 2") == ["điều 5", "khoản 2"]
    assert {x: one(spark, t.money("s"), s=x) for x in ("1234567", "1234.5", "", "nhiều")} == {"1234567": "1,234,567 VNĐ", "1234.5": "1,234 VNĐ", "": "0 VNĐ", "nhiều": "nhiều VNĐ"}
    assert one(spark, t.wikilinks("s"), s="[[A|b]] và [[C]] [[D|]]") == ["A", "C"]
    assert one(spark, t.yaml_id("s"), s="---\nname: x\nid: RR-1\n---\nid: no") == "RR-1"
    assert one(spark, t.file_name("s"), s='a:b?"c') == "a_b__c"
    assert one(spark, t.page_label("a", "b"), a=3, b=4) == "tr. 3-4" and one(spark, t.page_label("a", "b"), a=3, b=3) == "tr. 3"
    flags = {"a1b2c d3e": [t.FLAGS[3]], "11 a1 1b": [], " \n\u00a0": [t.FLAGS[0]], "Ä\u2026 x": [t.FLAGS[2]], "a\ufffdb": [t.FLAGS[1], t.FLAGS[2]], "aOi bUc đĐx": [t.FLAGS[4]], "aOi bUc": [], "abc\x01": [t.FLAGS[5]]}
    assert {x: one(spark, t.text_problems("s"), s=x) for x in flags} == flags and one(spark, t.text_problems("s"), s=None) == [t.FLAGS[0]]
    assert one(spark, t.secure_citation("n", "s", F.lit("Điều 1"), F.lit("c")), n="", s="Tên") == "[Tên | Điều 1 | c]"


def documents(spark, *pages, ocr=False):
    return chunking.page_documents(spark.createDataFrame([("d.pdf", i, x, ocr) for i, x in enumerate(pages, 1)], "source string, page int, text string, ocr_used boolean"))


def test_fixed_chunks_match_the_definition(spark):
    first, second = " ".join(str(i) for i in range(200)), " ".join(str(i) for i in range(200, 400))
    text = first + "\n\n" + second
    rows = chunking.fixed_chunks(documents(spark, first, second), 100, 30).orderBy("number").collect()
    want = [(x, 1 if s < len(first) else 2) for s in range(0, len(text), 70) if (x := text[s : s + 100].strip())]
    assert [(r.text, r.page_start) for r in rows] == want and rows[0].chunk_id == "d:fixed-size:0001"
    assert {(r.page_start, r.page_end) for r in chunking.fixed_chunks(documents(spark, first, second, ocr=True), 100, 30).collect()} == {(1, 2)}
    assert chunking.fixed_chunks(documents(spark, None, "  "), 100, 30).count() == 0
    with pytest.raises(ValueError):
        chunking.fixed_chunks(documents(spark, "x"), 10, 10)


def test_limits():
    assert chunking.within_limit("a" * 25, 10) == ["a" * 10, "a" * 10, "a" * 5]
    assert chunking.within_limit("  mot hai   ba bon ", 7) == ["mot hai", "ba bon"] and chunking.within_limit(" \n", 5) == []
    assert chunking.within_limit("mot hai", 7) == ["mot hai"] and chunking.within_limit("mothaiba bon", 7) == ["mothaib", "a bon"]


def test_semantic_pieces():
    # a unit over the size opens a piece, and what follows it joins its last sentence
    pages = [(1, "một.\n\n" + "Câu một. " * 12), (2, "đoạn hai")]
    got = chunking.semantic_pieces(pages, 50)
    assert [x for x, _, _ in got] == ["một.", "Câu một. Câu một. Câu một. Câu một. Câu một.", "Câu một. Câu một. Câu một. Câu một. Câu một.", "Câu một. Câu một.\n\nđoạn hai"]
    assert [(a, b) for _, a, b in got] == [(1, 1), (1, 1), (1, 1), (1, 2)]
    # a line that begins with a capital is a unit, one that begins with a digit or an accented capital is not
    assert chunking.semantic_pieces([(1, "aa\nBb\n1c\nÀd")], 4) == [("aa", 1, 1), ("Bb\n1", 1, 1), ("c\nÀd", 1, 1)]


def test_hierarchical_pieces():
    long = "dài " * 20
    pages = [(1, "Lời đầu\nChương I\nĐiều 1. A\n" + long), (2, "tiếp\nPHẦN II x\n\nhết")]
    got, found = chunking.hierarchical_pieces(pages, 30)
    assert found and max(len(x) for x, *_ in got) <= 30
    assert [(x.split("\n")[0][:9], a, b, path[0], path[2]) for x, a, b, path in got] == [
        ("Lời đầu", 1, 1, None, None), ("Chương I", 1, 1, "Chương I", None), ("Điều 1. A", 1, 1, "Chương I", "Điều 1. A"), ("dài dài d", 1, 1, "Chương I", "Điều 1. A"),
        ("dài dài d", 1, 1, "Chương I", "Điều 1. A"), ("dài dài d", 1, 2, "Chương I", "Điều 1. A"), ("PHẦN II x", 2, 2, "PHẦN II x", None),
    ]
    heading = "1. " + "x" * 100
    assert chunking.hierarchical_pieces([(1, heading)], 30)[0] == [(heading, 1, 1, (None, None, None, heading, None))]
    assert chunking.hierarchical_pieces([(1, "không có")], 30) == ([("không có", 1, 1, (None,) * 5)], False) and chunking.hierarchical_pieces([], 30) == ([], False)


def test_chunk_records(spark):
    docs = documents(spark, "Điều 1. A\nmột", "hai", None)
    r = chunking.hierarchical_chunks(docs).first()
    assert (r.chunk_id, r.page_start, r.page_end, r.structure.article, r.warning) == ("d:hierarchical:0001", 1, 3, "Điều 1. A", None)
    r = chunking.hierarchical_chunks(documents(spark, "văn xuôi", ocr=True)).first()
    assert r.structure is None and r.warning == chunking.NO_HEADING
    assert [(x.chunk_id, x.text) for x in chunking.semantic_chunks(docs).collect()] == [("d:semantic:0001", "Điều 1. A\nmột\n\nhai")]
    assert chunking.semantic_chunks(documents(spark, None)).count() == 0


def test_pages_joined(spark):
    rows = spark.createDataFrame([("s", 2, "bb"), ("s", 1, "a"), ("s", 3, None), ("s", 1, "a")], "source string, page int, text string")
    r = chunking.join_pages(chunking.page_documents(rows)).first()
    assert r.text == "a\n\nbb\n\n" and r.page_ends == [1, 5, 7] and [p.page for p in r.pages] == [1, 2, 3]


def test_html_and_edges(spark):
    page = "<p>" + "x" * 30 + " &eacute;&#233;</p>outside, and long enough<p>short</p><pre>" + "q" * 30 + "</pre><script><p>" + "s" * 40 + "</script><P a='1'>" + "y" * 30 + "\n <b> z</b>"
    rows = chunking.html_chunks(spark.createDataFrame([("d", page), ("e", None)], "id string, content_html string"))
    assert [r.text for r in rows.orderBy("number").collect()] == ["x" * 30 + " éé", "y" * 30 + "z"]
    assert [r.chunk_id for r in rows.orderBy("number").collect()] == ["d_chunk_0", "d_chunk_1"]
    assert [(r.src, r.dst) for r in chunking.next_edges(rows, "doc_id", "number", "chunk_id").collect()] == [("d_chunk_0", "d_chunk_1")]
    assert chunking.parent_edges(rows, "doc_id", "number", "chunk_id").count() == 1


CHUNKS = "chunk_id string, source string, page_start int, page_end int, text string, structure struct<chapter:string,article:string,clause:string,point:string>"


def test_hierarchy_cases(spark):
    at = lambda article, chapter=None: (chapter, article, None, None)
    rows = [
        ("s:h:1", "s", 1, 2, "Điều 2. nội dung", at("Điều 1")), ("s:h:2", "s", 1, 2, " Điều 5. khác", None), ("s:h:10", "s", 1, 2, "1. Khoản 1", None),
        ("r:h:1", "r", 1, 2, "nội dung sửa đổi Điều 15", None), ("s:h:3", "s", 1, 2, "Chương III tiếp", at("", "")), ("s:h:4", "s", 1, 2, None, None), ("s:h:5", "s", 1, 2, "x", at("Điều 9")),
        ("s:h:6", "s", 1, 2, "chương iv", at(None, "Chương IV")),
    ]
    for block in (1, 3, 2048):
        got = {r.chunk_id: r for r in hierarchy.resolve_hierarchy(spark.createDataFrame(rows, CHUNKS), block).collect()}
        assert (got["s:h:1"].method, got["s:h:1"].article, got["s:h:1"].ambiguous) == ("metadata", "Điều 1", True)
        assert got["s:h:1"].warnings == ["Metadata article 'Điều 1' conflicts with inferred heading 'Điều 2'"]
        assert (got["s:h:2"].method, got["s:h:2"].article) == ("heading_inferred", "Điều 5")
        assert (got["s:h:3"].method, got["s:h:3"].chapter, got["s:h:3"].article) == ("heading_inferred", "Chương III", None)
        assert (got["s:h:4"].method, got["s:h:4"].chapter, got["s:h:4"].article) == ("carried_forward", "Chương III", "Điều 5")
        assert (got["s:h:5"].chapter, got["s:h:5"].article) == (None, "Điều 9")  # nothing is carried under a stored heading
        assert got["s:h:6"].ambiguous  # letter case counts
        assert (got["s:h:10"].method, got["s:h:10"].article, got["s:h:10"].chapter) == ("carried_forward", "Điều 9", "Chương IV")
        assert got["r:h:1"].method == "document_fallback" and got["r:h:1"].article is None


def test_parent_windows_expected_values(spark):
    rows = [(f"s:h:{i}", "s", i, i, "x" * n, (None, "Điều 1", None, None)) for i, n in enumerate((60, 60, 150), 1)]
    got = hierarchy.parent_windows(hierarchy.resolve_hierarchy(spark.createDataFrame(rows, CHUNKS)), 100).orderBy("window_index").collect()
    assert [r.char_count for r in got] == [60, 60, 150] and [r.oversize for r in got] == [False, False, True] and [r.window_index for r in got] == [1, 2, 3]
    import hashlib

    assert got[0].parent_id == hashlib.sha256("s_Điều 1_1".encode()).hexdigest()[:12] and got[1].child_ids == ["s:h:2"] and got[1].text == "x" * 60


def test_blocks_give_what_one_walk_gives(spark):
    import random

    rng = random.Random(3)
    texts = ["Điều 1. x", "Chương II", "  Điều 2 q"]
    rows = [(f"{s}:h:{i:04d}", s, 1, 2, rng.choice([*texts, "y" * rng.randint(0, 40), "z" * rng.randint(1, 150)]), rng.choice([None, None, (None, "Điều 1", None, None), ("Chương I", None, None, "a)")])) for s in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, CHUNKS)
    whole = hierarchy.resolve_hierarchy(df).cache()
    assert sorted(map(str, whole.collect())) == sorted(map(str, hierarchy.resolve_hierarchy(df, 7).collect()))
    one = whole.withColumn("article", F.lit("A"))
    for children, most, block in ((whole, 100, 5), (one, 30, 4), (one, 400, 4)):
        assert sorted(map(str, hierarchy.parent_windows(children, most).collect())) == sorted(map(str, hierarchy.parent_windows(children, most, block).collect()))


def test_variants_and_citations(spark):
    q = spark.createDataFrame([(1, "  Lãi suất  là gì? ")], "query_id long, question string")
    c = spark.createDataFrame([(1, 1, "lãi suất là gì?"), (1, 2, "LÃI SUẤT LÀ GÌ?"), (1, 3, "lãi suất theo Điều 5"), (1, 4, "mức lãi"), (1, 5, ""), (1, 6, None), (1, 7, "Mức lãi")], "query_id long, n int, text string")
    assert [(r.variant_id, r.text) for r in answers.filter_variants(q, c).orderBy("variant_id").collect()] == [("Q0", "Lãi suất là gì?"), ("Q1", "mức lãi")]
    a = spark.createDataFrame([(1, "x [E1] y [E2] z [E99]"), (2, None)], "query_id long, answer string")
    e = spark.createDataFrame([(1, "E1", "<1>"), (1, "E2", "<2>")], "query_id long, label string, display string")
    got = {r.query_id: r for r in answers.cite(a, e).collect()}
    assert got[1].answer == "x <1> y <2> z " and got[1].citations == "E1,E2" and got[1].n_warnings == 1 and got[2].answer is None
    p = answers.labelled(spark.createDataFrame([(1, 7, "B"), (1, 3, "A")], "query_id long, rank int, text string"))
    asked = spark.createDataFrame([(1, "hỏi?")], "query_id long, question string")
    assert answers.prompts(p, asked).first().prompt == "Câu hỏi: hỏi?\n\nEvidence:\n[E1]\n--- START ---\nA\n--- END ---\n\n[E2]\n--- START ---\nB\n--- END ---"
    assert answers.parent_prompts(p, asked).first().prompt == "Câu hỏi gốc: hỏi?\n\nEvidence:\n[E1]\nA\n\n[E2]\nB\n\n" + answers.CITE_PARENTS
    st = spark.createDataFrame([("success",), ("other",)], "s string").select(answers.status_level("s").alias("l"), answers.status_message("s").alias("m")).collect()
    assert [tuple(x) for x in st] == [("success", "Thành công"), ("error", "Lỗi không xác định: other")]


def test_chunk_files(spark, tmp_path):
    good = {"chunk_id": "a", "strategy": "semantic", "source": "s", "page_start": 1, "page_end": 2, "text": "x"}
    (tmp_path / "a.json").write_text(json.dumps([good, good | {"chunk_id": "b", "page_start": True}, good | {"chunk_id": "c", "page_start": 3}]))
    (tmp_path / "b.json").write_text(json.dumps({"chunks": [good | {"chunk_id": "d", "text": " "}, good | {"chunk_id": "e", "strategy": "other"}]}))
    rows = files.read_chunks(spark, str(tmp_path))
    assert {r.chunk_id: r.problem for r in rows.collect()} == {"a": None, "b": "bad_page", "c": "page_order", "d": "skipped_blank", "e": "bad_strategy"}
    assert files.loader_statistics(rows).first().valid == 1
    assert tuple(files.loader_statistics(rows, "semantic").first()) == (2, 5, 4, 1, 1)
    with pytest.raises(Exception, match="bad_page|page_order|bad_strategy"):
        files.strict(rows).collect()


def test_store_csv_and_sinks(spark, tmp_path):
    kids = spark.createDataFrame([("c", "p")], "id string, parent_id string")
    files.write_store(kids, kids, str(tmp_path / "s"), {"fingerprint": 7})
    assert files.read_store(spark, str(tmp_path / "s"), {"fingerprint": 7})[0].count() == 1
    with pytest.raises(ValueError):
        files.read_store(spark, str(tmp_path / "s"), {"fingerprint": 8})
    files.write_csv(spark.createDataFrame([("1", None), ("x-2", 'a "b", c')], "id string, title string"), str(tmp_path / "csv"))
    assert {r.id: r.title for r in files.read_csv(spark, str(tmp_path / "csv"), ["id", "title"], blank=True).collect()} == {"1": "", "x-2": 'a "b", c'}
    stored = spark.createDataFrame([("a", "old")], "chunk_id string, text string")
    new = spark.createDataFrame([("a", "new"), ("b", "x"), ("b", "y")], "chunk_id string, text string")
    assert [(r.chunk_id, r.text) for r in files.insert_ignore(stored, new, "chunk_id").collect()] == [("b", "x")]
    two = spark.createDataFrame([("b", "x", "2", 2), ("b", "y", "1", 1), ("c", None, "3", 1)], "chunk_id string, text string, other string, seq int")
    assert sorted(map(tuple, files.insert_ignore(stored, two, "chunk_id", order="seq").collect())) == [("b", "y", "1", 1), ("c", None, "3", 1)]  # whole rows
    with pytest.raises(Exception, match="null in text"):
        files.insert_ignore(stored, two, "chunk_id", ("text",)).collect()
    table = files.create_table(spark, str(tmp_path / "t"), "chunk_id string, text string")
    assert table.count() == 0
    new.write.mode("append").parquet(str(tmp_path / "t"))
    assert files.create_table(spark, str(tmp_path / "t"), "chunk_id string, text string").count() == 3


def test_documents_through_plug_ins(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes("trang một\fx1y z2t u3v".encode())
    (tmp_path / "b.pdf").write_bytes(b"sach")
    (tmp_path / "c.pdf").write_bytes(b"\xff\xfe")
    extract = lambda data: data.decode().split("\f")
    rows = {(r.source, r.page): r for r in files.read_documents(spark, str(tmp_path), extract).collect()}
    assert len(rows) == 4 and rows["a.pdf", 2].warnings == [t.FLAGS[3]] and rows["c.pdf", 1].warnings == ["exception:UnicodeDecodeError"]
    rows = {(r.source, r.page): r for r in files.read_documents(spark, str(tmp_path), extract, lambda data: "đọc lại").collect()}
    assert {k: (r.text, r.ocr_used, r.page_count) for k, r in rows.items()} == {("a.pdf", 1): ("đọc lại", True, 2), ("b.pdf", 1): ("sach", False, 1), ("c.pdf", 1): ("đọc lại", True, 1)}
    pages = spark.createDataFrame([("s", 1, "tốt"), ("s", 2, ""), ("r", 1, "tốt")], "source string, page int, text string")
    assert {r.source: (r.would_use_ocr, r.bad_pages) for r in files.dry_run(pages).collect()} == {"s": (True, [2]), "r": (False, [])}


def test_reports_and_pages(spark, tmp_path):
    docs = documents(spark, "Điều 1. A", "B")
    files.write_raw(docs, str(tmp_path / "raw"))
    raw = spark.read.json(str(tmp_path / "raw")).first()
    assert raw.page_count == 2 and [p.text for p in raw.pages] == ["Điều 1. A", "B"] and raw.pages[0].source == "d.pdf"
    stats = chunking.chunk_statistics(chunking.semantic_chunks(docs), ["source", "strategy"])
    assert files.chunk_report(stats, docs).first().statistics["semantic"].chunk_count == 1
    entities = spark.createDataFrame([("RR-1", "RuiRo", "Mất: tiền", "cao"), ("KS-1", "KiemSoat", "Đối soát", None)], "id string, type string, name string, level string")
    links = spark.createDataFrame([("KS-1", "MITIGATES", "RR-1")], "source_id string, relationship_type string, target_id string")
    pages = {r.note: r for r in files.markdown_pages(entities, links).collect()}
    assert set(pages) == {"RR-1 - Mất_ tiền", "KS-1 - Đối soát", "Home"} and "[[KS-1 - Đối soát]]" in pages["RR-1 - Mất_ tiền"].body and pages["RR-1 - Mất_ tiền"].folder == "RuiRo"
    checks = {r.check_name: r.n for r in quality.validate_wiki(files.markdown_pages(entities, links), entities, links).collect()}
    assert checks == {"files": 3, "links": 4, "broken_links": 0, "duplicate_ids": 0, "unknown_ids": 0, "unknown_sources": 0, "unknown_targets": 0, "without_MITIGATES": 0, "without_OBSERVED_AS": 1, "orphans": 0, "orphans_without_home": 0}
    lines = [r.value for r in files.markdown_table(spark.createDataFrame([("b|", 2), ("a", None)], "x string, y int"), ["x"]).collect()]
    assert lines == ["| x | y |", "| --- | --- |", "| a | — |", "| b\\| | 2 |"]
    files.write_csv(entities, str(tmp_path / "bom"), bom=True)
    assert any(p.read_bytes().startswith(b"\xef\xbb\xbf") for p in (tmp_path / "bom").glob("part-*"))


def test_incremental_index(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "index")
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "x")], "chunk_id string, text string")
    for batch in (df, spark.createDataFrame([("b", "z"), ("c", "w")], df.schema)):
        batch.coalesce(1).write.mode("append").parquet(folder)
        index_stream(spark, folder, df.schema, target, str(tmp_path / "cp"), lambda x: x.withColumn("n", F.length("text"))).awaitTermination(120)
    assert sorted(r.chunk_id for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]


def test_validations(spark):
    rows = [("a", "semantic", "s", 1, 1, "x"), (None, "semantic", "s", 1, 1, "x"), ("b", "other", "s", 1, 1, "x"), ("c", "semantic", "s", 2, 1, "x"), ("d", "semantic", "s", 0, 1, "x"), ("e", "semantic", "s", None, 1, "x"), ("f", "semantic", "s", 1, 1, None)]
    got = quality.validate_chunks(spark.createDataFrame(rows, "chunk_id string, strategy string, source string, page_start int, page_end int, text string"), files.STRATEGIES).collect()
    assert [r.problem for r in got] == [None, "missing_field", "bad_strategy", "page_order", "bad_page", "missing_page", "skipped_blank"]
