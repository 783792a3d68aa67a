"""Prompts, citations and question variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.text import fold, legal_references, squeeze

# Statuses with level and message.
STATUSES = {
    "hierarchy_not_ready": ("error", "Hierarchy chưa sẵn sàng. Vui lòng Build Hierarchy."),
    "collection_not_ready": ("error", "Semantic Collection chưa sẵn sàng. Vui lòng Prepare Semantic."),
    "query_generation_unavailable": ("error", "Lỗi sinh Query Variants (Gemini). Hãy kiểm tra API Key."),
    "multi_query_partial": ("warning", "Có lỗi ở một số Query Variants. Kết quả có thể không đầy đủ."),
    "reranker_unavailable": ("error", "Reranker Model lỗi hoặc chưa tải được."),
    "insufficient_evidence": ("warning", "Không có evidence nào qua được cửa kiểm duyệt (Rerank Score quá thấp)."),
    "generation_failed": ("error", "Lỗi sinh Answer (Gemini)."),
    "success": ("success", "Thành công"),
}
UNKNOWN = "Lỗi không xác định: "  # fixed value
# What an answer says where none was made.
NO_EVIDENCE, NO_ANSWER = "Không tìm thấy đủ thông tin liên quan trong tài liệu đã cung cấp.", "Đã truy xuất được nguồn nhưng chưa thể tạo câu trả lời tổng hợp."
CITE_PARENTS = "Trả lời câu hỏi hoàn toàn dựa vào evidence trên. Trích dẫn [P1], [P2] vào mỗi câu nhận định."


def _blocks(evidence: DataFrame, block: Column, joiner: str) -> DataFrame:
    rows = evidence.select("query_id", F.struct("rank", block.alias("b")).alias("x"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), joiner).alias("__blocks"))


def prompts(evidence: DataFrame, questions: DataFrame) -> DataFrame:
    """One prompt per question with evidence: its whole texts in rank order, each under its label.

    `evidence` has query_id, rank, text and label (E1 ...); `questions` has query_id and question."""
    block = F.concat(F.lit("["), F.col("label"), F.lit("]\n--- START ---\n"), F.coalesce("text", F.lit("")), F.lit("\n--- END ---"))
    rows = _blocks(evidence, block, "\n\n").join(questions.select("query_id", "question"), "query_id")
    return rows.select("query_id", F.concat(F.lit("Câu hỏi: "), "question", F.lit("\n\nEvidence:\n"), "__blocks").alias("prompt"))


def parent_prompts(evidence: DataFrame, questions: DataFrame) -> DataFrame:
    """The same for parents, labelled P1 ... in the order of their rank; the request to cite them stands last."""
    block = F.concat(F.lit("["), F.col("label"), F.lit("]\n"), F.coalesce("text", F.lit("")), F.lit("\n\n"))
    rows = _blocks(evidence, block, "").join(questions.select("query_id", "question"), "query_id")
    return rows.select("query_id", F.concat(F.lit("Câu hỏi gốc: "), "question", F.lit("\n\nEvidence:\n"), "__blocks", F.lit(CITE_PARENTS)).alias("prompt"))


def labelled(evidence: DataFrame, prefix: str = "E", rank: str = "rank") -> DataFrame:
    """Adds label: the prefix and the row's place among the question's rows."""
    w = Window.partitionBy("query_id").orderBy(rank)
    return evidence.withColumn("label", F.concat(F.lit(prefix), F.row_number().over(w).cast("string")))


def cite(answers: DataFrame, evidence: DataFrame, prefix: str = "E") -> DataFrame:
    """Answers (query_id, answer) with labels replaced by their displays; labels of nothing are removed and counted.

    `evidence` has query_id, label, display (accepted rows only).  citations lists each label once, in order
    of first use."""
    known = evidence.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "display"))).alias("m"))
    rows = answers.join(known, "query_id", "left").withColumn("m", F.coalesce("m", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    pattern = rf"\[({prefix}\d+)\]"
    used = F.regexp_extract_all("answer", F.lit(pattern), F.lit(1))
    parts = F.split("answer", rf"\[{prefix}\d+\]")
    rows = rows.withColumn("used", used).withColumn("parts", parts)
    shown = F.zip_with("parts", F.concat("used", F.array(F.lit(None).cast("string"))), lambda p, u: F.concat(p, F.coalesce(F.element_at(F.col("m"), u), F.lit(""))))
    cited = F.filter(F.array_distinct("used"), lambda u: F.map_contains_key("m", u))
    bad = F.filter(F.array_distinct("used"), lambda u: ~F.map_contains_key("m", u))
    return rows.select("query_id", F.array_join(shown, "").alias("answer"), F.array_join(cited, ",").alias("citations"), F.size(bad).alias("n_warnings"))


def _status(status: str | Column, part: int, other: Column) -> Column:
    m = F.create_map(*[F.lit(x) for name, pair in STATUSES.items() for x in (name, pair[part])])
    return F.coalesce(F.element_at(m, F.col(status) if isinstance(status, str) else status), other)


def status_level(status: str | Column) -> Column:
    """error, warning or success; an unknown status is an error."""
    return _status(status, 0, F.lit("error"))


def status_message(status: str | Column) -> Column:
    return _status(status, 1, F.concat(F.lit(UNKNOWN), F.col(status) if isinstance(status, str) else status))


def filter_variants(questions: DataFrame, candidates: DataFrame, count: int = 3, longest: int = 300) -> DataFrame:
    """Q0 and the usable generated variants of each question: query_id, variant_id, text.

    `questions`: query_id, question; `candidates`: query_id, n, text.  Blank, too long and repeated ones are
    dropped, also those that name an article the question doesn't name; the first count - 1 are kept."""
    base = questions.select("query_id", squeeze("question").alias("q0"))
    rows = candidates.select("query_id", "n", squeeze("text").alias("text")).join(base, "query_id")
    articles = lambda c: F.filter(legal_references(c), lambda x: x.startswith("điều"))
    rows = rows.filter((F.col("text") != "") & (F.length("text") <= longest) & (fold("text") != fold("q0")))
    rows = rows.filter(F.size(F.array_except(articles("text"), articles("q0"))) == 0)
    same = Window.partitionBy("query_id", fold("text")).orderBy("n")
    rows = rows.withColumn("__d", F.row_number().over(same)).filter("__d = 1")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("n"))).filter(F.col("k") < count)
    variants = rows.select("query_id", F.concat(F.lit("Q"), F.col("k").cast("string")).alias("variant_id"), "text")
    return base.select("query_id", F.lit("Q0").alias("variant_id"), F.col("q0").alias("text")).unionByName(variants)
