"""Chunkers over documents of pages, and chunk statistics.

A document is its pages in order; it fits a task by definition.  All chunkers give source, number, chunk_id,
strategy, page_start, page_end and text; the hierarchical one also structure and no_heading.  A document read by
OCR stands on all its pages.  Null pages count as empty; a document without text gives no chunk."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.text import HEADINGS, LEVELS, SPACE, chunk_id, file_stem, html_paragraphs, normalise, page_range, strip

JOINER = "\n\n"
NO_HEADING = "Không tìm thấy heading theo mẫu Chương/Phần/Mục/Điều/Khoản/Điểm; không bịa cấu trúc."  # fixed value


def page_documents(pages: DataFrame) -> DataFrame:
    """One row per source: source, ocr_used (of any page), pages (array of page, text), page_count.

    `pages` has source, page, text and ocr_used where known.  Repeated rows of a page count once."""
    ocr = F.coalesce(F.col("ocr_used"), F.lit(False)) if "ocr_used" in pages.columns else F.lit(False)
    rows = pages.filter("source IS NOT NULL AND page IS NOT NULL").select("source", "page", F.coalesce(normalise("text"), F.lit("")).alias("text"), ocr.alias("ocr"))
    one = rows.groupBy("source", "page").agg(F.max("text").alias("text"), F.max("ocr").alias("ocr"))
    docs = one.groupBy("source").agg(F.max("ocr").alias("ocr_used"), F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"))
    return docs.withColumn("page_count", F.size("pages"))


def join_pages(documents: DataFrame) -> DataFrame:
    """Adds the pages' texts joined by blank lines, and where each page ends in it."""
    start = F.array().cast("array<int>")
    ends = F.aggregate(
        "pages", start, lambda acc, p: F.concat(acc, F.array((F.coalesce(F.get(acc, F.size(acc) - 1) + len(JOINER), F.lit(0)) + F.length(p["text"])).cast("int")))
    )
    return documents.withColumn("page_ends", ends).withColumn("text", F.array_join(F.transform("pages", lambda p: p["text"]), JOINER))


def windows(text: Column, size: int, overlap: int) -> Column:
    """Array of (start, text): cuts of `size` characters every size - overlap, trimmed, blank ones left out."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size > 0 and 0 <= overlap < size are needed")
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(max(1, size - overlap))))
    cut = F.transform(starts, lambda at: F.struct(at.alias("start"), strip(F.substring(text, at + 1, F.lit(size))).alias("text")))
    return F.filter(cut, lambda x: x["text"] != "")


def fixed_chunks(documents: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """Windows over the joined pages; a window's page is the first non-empty one that ends after its start.

    Numbering needs no shuffle: the windows of a document are made as one array."""
    rows = join_pages(documents).select("source", "ocr_used", "page_count", "pages", "page_ends", F.posexplode(windows(F.col("text"), size, overlap)).alias("at", "cut"))
    after = F.filter(F.arrays_zip("pages", "page_ends"), lambda z: (F.length(z["pages"]["text"]) > 0) & (z["page_ends"] > F.col("cut.start")))
    page = F.coalesce(F.get(after, F.lit(0))["pages"]["page"], F.lit(1))
    rows = rows.withColumn("page", page).withColumn("number", F.col("at") + 1)
    first, last = page_range("ocr_used", "page_count", "page", "page")
    return rows.select(
        "source", "number", chunk_id(file_stem("source"), F.lit("fixed-size"), "number").alias("chunk_id"), F.lit("fixed-size").alias("strategy"),
        first.alias("page_start"), last.alias("page_end"), F.col("cut.text").alias("text"), F.col("cut.start").alias("start"),
    )


def within_limit(text: str, size: int) -> list[str]:
    """The text in pieces of at most `size` characters, each as long as it can be and ending before a space;
    a stretch without a space is cut at the limit."""
    shape = re.compile(rf"\s*(?:(.{{1,{size}}})(?: |\Z)|(.{{{size}}}))", re.DOTALL)
    return [(m.group(1) or m.group(2)).strip() for m in shape.finditer(text.strip()) if (m.group(1) or m.group(2))]


def packed(parts: Iterable[tuple[str, str, int, bool]], size: int) -> Iterator[tuple[str, int, int, int, int]]:
    """Greedy filling: (text, page of its first part, of its last part, of the part that closed it, index of its first part).

    A part is (text, joiner, page, fresh); a fresh one always opens a new piece.  The first piece begins on page 1."""
    held, first, last, begin = "", 1, 1, 0
    for i, (text, joiner, page, fresh) in enumerate(parts):
        if held and (fresh or len(held) + len(joiner) + len(text) > size):
            yield held, first, last, page, begin
            held, first, begin = "", page, i
        elif not held:
            begin = i
            first = page if fresh else first
        held = (held + joiner + text).strip() if held else text
        last = page
    if held:
        yield held, first, last, last, begin


_UNIT = re.compile(r"\n\s*\n|\n(?=[A-ZĐ])")
_SENTENCE = re.compile(r"(?<=[.!?;:])\s+")


def semantic_parts(pages: Iterable[tuple[int, str]], size: int) -> Iterator[tuple[str, str, int, bool]]:
    """Paragraphs, and in place of those over the size their sentences, cut to the limit where they need it."""
    for page, text in pages:
        for unit in filter(None, map(str.strip, _UNIT.split(text))):
            if len(unit) <= size:
                yield unit, JOINER, page, False
            else:
                sentences = [piece for s in _SENTENCE.split(unit) for piece in within_limit(s, size)]
                yield from ((s, " ", page, i == 0) for i, s in enumerate(sentences))


def semantic_pieces(pages: Iterable[tuple[int, str]], size: int) -> list[tuple[str, int, int]]:
    """Paragraphs packed up to the size over the ends of pages: (text, first page, last page)."""
    return [(text, first, last) for text, first, last, _, _ in packed(_opened(semantic_parts(pages, size)), size)]


def _opened(parts: Iterable[tuple[str, str, int, bool]]) -> Iterator[tuple[str, str, int, bool]]:
    """A fresh part at the very start opens nothing that is not open already."""
    for i, (text, joiner, page, fresh) in enumerate(parts):
        yield text, joiner, page, fresh and i > 0


_LEVEL = [re.compile(pattern, 0 if level == "clause" else re.IGNORECASE) for level, pattern in HEADINGS.items()]


def hierarchical_pieces(pages: Iterable[tuple[int, str]], size: int) -> tuple[list[tuple[str, int, int, tuple]], bool]:
    """The text under each heading packed up to the size: (text, first page, last page, headings above), and whether
    there is any heading.

    A heading line is kept whole, whatever its length, and opens a piece; the headings at its own level and below give
    way to it.  A piece ends on the page of the line that closes it."""
    parts: list[tuple[str, str, int, bool]] = []
    paths: list[tuple] = []
    path: tuple = (None,) * len(LEVELS)
    number = 1
    for number, text in pages:
        for line in text.splitlines():
            depth = next((i for i, shape in enumerate(_LEVEL) if shape.match(line)), None)
            if depth is not None:
                path = (*path[:depth], line.strip(), *(None,) * (len(LEVELS) - depth - 1))
            lines = [line] if depth is not None else within_limit(line, size)
            parts += [(x, "\n", number, depth is not None) for x in lines]
            paths += [path] * len(lines)
    pieces = list(packed(parts, size))
    out = [(text.strip(), first, number if i == len(pieces) - 1 else closed, paths[begin]) for i, (text, first, _, closed, begin) in enumerate(pieces)]
    return out, any(fresh for *_, fresh in parts)


_SHAPE = "source string, ocr_used boolean, page_count int, number int, first int, last int, text string"


def _by_document(documents: DataFrame, cut, extra: str) -> DataFrame:
    """Runs `cut` on the pages of each document; one document at a time is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for source, ocr, n, pages in zip(frame["source"], frame["ocr_used"], frame["page_count"], frame["pages"], strict=True):
                rows = cut([(int(p["page"]), p["text"]) for p in pages])
                if rows:
                    out = pd.DataFrame(rows)
                    out.insert(0, "number", range(1, len(rows) + 1))
                    out.insert(0, "page_count", n)
                    out.insert(0, "ocr_used", ocr)
                    out.insert(0, "source", source)
                    yield out

    schema = _SHAPE + extra
    names = [x.split()[0] for x in re.split(r", (?![^<]*>)", schema)]

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in run(batches):
            out.columns = names
            yield out

    return documents.select("source", "ocr_used", "page_count", "pages").mapInPandas(named, schema)


def _records(rows: DataFrame, strategy: str, *extra: str | Column) -> DataFrame:
    first, last = page_range("ocr_used", "page_count", "first", "last")
    return rows.select(
        "source", "number", chunk_id(file_stem("source"), F.lit(strategy), "number").alias("chunk_id"), F.lit(strategy).alias("strategy"),
        first.alias("page_start"), last.alias("page_end"), "text", *extra,
    )


def semantic_chunks(documents: DataFrame, size: int = 1200) -> DataFrame:
    """Paragraph chunks of documents (page_documents)."""
    return _records(_by_document(documents, lambda pages: [(a, b, t) for t, a, b in semantic_pieces(pages, size)], ""), "semantic")


def hierarchical_chunks(documents: DataFrame, size: int = 1200) -> DataFrame:
    """Chunks with the headings above them; `warning` says where a document has no heading at all."""

    def cut(pages: list[tuple[int, str]]) -> list[tuple]:
        pieces, found = hierarchical_pieces(pages, size)
        return [(a, b, t, *path, None if found else NO_HEADING) for t, a, b, path in pieces]

    rows = _by_document(documents, cut, "".join(f", {x} string" for x in LEVELS) + ", warning string")
    known = F.coalesce(*[F.col(x) for x in LEVELS]).isNotNull()
    return _records(rows, "hierarchical", F.when(known, F.struct(*LEVELS)).alias("structure"), "warning")


def html_chunks(documents: DataFrame, key: str = "id", html: str = "content_html") -> DataFrame:
    """Kept paragraphs numbered from 0: doc_id, number, chunk_id, text."""
    rows = documents.select(F.col(key).alias("doc_id"), F.posexplode(html_paragraphs(html)).alias("number", "text"))
    return rows.withColumn("chunk_id", F.format_string("%s_chunk_%d", F.col("doc_id").cast("string"), "number"))


def next_edges(chunks: DataFrame, key: str, order: str, node: str) -> DataFrame:
    """(src, dst) from each chunk to the one after it."""
    w = Window.partitionBy(key).orderBy(order, node)
    return chunks.select(F.lag(node).over(w).alias("src"), F.col(node).alias("dst")).filter("src IS NOT NULL")


def parent_edges(chunks: DataFrame, key: str, order: str, node: str) -> DataFrame:
    """(src, dst) from a document's first chunk to all later ones."""
    w = Window.partitionBy(key).orderBy(order, node)
    return chunks.select(F.first(node).over(w).alias("src"), F.col(node).alias("dst"), F.row_number().over(w).alias("r")).filter("r > 1").drop("r")


def chunk_statistics(chunks: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    n = F.length(text)
    return chunks.groupBy(*keys).agg(
        F.count(text).alias("chunk_count"), F.coalesce(F.min(n), F.lit(0)).alias("length_min"), F.coalesce(F.max(n), F.lit(0)).alias("length_max"),
        F.coalesce(F.round(F.avg(n), 2), F.lit(0.0)).alias("length_avg"),
    )


def blank(c: str | Column) -> Column:
    """Null, empty or white space only."""
    text = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.regexp_replace(text, f"[{SPACE}]+", "") == "", F.lit(True))
