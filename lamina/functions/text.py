"""Text functions as columns; only Unicode composition needs Python, in Arrow batches and where it changes anything."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Heading patterns by level, tried in this order; letter case plays no part.
HEADINGS = {
    "chapter": r"^\s*(CHƯƠNG|PHẦN)\s+[IVXLCDM0-9]+\b.*",
    "section": r"^\s*MỤC\s+[IVXLCDM0-9]+\b.*",
    "article": r"^\s*ĐIỀU\s+\d+\b.*",
    "clause": r"^\s*\d+\.\s+.+",
    "point": r"^\s*[a-zđ]\)\s+.+",
}
LEVELS = tuple(HEADINGS)
# Kinds of provisions that a legal reference names.
REFERENCE = r"(điều|khoản|điểm|chương|thông tư|nghị định|luật)\s+\d+"
# Names of the quality flags of a page, in order.
FLAGS = ("text_rong", "ky_tu_thay_the", "dau_hieu_loi_encoding", "so_chen_trong_tu_do_loi_font", "hoa_thuong_bat_thuong_trong_tu", "nhieu_ky_tu_dieu_khien")
#: What counts as white space, as the inside of a character class that Java and RE2 both read.
SPACE = r"\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: A character outside these blocks may be one that composition changes; few ranges keep the test short.
_DECOMPOSED = r"[^\x{0}-\x{2ff}\x{1e00}-\x{1eff}\x{2002}-\x{206f}]"


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def composed(c: str | Column) -> Column:
    """Composed form; only texts that hold a character it may change travel to Python."""
    text = col(c)
    return F.coalesce(_nfc(F.when(text.rlike(_DECOMPOSED), text)), text)


def normalise(c: str | Column) -> Column:
    """Composed form, line ends as line feeds.  Null stays null."""
    return F.regexp_replace(composed(c), "\r\n?", "\n")


def strip(c: str | Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col(c), f"^[{SPACE}]+|[{SPACE}]+$", "")


def squeeze(c: str | Column) -> Column:
    """Composed, trimmed, runs of white space as one space; null as the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(composed(c), F.lit("")), f"[{SPACE}]+", " "))


def fold(c: str | Column) -> Column:
    """Lower case with ß as ss."""
    return F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss"))


def tokens(c: str | Column) -> Column:
    """Words of letters, digits and underscores of the composed text, folded; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(fold(composed(c)), F.lit("")), r"[^\p{L}\p{N}_]+"), "")


def text_problems(c: str | Column) -> Column:
    """Quality flags of a page: empty, replacement characters, wrong encoding, digits in words, mixed case, controls."""
    t = F.coalesce(col(c), F.lit(""))
    solid = F.length(F.regexp_replace(t, f"[{SPACE}]", ""))
    controls = F.length(t) - F.length(F.regexp_replace(t, r"[\x00-\x08\x0b-\x1f]", ""))
    letter = "A-Za-zĐđ"
    rules = [
        solid == 0,
        F.contains(t, F.lit("�")),
        t.rlike("Ã.|Ä.|Â.|�"),
        F.regexp_count(t, F.lit(rf"(?<=[{letter}])\p{{Nd}}(?=[{letter}])")) >= 3,
        F.regexp_count(t, F.lit(rf"(?<![\p{{L}}\p{{N}}_])[{letter}]*[a-zđ][A-ZĐ][{letter}]*(?![\p{{L}}\p{{N}}_])")) >= 3,
        (solid > 0) & (controls > solid * 0.02),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in zip(FLAGS, rules, strict=True)]))


def heading_level(c: str | Column) -> Column:
    """The first level whose pattern the line begins with, else null."""
    line = col(c)
    return F.coalesce(*[F.when(line.rlike(("(?U)" if level == "clause" else "(?iuU)") + pattern), F.lit(level)) for level, pattern in HEADINGS.items()])


def leading_heading(c: str | Column) -> Column:
    """'Chương X' or 'Điều n' at the very start of a text, white space aside, else null."""
    found = F.regexp_extract(strip(F.coalesce(col(c), F.lit(""))), r"(?iuU)^(Chương\s+[IVXLCDM]+|Điều\s+\d+)", 1)
    return F.when(found != "", found)


def trailing_number(c: str | Column) -> Column:
    """The number after the last colon, 0 if there is none."""
    return F.coalesce(F.regexp_extract(col(c), ":([0-9]+)$", 1).try_cast("long"), F.lit(0))


def chunk_id(stem: str | Column, strategy: str | Column, number: str | Column) -> Column:
    return F.format_string("%s:%s:%04d", col(stem), col(strategy), col(number))


def file_stem(c: str | Column) -> Column:
    """A file's name without folders and its last extension."""
    return F.regexp_replace(F.regexp_replace(col(c), "^.*/", ""), r"(?<=.)\.[^.]*$", "")


def page_range(ocr_used: str | Column, page_count: str | Column, first: str | Column, last: str | Column) -> tuple[Column, Column]:
    """First and last page of a piece; a document read by OCR always stands on all its pages."""
    ocr = F.coalesce(col(ocr_used), F.lit(False))
    return F.when(ocr, F.lit(1)).otherwise(col(first)), F.when(ocr, col(page_count)).otherwise(col(last))


def parent_key(source: str | Column, article: str | Column, window: str | Column) -> Column:
    """Twelve hexadecimal digits that name a parent window."""
    return F.substring(F.sha2(F.concat_ws("_", col(source), col(article), col(window).cast("string")), 256), 1, 12)


def legal_references(c: str | Column) -> Column:
    """All references to provisions, in lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(REFERENCE), F.lit(0))


def contains_folded(c: str | Column, needle: str) -> Column:
    return F.contains(F.lower(col(c)), F.lower(F.lit(needle)))


def preview(c: str | Column, size: int = 100) -> Column:
    return F.translate(F.substring(col(c), 1, size), "\n", " ")


def page_label(first: str | Column, last: str | Column) -> Column:
    """'tr. a' or 'tr. a-b'."""
    a, b = col(first), col(last)
    return F.when(a == b, F.format_string("tr. %d", a)).otherwise(F.format_string("tr. %d-%d", a, b))


def citation(source: str | Column, first: str | Column, last: str | Column, chunk: str | Column) -> Column:
    return F.format_string("[Nguồn: %s, %s, chunk: %s]", col(source), page_label(first, last), col(chunk))


def scored_citation(label: str | Column, source: str | Column, first: str | Column, last: str | Column, score: str | Column) -> Column:
    """'[P1] Nguồn: source (p.a-b) - Rerank Score: 0.87'; both pages are always written."""
    return F.format_string("[%s] Nguồn: %s (p.%d-%d) - Rerank Score: %.2f", col(label), col(source), col(first), col(last), F.coalesce(col(score), F.lit(0.0)))


def secure_citation(number: str | Column, title: str | Column, article: str | Column, chunk: str | Column) -> Column:
    """By document number, or by title where there is none."""
    n = col(number)
    head = F.when(n.isNotNull() & (F.trim(n) != ""), F.concat(F.lit("Số "), n)).otherwise(F.coalesce(col(title), F.lit("")))
    return F.format_string("[%s | %s | %s]", head, F.coalesce(col(article), F.lit("")), col(chunk))


def file_name(c: str | Column) -> Column:
    """Nine characters that file systems refuse become underscores."""
    return strip(F.translate(col(c), '<>:"/\\|?*', "_________"))


def money(c: str | Column) -> Column:
    """Rounded, thousands separated by commas, with the unit; blank is 0; what is no number keeps its text before the unit."""
    text = F.coalesce(col(c).cast("string"), F.lit(""))
    number = F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))
    return F.concat(F.coalesce(F.format_number(F.when(~F.isnan(number), number), 0), text), F.lit(" VNĐ"))


def entity_title(key: str | Column, name: str | Column) -> Column:
    """'id - name', or the id alone where the name is blank or the same."""
    k, n = col(key), F.trim(F.coalesce(col(name), F.lit("")))
    return F.when((n == "") | (n == k), k).otherwise(F.concat(k, F.lit(" - "), n))


def yaml_id(c: str | Column) -> Column:
    """The first id of a YAML block between lines of dashes, else null."""
    found = F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(?sm)^---\s*\n.*?id:\s*([^\n]+).*?\n---", 1)
    return F.when(found != "", strip(found))


def wikilinks(c: str | Column) -> Column:
    """Targets of [[target]] and [[target|alias]], in order."""
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"\[\[([^\|\]]+)(?:\|[^\]]+)?\]\]"), F.lit(1))


def structure_path(struct: str, joiner: str = " › ") -> Column:
    """The headings above a chunk; a dash where there are none."""
    path = F.concat_ws(joiner, *[F.col(f"{struct}.{level}") for level in LEVELS])
    return F.when(path == "", F.lit("—")).otherwise(path)


def length_label(least: str | Column, most: str | Column) -> Column:
    """'min–max'."""
    return F.concat(col(least).cast("string"), F.lit("–"), col(most).cast("string"))


def edge_label(source: str | Column, kind: str | Column, target: str | Column) -> Column:
    return F.format_string("%s ==[%s]==> %s", col(source), col(kind), col(target))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _entities(parts: pd.Series) -> pd.Series:
    return parts.map(lambda xs: None if xs is None else [html.unescape(x) for x in xs])


def unescape(parts: Column) -> Column:
    """An array of texts with all character references decoded; arrays without & stay in the JVM."""
    marked = F.exists(parts, lambda p: F.contains(p, F.lit("&")))
    return F.coalesce(_entities(F.when(marked, parts)), parts)


def html_paragraphs(c: str | Column, least: int = 20) -> Column:
    """Text of <p> elements longer than `least` characters: tags in any case, character references decoded.

    An element ends at </p>, at the next <p> or at the end; scripts, styles and comments are removed first,
    and of a paragraph's text each part between tags is stripped."""
    bare = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", "")
    parts = F.split(bare, r"(?i)<p(?=[\s>/])[^>]*>")
    inner = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: F.split(p, r"(?i)</p\s*>")[0])
    plain = unescape(F.transform(inner, lambda p: F.array_join(F.transform(F.split(p, r"<[^>]+>"), lambda x: strip(x)), "")))
    return F.filter(F.transform(plain, lambda p: strip(p)), lambda p: F.length(p) > least)
