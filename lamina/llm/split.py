"""Splitting oversized items at natural boundaries (problem 1).

Recursive bisection: a piece longer than the limit minus the overlap is cut at the
strongest boundary near its midpoint and both halves are treated alike; afterwards
every piece but the first is extended to the left by the overlap, so neighbours
share exactly that many characters and no piece exceeds the limit.

Defined cases: a null text gives no piece; a text within the limit, the empty one
included, gives one piece that is the text itself; a row without a limit is never
cut; a text without any boundary is cut at its midpoint, and neither a cut nor the start of an
overlap lies before a combining mark or joiner, as long as there is another place; null pages stay null, one known page stands for both.  Repeated
rows give repeated pieces; extra columns pass through, and a column with the name of
a result column gives way to it.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Boundaries from the strongest to the weakest; a cut lies after the match.
BOUNDARIES = (
    r"\n(?=[ \t]*(?:Chương|Mục|Điều|Chapter|Section|Article)\s)",
    r"\n[ \t\r]*\n\s*",
    r"\n+",
    r"(?:[.!?…]+[\"'”’»)\]]*\s+|[。！？])",
    r"[;:]\s+",
    r"[,–—]\s+",
    r"\s+",
    r"​",
)
_PATTERNS = [re.compile(b, re.IGNORECASE) for b in BOUNDARIES]
RESULT_COLUMNS = ("piece_no", "n_pieces", "piece", "char_start", "char_end", "piece_page_start", "piece_page_end")


def _positions(text: str) -> list[list[int]]:
    """Sorted cut positions by strength; a position counts at its greatest strength only."""
    seen: set[int] = set()
    levels = []
    for pattern in _PATTERNS:
        level = [m.end() for m in pattern.finditer(text) if 0 < m.end() < len(text) and m.end() not in seen]
        seen.update(level)
        levels.append(level)
    return levels


def _nearest(level: list[int], mid: int, low: int, high: int) -> int | None:
    i = bisect_left(level, mid)
    best = [p for p in level[max(0, i - 1) : i + 1] if low <= p <= high]
    return min(best, key=lambda p: (abs(p - mid), p)) if best else None


def _parts(text: str, at: int) -> bool:
    """Whether a border here would part a mark or joined sign from what it belongs to."""
    return 0 < at < len(text) and (unicodedata.combining(text[at]) != 0 or text[at] in "\u200d\ufe0f" or text[at - 1] == "\u200d")


def _clean(text: str, at: int, overlap: int) -> bool:
    """Whether neither the cut nor the start of the overlap before it parts a mark from its letter."""
    return not (_parts(text, at) or _parts(text, at - overlap))


def _hard(text: str, mid: int, low: int, high: int, overlap: int) -> int:
    """The place nearest the midpoint that parts no mark from its letter; the midpoint itself where there is none."""
    for step in range(max(mid - low, high - mid) + 1):
        for at in (mid - step, mid + step):
            if low <= at <= high and _clean(text, at, overlap):
                return at
    return mid


def cuts(text: str, limit: int, overlap: int) -> list[int]:
    """Positions at which the text is cut; none for a text within the limit."""
    if limit <= 0 or overlap < 0 or overlap >= limit:
        raise ValueError("0 <= overlap < limit is needed")
    if len(text) <= limit:
        return []
    room = limit - overlap
    levels = [[p for p in level if _clean(text, p, overlap)] for level in _positions(text)]
    out: list[int] = []
    todo = [(0, len(text))]
    while todo:
        start, end = todo.pop()
        if end - start <= (limit if start == 0 else room):
            continue
        size, mid = end - start, (start + end) // 2
        least = min(overlap, size // 4)
        at = None
        for low, high in ((start + max(least, size // 4), end - max(least, size // 4)), (start + max(1, least), end - max(1, least))):
            at = next((p for level in levels if (p := _nearest(level, mid, low, high)) is not None), None)
            if at is not None:
                break
        if at is None:
            at = _hard(text, mid, start + max(1, least), end - max(1, least), overlap)
        out.append(at)
        todo += [(start, at), (at, end)]
    return sorted(out)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _cuts_batch(text: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else cuts(t, int(n), int(o)) for t, n, o in zip(text, limit, overlap, strict=True)])


def split_oversized(df: DataFrame, limits: DataFrame, key: str = "strategy", text: str = "text") -> DataFrame:
    """Every row of `df` as its ordered pieces, with RESULT_COLUMNS added.

    `limits` has `key`, max_chars and overlap_chars, one row per key.  Only texts over their
    limit travel to Python, and only the cut positions come back; the pieces are cut in the JVM."""
    df = df.drop(*[c for c in df.columns if c in {*RESULT_COLUMNS, "__limit", "__overlap", "__cuts", "__key"}])
    rule = limits.select(F.col(key).alias("__key"), F.col("max_chars").alias("__limit"), F.col("overlap_chars").alias("__overlap"))
    body = F.col(text)
    over = F.length(body) > F.col("__limit")
    # One row per strategy, a handful by definition of the table; the planner may broadcast it under its own size limit.
    known = df.join(rule, F.col(key) == F.col("__key"), "left").drop("__key")
    found = known.withColumn("__cuts", _cuts_batch(F.when(over, body), F.coalesce("__limit", F.lit(1)), F.coalesce("__overlap", F.lit(0))))
    inner = F.coalesce(F.col("__cuts"), F.array().cast("array<int>"))
    bounds = F.concat(F.array(F.lit(0)), inner, F.array(F.coalesce(F.length(body), F.lit(0))))
    found = found.filter(body.isNotNull()).withColumn("__cuts", bounds)
    n = F.size("__cuts") - 1
    rows = found.select("*", n.alias("n_pieces"), F.explode(F.sequence(F.lit(1), n)).alias("piece_no"))
    end = F.element_at("__cuts", F.col("piece_no") + 1)
    own = F.element_at("__cuts", F.col("piece_no"))
    start = F.when(F.col("piece_no") == 1, F.lit(0)).otherwise(F.greatest(F.lit(0), own - F.coalesce("__overlap", F.lit(0))))
    rows = rows.withColumn("char_start", start).withColumn("char_end", end)
    rows = rows.withColumn("piece", F.when(F.col("n_pieces") == 1, body).otherwise(F.substring(body, F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))))
    return rows.drop("__limit", "__overlap", "__cuts")


def piece_pages(first: str | Column = "page_start", last: str | Column = "page_end", text: str = "text") -> tuple[Column, Column]:
    """First and last page of a piece: the chunk's pages are laid evenly over its characters."""
    a = F.coalesce(F.col(first), F.col(last))
    b = F.greatest(F.coalesce(F.col(last), F.col(first)), a)
    size = F.greatest(F.length(text), F.lit(1))
    page = lambda at: F.least(b, a + F.floor(at * (b - a + 1) / size)).cast("int")
    return page(F.col("char_start")), page(F.greatest(F.col("char_end") - 1, F.col("char_start")))


def split_chunks(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """split_oversized over chunks, with a page_start and page_end for each piece."""
    first, last = piece_pages()
    return split_oversized(chunks, limits).withColumn("piece_page_start", first).withColumn("piece_page_end", last)
