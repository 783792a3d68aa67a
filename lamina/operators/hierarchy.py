"""Hierarchy of children and parents.

One source may hold a large share of all chunks, and one article a large share of those.  Both walks over a source's
chunks in order are therefore made in blocks of BLOCK numbers: every block is walked by itself, what it hands to the
next one is a small row, and only these rows are put in order per source.  Results are those of one walk."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.text import leading_heading, parent_key, trailing_number
from lamina.session import among, cut_lineage

BLOCK = 2048
METHODS = ("metadata", "heading_inferred", "carried_forward", "document_fallback")  # fixed values
FALLBACK = "document_fallback"  # fixed value: the article key of children without an article


def _given(c: Column) -> Column:
    return F.when(c != "", c)


def carried(rows: DataFrame, group: str, block: Column, order: list, values: list[str]) -> DataFrame:
    """Adds carried_<value>: the last non-null value of the rows before, in order, within the group.

    `block` must not fall along the order.  Within a block a window looks back; across blocks the last values
    of whole blocks are carried, one row a block."""
    rows = rows.withColumn("__block", block)
    place = F.struct(*order)
    last = rows.groupBy(group, "__block").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), place)).alias(f"__last_{v}") for v in values])
    over = Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select(F.col(group).alias("__group"), F.col("__block").alias("__b"), *[F.last(f"__last_{v}", True).over(over).alias(f"__before_{v}") for v in values])
    met = rows.join(before, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__block") == F.col("__b")))
    inner = Window.partitionBy(group, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    for v in values:
        met = met.withColumn(f"carried_{v}", F.coalesce(F.last(v, True).over(inner), F.col(f"__before_{v}")))
    return met.drop("__block", "__group", "__b", *[f"__before_{v}" for v in values])


def resolve_hierarchy(chunks: DataFrame, block: int = BLOCK, texts: bool = True) -> DataFrame:
    """Chapter and article of every chunk: chunk_id, source, number, chapter, article, clause, point, method, ambiguous,
    warnings, text, page_start, page_end.

    `chunks` has chunk_id, source, text, page_start, page_end and structure.  Stored headings win over a leading heading of the
    text, that over what the chunks before it in the same source resolved to; a chunk with none of them falls back to
    the document.  Under a stored heading nothing is carried; a leading chapter names no article, a leading article
    keeps the carried chapter.  A leading heading that is not exactly the stored one is ambiguous.  An empty stored heading is none.

    Without `texts`, n_chars and digest stand for the text, which then isn't shuffled, and a chunk that is stored twice counts once."""
    held = {"text": F.col("text")} if texts else {"n_chars": F.length("text"), "digest": F.xxhash64("text")}
    rows = chunks.select(
        "chunk_id", "source", *[c.alias(name) for name, c in held.items()], "page_start", "page_end", trailing_number("chunk_id").alias("number"), leading_heading("text").alias("h"),
        *[_given(F.col(f"structure.{x}")).alias(f"meta_{x}") for x in ("chapter", "article", "clause", "point")],
    )
    rows = rows if texts else rows.dropDuplicates(["chunk_id"])
    is_article = F.lower("h").startswith("điều")
    rows = rows.withColumn("head_article", F.when(is_article, F.col("h"))).withColumn("head_chapter", F.when(~is_article, F.col("h")))
    stored = F.col("meta_chapter").isNotNull() | F.col("meta_article").isNotNull()
    own = lambda part: F.when(stored, F.col(f"meta_{part}")).otherwise(F.col(f"head_{part}"))
    rows = rows.withColumn("chapter", own("chapter")).withColumn("article", own("article"))
    rows = carried(rows, "source", F.floor(F.col("number") / block), [F.col("number"), F.col("chunk_id")], ["chapter", "article"])
    headed = F.col("h").isNotNull()
    any_carried = F.col("carried_chapter").isNotNull() | F.col("carried_article").isNotNull()
    method = F.when(stored, METHODS[0]).when(headed, METHODS[1]).when(any_carried, METHODS[2]).otherwise(METHODS[3])
    chapter = F.when(stored, F.col("meta_chapter")).otherwise(F.coalesce("head_chapter", "carried_chapter"))
    article = F.when(stored | headed, F.col("article")).otherwise(F.col("carried_article"))
    warn = [
        F.when(
            stored & F.col(f"head_{part}").isNotNull() & ~F.col(f"head_{part}").eqNullSafe(F.col(f"meta_{part}")),
            F.format_string(f"Metadata {part} '%s' conflicts with inferred heading '%s'", F.coalesce(f"meta_{part}", F.lit("None")), f"head_{part}"),
        )
        for part in ("chapter", "article")
    ]
    warnings = F.array_compact(F.array(*warn))
    return rows.select(
        "chunk_id", "source", "number", chapter.alias("chapter"), article.alias("article"), F.col("meta_clause").alias("clause"), F.col("meta_point").alias("point"),
        method.alias("method"), (F.size(warnings) > 0).alias("ambiguous"), warnings.alias("warnings"), *held, "page_start", "page_end",
    )


_MAP = T.StructType().add("reach", T.ArrayType(T.LongType())).add("used", T.ArrayType(T.LongType())).add("opened", T.ArrayType(T.LongType()))


def passing(lengths: list[int], most: int) -> tuple[list[int], list[int], list[int]]:
    """How a block of children passes on an open window, whatever that holds on entry.

    All that the entry decides is which child opens the first new window.  reach[i] is what the children up to and with i
    add to the window open on entry, so the first child that does not fit is the first with entry + reach[i] > most.
    used[i] and opened[i] are what the last window then holds and how many were opened, if child i is that child;
    one more entry stands for none."""
    n = len(lengths)
    reach, total = [], 0
    for x in lengths:
        total += x + 1
        reach.append(total)
    used, opened = [0] * n, [0] * n
    end, held = n, 0  # children i .. end-1 make the window that opens with child i; two pointers, from the last child back
    for i in range(n - 1, -1, -1):
        held += lengths[i] + (1 if end > i + 1 else 0)
        while end > i + 1 and held > most:
            end -= 1
            held -= lengths[end] + 1
        used[i], opened[i] = (held, 1) if end == n else (used[end], opened[end] + 1)
    return reach, [*used, -1], [*opened, 0]


@F.pandas_udf(_MAP)
def _passing_batch(lengths: pd.Series, most: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None) if x is None else passing([int(v) for v in x], int(m)) for x, m in zip(lengths, most, strict=True)]
    return pd.DataFrame(rows, columns=["reach", "used", "opened"])


def _entries(blocks: DataFrame, most: int) -> DataFrame:
    """What the window open at the start of each block holds (-1: none is open), and how many were opened before."""
    many = F.count("*").over(Window.partitionBy("source", "article_key"))
    lengths = blocks.select("source", "article_key", "block", F.transform("cs", lambda c: c["n"].cast("long")).alias("ls")).withColumn("many", many).filter("many > 1")
    maps = lengths.select("source", "article_key", "block", _passing_batch("ls", F.lit(most)).alias("m"))
    rows = maps.groupBy("source", "article_key").agg(F.array_sort(F.collect_list(F.struct("block", "m"))).alias("bs"))
    start = F.struct(F.lit(-1).cast("long").alias("used"), F.lit(0).cast("long").alias("opened"), F.array().cast("array<struct<block:long,used:long,opened:long>>").alias("out"))

    def step(acc, b):
        m = b["m"]
        # the position of the first child that opens a window; with none open that is the first child
        first = F.when(acc["used"] < 0, F.lit(0)).otherwise(F.size(F.filter(m["reach"], lambda r: acc["used"] + r <= most)))
        stays = first == F.size(m["reach"])
        used = F.when(stays, acc["used"] + F.element_at(m["reach"], -1)).otherwise(F.get(m["used"], first))
        here = F.struct(b["block"].cast("long").alias("block"), acc["used"].alias("used"), acc["opened"].alias("opened"))
        return F.struct(used.alias("used"), (acc["opened"] + F.get(m["opened"], first)).alias("opened"), F.concat(acc["out"], F.array(here)).alias("out"))

    folded = rows.select("source", "article_key", F.explode(F.aggregate("bs", start, step)["out"]).alias("e"))
    return folded.select(F.col("source").alias("__s"), F.col("article_key").alias("__a"), F.col("e.block").alias("__b"), F.col("e.used").alias("used"), F.col("e.opened").alias("opened"))


def place_children(children: DataFrame, most: int = 6000, block: int = BLOCK) -> DataFrame:
    """Children (with text, or n_chars and digest) and the window_index, from 1, of the parent each belongs to, with article_key and parent_id.

    Greedy in order: a child that does not fit what the open window holds and a line feed opens the next one."""
    held, n = ("text", F.length("text")) if "text" in children.columns else ("digest", F.col("n_chars"))
    rows = children.filter(n.isNotNull()).withColumn("article_key", F.coalesce("article", F.lit(FALLBACK)))
    entry = F.struct("number", "chunk_id", n.alias("n"), "page_start", "page_end", "ambiguous", held)
    blocks = rows.withColumn("block", F.floor(F.col("number") / block)).groupBy("source", "article_key", "block").agg(F.array_sort(F.collect_list(entry)).alias("cs"))
    met = blocks.join(_entries(blocks, most), F.col("source").eqNullSafe(F.col("__s")) & (F.col("article_key") == F.col("__a")) & (F.col("block") == F.col("__b")), "left")
    start = F.struct(F.coalesce("opened", F.lit(0)).cast("long").alias("w"), F.coalesce("used", F.lit(-1)).cast("long").alias("used"), F.array().cast("array<long>").alias("ws"))

    def step(acc, c):
        grown = acc["used"] + 1 + c["n"]
        new = (acc["used"] < 0) | (grown > most)
        w = F.when(new, acc["w"] + 1).otherwise(acc["w"])
        return F.struct(w.alias("w"), F.when(new, c["n"].cast("long")).otherwise(grown.cast("long")).alias("used"), F.concat(acc["ws"], F.array(w)).alias("ws"))

    placed = met.select("source", "article_key", F.explode(F.arrays_zip("cs", F.aggregate("cs", start, step)["ws"].alias("ws"))).alias("z"))
    out = placed.select("source", "article_key", "z.cs.*", F.col("z.ws").cast("int").alias("window_index"))
    return out.withColumn("parent_id", parent_key("source", "article_key", "window_index"))


def parent_windows(children: DataFrame, most: int = 6000, block: int = BLOCK) -> DataFrame:
    """Parents: parent_id, source, article_key, window_index, page_start, page_end, n_children, child_ids (array), text
    (the children's joined by line feeds), char_count, ambiguous_count, oversize (a single child above `most`).

    Of children without texts, child_digests stands for the text, see parent_texts."""
    rows = place_children(children, most, block)
    held, name = ("text", "text") if "text" in rows.columns else ("digest", "child_digests")
    ordered = F.array_sort(F.collect_list(F.struct("number", "chunk_id", held)))
    out = rows.groupBy("parent_id", "source", "article_key", "window_index").agg(
        F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.count("*").alias("n_children"), ordered.alias("__cs"), F.count_if("ambiguous").alias("ambiguous_count"),
        (F.sum("n") + F.count("*") - 1).cast("int").alias("__n"),
    )
    each = F.transform("__cs", lambda x: x[held])
    out = out.withColumn("child_ids", F.transform("__cs", lambda x: x["chunk_id"])).withColumn(name, F.array_join(each, "\n") if held == "text" else each)
    out = out.withColumn("char_count", F.col("__n")).drop("__cs", "__n")
    return out.withColumn("oversize", (F.col("char_count") > most) & (F.col("n_children") == 1))


def registry(windows: DataFrame) -> DataFrame:
    """(id, parent_id) of every child."""
    return windows.select(F.explode("child_ids").alias("id"), "parent_id")


def parent_texts(windows: DataFrame, chunks: DataFrame) -> DataFrame:
    """(parent_id, text) of parents without texts (parent_id, child_ids, child_digests), from the chunks' (chunk_id, text).

    A chunk that is stored twice counts once; of two texts under one id the one that was placed counts."""
    kids = windows.select("parent_id", F.posexplode(F.arrays_zip("child_ids", "child_digests")).alias("place", "c"))
    kids = cut_lineage(kids.select("parent_id", "place", F.col("c.child_ids").alias("chunk_id"), F.col("c.child_digests").alias("digest")))
    texts = among(chunks.select("chunk_id", "text"), kids, "chunk_id").withColumn("digest", F.xxhash64("text"))
    whole = kids.join(texts, ["chunk_id", "digest"]).groupBy("parent_id").agg(F.array_sort(F.collect_set(F.struct("place", "text"))).alias("ts"))
    return whole.select("parent_id", F.array_join(F.transform("ts", lambda x: x["text"]), "\n").alias("text"))


def hierarchy_audit(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Counts by resolution method, of ambiguous children, warnings and oversized parents, and sizes of the parents, as
    (metric, value) rows."""
    methods = children.groupBy("method").agg(F.count("*").alias("n")).select(F.concat(F.lit("method:"), "method").alias("metric"), F.col("n").cast("double").alias("value"))

    def named(one: DataFrame, names: dict[str, str]) -> DataFrame:
        pairs = [F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value")) for n, c in names.items()]
        return one.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")

    sizes = parents.agg(F.min("char_count").alias("a"), F.max("char_count").alias("b"), F.median("char_count").alias("c"), F.count("*").alias("d"), F.count_if("oversize").alias("e"))
    flags = children.agg(F.count("*").alias("a"), F.count_if("ambiguous").alias("b"), F.sum(F.size("warnings")).alias("c"))
    sizes = named(sizes, {"parent_min": "a", "parent_max": "b", "parent_median": "c", "parents": "d", "oversized_parents": "e"})
    return methods.unionByName(sizes).unionByName(named(flags, {"children": "a", "ambiguous": "b", "warnings": "c"}))


def fingerprints(files: DataFrame) -> DataFrame:
    """(name, size, modified) of the input files of a store: rows of a reader with the file's metadata column."""
    return files.select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified")).distinct()
