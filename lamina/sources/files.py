"""Chunk files, CSV tables, stores and report sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.text import entity_title, file_name, normalise, text_problems

OCR_PAGES = "ocr_toan_tai_lieu; page mapping chi biet 1..N"  # fixed value: the warning of a page read by OCR
CHUNK = T.StructType([
    T.StructField("chunk_id", T.StringType()), T.StructField("strategy", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("page_start", T.StringType()), T.StructField("page_end", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("structure", T.StructType([T.StructField(x, T.StringType()) for x in ("chapter", "section", "article", "clause", "point")])),
])
STRATEGIES = ("fixed-size", "semantic", "hierarchical")


def read_chunks(spark: SparkSession, folder: str, strategy: str | None = None, glob: str = "*.json") -> DataFrame:
    """Chunk records of JSON files that hold a list or an object with a list `chunks`, with file and problem.

    Page numbers are read as text, so that true or 1.5 is a bad page and not a number.  Other strategies than
    the one asked for are left out; nothing is inferred."""
    wrapped = T.StructType([*CHUNK.fields, T.StructField("chunks", T.ArrayType(CHUNK))])
    raw = spark.read.schema(wrapped).option("multiLine", True).option("pathGlobFilter", glob).json(folder).select("*", F.col("_metadata.file_name").alias("file"))
    listed = raw.filter("chunks IS NOT NULL").select(F.explode("chunks").alias("c"), "file").select("c.*", "file")
    rows = raw.filter("chunks IS NULL").drop("chunks").unionByName(listed)
    whole = r"^[0-9]+$"
    page = lambda c: F.when(F.col(c).rlike(whole), F.col(c).cast("int"))
    bad_page = ~F.coalesce(F.col("page_start").rlike(whole) & F.col("page_end").rlike(whole), F.lit(False))
    problem = (
        F.when(F.col("chunk_id").isNull() | F.col("source").isNull() | F.col("text").isNull(), "missing_field")
        .when(~F.coalesce(F.col("strategy").isin(*STRATEGIES), F.lit(False)), "bad_strategy")
        .when(bad_page, "bad_page")
        .when((page("page_start") < 1) | (page("page_start") > page("page_end")), "page_order")
        .when(F.trim("text") == "", "skipped_blank")
    )
    rows = rows.withColumn("problem", problem).withColumn("page_start", page("page_start")).withColumn("page_end", page("page_end"))
    return rows.filter(F.col("strategy") == strategy) if strategy else rows


def strict(chunks: DataFrame) -> DataFrame:
    """Valid records only; a record that is wrong raises with its file and id, and so does a repeated id."""
    place = F.concat_ws(" ", F.col("problem"), F.col("file"), F.col("chunk_id"))
    wrong = F.col("problem").isNotNull() & (F.col("problem") != "skipped_blank")
    from pyspark.sql import Window

    rows = chunks.filter(F.when(wrong, F.raise_error(place).cast("boolean")).otherwise(F.col("problem").isNull()))
    n = F.count("*").over(Window.partitionBy("chunk_id"))
    return rows.withColumn("__n", n).withColumn("chunk_id", F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("repeated id "), "chunk_id"))).otherwise(F.col("chunk_id"))).drop("__n", "problem")


def loader_statistics(chunks: DataFrame, strategy: str | None = None) -> DataFrame:
    """files, records, selected (of the strategy, if one is asked for), empty and valid ones of the selected."""
    chosen = F.coalesce(F.col("strategy") == strategy, F.lit(False)) if strategy else F.lit(True)
    return chunks.agg(
        F.count_distinct("file").alias("files"), F.count("*").alias("records"), F.count_if(chosen).alias("selected"),
        F.count_if(chosen & F.coalesce(F.col("problem") == "skipped_blank", F.lit(False))).alias("empty"), F.count_if(chosen & F.col("problem").isNull()).alias("valid"),
    )


def read_csv(spark: SparkSession, path: str, columns: list[str], blank: bool = False) -> DataFrame:
    """A CSV with a header; every column is text, ids above all.  blank: nulls become the empty string, for export."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.na.fill("") if blank else df


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """With a header; bom marks each file as UTF-8 for spreadsheets (its first column's name begins with the mark)."""
    first = df.columns[0]
    out = df.withColumnRenamed(first, "\ufeff" + first) if bom else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON files by source and strategy; the commit protocol leaves no partial output."""
    chunks.write.mode("overwrite").partitionBy("source", "strategy").json(path)


def write_raw(documents: DataFrame, path: str) -> None:
    """Raw documents (chunking.page_documents) by source: page_count, ocr_used, language, warnings and the pages, each with
    what holds for the document."""
    given = lambda c, other: F.col(c) if c in documents.columns else other
    language, warnings = given("language", F.lit("vi")), given("warnings", F.array().cast("array<string>"))
    page = lambda p: F.struct(F.col("source").alias("source"), p["page"].alias("page"), F.col("ocr_used").alias("ocr_used"), language.alias("language"), p["text"].alias("text"))
    out = documents.select(F.col("source").alias("document"), "source", "page_count", "ocr_used", language.alias("language"), warnings.alias("warnings"), F.transform("pages", page).alias("pages"))
    out.write.mode("overwrite").partitionBy("document").json(path)


def chunk_report(statistics: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per source: ocr_used, statistics (map by strategy) and warnings, from chunk_statistics by source and strategy."""
    one = F.struct("strategy", F.struct("chunk_count", "length_min", "length_max", "length_avg"))
    rows = statistics.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(one))).alias("statistics"))
    warnings = F.col("warnings") if "warnings" in documents.columns else F.array().cast("array<string>")
    return documents.select("source", "ocr_used", warnings.alias("warnings")).join(rows, "source", "left").select("source", "ocr_used", "statistics", "warnings")


def create_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table of a folder, made empty where there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def insert_ignore(stored: DataFrame, incoming: DataFrame, key: str, required: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """Incoming rows whose key is new, one whole row per key: what is to be appended.

    The first writer by `order` wins, ties and rows without an order by all columns.  A row without its key or with a null
    in a `required` column raises, as a table with these constraints would."""
    others = [c for c in incoming.columns if c != key]
    lacking = [c for c in (key, *required)]
    bad = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in lacking])
    checked = incoming.withColumn(key, F.when(bad.isNull(), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("null in "), bad)).cast(dict(incoming.dtypes)[key])))
    rank = F.struct(*([F.col(order).alias("__order")] if order else []), *[F.col(c).isNull().alias(f"__null_{i}") for i, c in enumerate(others)], *others) if others else F.col(key)
    one = checked.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in incoming.columns]), rank).alias("__row")).select("__row.*")
    return one.join(stored.select(key), key, "left_anti").select(incoming.columns)


def lookup(stored: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Stored rows of the wanted keys, with what `wanted` says about their order; unknown keys give no row."""
    return wanted.join(stored, key, "inner")


def write_store(children: DataFrame, parents: DataFrame, path: str, manifest: dict) -> None:
    """Children, parents and then the manifest, so that a manifest tells a complete store."""
    spark = children.sparkSession
    children.write.mode("overwrite").parquet(f"{path}/children")
    parents.write.mode("overwrite").parquet(f"{path}/parents")
    spark.createDataFrame([(k, str(v)) for k, v in sorted(manifest.items())], "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def read_store(spark: SparkSession, path: str, wanted: dict | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """The store, all three parts needed; a property that differs from `wanted` raises."""
    manifest = {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/manifest").collect()}  # a row for each property
    for name, value in (wanted or {}).items():
        if manifest.get(name) != str(value):
            raise ValueError(f"the store's {name} is {manifest.get(name)!r}, not {str(value)!r}")
    return spark.read.parquet(f"{path}/children"), spark.read.parquet(f"{path}/parents"), manifest


def page_rows(documents: DataFrame) -> DataFrame:
    """Nested documents (source, pages array of page, text, warnings) flattened to a row per page, by number.

    If any page of a document has a warning the whole document wants OCR."""
    wants = F.exists("pages", lambda p: F.size(p["warnings"]) > 0)
    return documents.select("source", wants.alias("would_use_ocr"), F.posexplode("pages").alias("number", "p")).select("source", "would_use_ocr", "number", "p.*")


def dry_run(pages: DataFrame) -> DataFrame:
    """Per source of (source, page, text): would_use_ocr, bad_pages in order, n_pages; nothing is written."""
    rows = pages.select("source", "page", (F.size(text_problems("text")) > 0).alias("bad")).groupBy("source", "page").agg(F.max("bad").alias("bad"))
    out = rows.groupBy("source").agg(F.array_sort(F.collect_list(F.when(F.col("bad"), F.col("page")))).alias("bad_pages"), F.count("*").alias("n_pages"))
    return out.select("source", (F.size("bad_pages") > 0).alias("would_use_ocr"), "bad_pages", "n_pages")


def read_documents(spark: SparkSession, folder: str, extract: Callable[[bytes], list[str]], recognise: Callable[[bytes], str] | None = None, glob: str = "*.pdf") -> DataFrame:
    """Pages of binary files through plug-ins: source, page, text, warnings, ocr_used, page_count.

    `extract` gives the text layer of each page.  A page on which it fails, or whose text shows a quality problem, sends the whole
    document to `recognise`, whose text becomes one page that stands for all; without that plug-in the text layer stays,
    with its warnings."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select(F.col("_metadata.file_name").alias("source"), "content")

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for source, content in zip(frame["source"], frame["content"], strict=True):
                try:
                    texts, failed = extract(bytes(content)), None
                except Exception as e:  # noqa: BLE001
                    texts, failed = [""], f"exception:{type(e).__name__}"
                yield pd.DataFrame({"source": source, "page": range(1, len(texts) + 1), "text": texts, "failed": failed, "page_count": len(texts)})

    raw = files.mapInPandas(pages, "source string, page int, text string, failed string, page_count int").withColumn("text", normalise("text"))
    raw = raw.withColumn("warnings", F.when(F.col("failed").isNotNull(), F.array("failed")).otherwise(text_problems("text"))).drop("failed").withColumn("ocr_used", F.lit(False))
    if recognise is None:
        return raw
    wanting = raw.filter(F.size("warnings") > 0).groupBy("source").agg(F.first("page_count").alias("page_count"))

    @F.pandas_udf("string")
    def read(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: recognise(bytes(c)))

    seen = files.join(wanting, "source").select("source", F.lit(1).alias("page"), normalise(read("content")).alias("text"), "page_count", F.array(F.lit(OCR_PAGES)).alias("warnings"), F.lit(True).alias("ocr_used"))
    return raw.join(wanting.select("source"), "source", "left_anti").unionByName(seen)


def markdown_pages(entities: DataFrame, links: DataFrame) -> DataFrame:
    """One page per entity and Home: note, folder, page_id, body.

    `entities` has id, type, name, and maybe verification_status and data_origin; its further columns are listed as properties.
    `links` has source_id, relationship_type, target_id: each end's page links to the other."""
    title = file_name(entity_title("id", "name"))
    named = entities.withColumn("note", title)
    ends = [links.select(F.col(a).alias("id"), F.col(b).alias("other"), "relationship_type") for a, b in (("source_id", "target_id"), ("target_id", "source_id"))]
    both = ends[0].unionByName(ends[1]).join(named.select(F.col("id").alias("other"), F.col("note").alias("to")), "other")
    out = both.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("- [["), "to", F.lit("]] - *"), "relationship_type", F.lit("*")))), "\n").alias("links"))
    known = [c for c in ("id", "type", "verification_status", "data_origin") if c in entities.columns]
    head = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in known]
    facts = [F.concat(F.lit(f"- **{c}**: "), F.col(c).cast("string")) for c in entities.columns if c not in known]
    rows = named.join(out, "id", "left")
    body = F.concat(
        F.lit("---\n"), F.concat_ws("\n", *head), F.lit("\n---\n\n# "), "note", F.lit("\n\n"), F.concat_ws("\n", *facts), F.lit("\n\n"), F.coalesce("links", F.lit("")),
    )
    pages = rows.select("note", F.col("type").alias("folder"), F.col("id").alias("page_id"), body.alias("body"))
    home = named.groupBy("type").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- [["), "note", F.lit("]]")))), "\n").alias("l"))
    section = F.concat(F.lit("## "), "type", F.lit(" ("), F.col("n").cast("string"), F.lit(")\n"), "l")
    lists = home.agg(F.array_join(F.array_sort(F.collect_list(section)), "\n\n").alias("l"))
    front = lists.select(
        F.lit("Home").alias("note"), F.lit("").alias("folder"), F.lit("HOME").alias("page_id"), F.concat(F.lit("---\nid: HOME\ntype: Dashboard\n---\n\n# Home\n\n"), "l").alias("body")
    )
    return pages.unionByName(front)


def write_text(df: DataFrame, column: str, path: str, by: str | None = None) -> None:
    """One text file per part, or a folder for each value of `by`."""
    rows = df.select(column, *([by] if by else []))
    (rows.write.partitionBy(by) if by else rows.write).mode("overwrite").text(path)


def write_report(df: DataFrame, path: str) -> None:
    """Rows of a report as JSON lines."""
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def markdown_table(df: DataFrame, order: list[str]) -> DataFrame:
    """A report as the lines of a Markdown table, in order: value.  Reports are small by nature."""
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("—"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |"))
    spark, names = df.sparkSession, df.columns
    head = spark.createDataFrame([("| " + " | ".join(names) + " |",), ("|" + " --- |" * len(names),)], "value string")
    return head.unionByName(df.orderBy(*order).select(line.alias("value")))
