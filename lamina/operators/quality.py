"""Integrity checks that return findings as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.text import wikilinks, yaml_id


def null_counts(df: DataFrame, name: str) -> DataFrame:
    """(table_name, column_name, n_null) for every column, in one pass."""
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("n_null")) for c in df.columns])
    return one.select(F.lit(name).alias("table_name"), F.explode(pairs).alias("x")).select("table_name", "x.*")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def missing_references(df: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Values of a column that no parent has, with how often they occur."""
    ids = parents.select(F.col(key).alias("__k")).filter("__k IS NOT NULL").distinct()
    return df.filter(F.col(column).isNotNull()).join(ids, F.col(column) == F.col("__k"), "left_anti").groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"))


def finding(check: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n")).select(F.lit(check).alias("check_name"), "n")


def reject_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, null if none does."""
    out = F.when(rules[0][1], rules[0][0])
    for name, test in rules[1:]:
        out = out.when(test, name)
    return out


def validate_chunks(chunks: DataFrame, strategies: tuple[str, ...]) -> DataFrame:
    """Every chunk with `problem`: missing_field, bad_strategy, bad_page, page_order, or null; blank texts are skipped."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    rules = [
        ("skipped_blank", blank),
        ("missing_field", F.col("chunk_id").isNull() | F.col("source").isNull() | F.col("strategy").isNull()),
        ("bad_strategy", ~F.col("strategy").isin(*strategies)),
        ("missing_page", F.col("page_start").isNull() | F.col("page_end").isNull()),
        ("bad_page", F.col("page_start") < 1),
        ("page_order", F.col("page_start") > F.col("page_end")),
    ]
    return chunks.withColumn("problem", reject_reason(rules))


def validate_relations(edges: DataFrame, nodes: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Distinct relations with `reason` for rejecting them, null if valid: source, target, relationship_type, evidence."""
    ids = nodes.select("id").distinct()
    rows = edges.groupBy("source", "target", "relationship_type").agg(F.max("evidence").alias("evidence"), F.count("*").alias("n_rows"))
    rows = rows.join(ids.select(F.col("id").alias("__s"), F.lit(True).alias("has_source")), F.col("source") == F.col("__s"), "left")
    rows = rows.join(ids.select(F.col("id").alias("__t"), F.lit(True).alias("has_target")), F.col("target") == F.col("__t"), "left")
    rules = [
        ("unknown_source", F.col("has_source").isNull()),
        ("type_not_allowed", ~F.coalesce(F.col("relationship_type").isin(*allowed), F.lit(False))),
        ("unknown_target", F.col("has_target").isNull()),
        ("self_loop", F.col("source") == F.col("target")),
        ("no_evidence", F.trim(F.coalesce("evidence", F.lit(""))) == ""),
    ]
    return rows.select("source", "target", "relationship_type", "n_rows", reject_reason(rules).alias("reason"))


def validate_wiki(pages: DataFrame, nodes: DataFrame, relations: DataFrame, kinds: tuple[str, str, str] = ("RuiRo", "MITIGATES", "OBSERVED_AS")) -> DataFrame:
    """Nine checks of a wiki against its entities and relations: (check_name, n).

    `pages` has note and body (with a YAML id), `nodes` id and type, `relations` source_id, relationship_type, target_id.
    Counted are files, links, links to no page, ids that occur repeatedly, pages (Home aside) with an id that no entity has,
    relations without a known source, without a known target, entities of the first kind that no relation of the second
    goes to, that none of the third comes from, and pages without any link in or out, with and without those of Home."""
    kind, into, outof = kinds
    notes = pages.select(F.col("note").alias("dst")).distinct()
    found = pages.select("note", "body", yaml_id("body").alias("page_id"))
    links = found.select(F.col("note").alias("src"), F.explode(wikilinks("body")).alias("dst"))
    ids = nodes.select("id").distinct()
    named = found.filter("page_id IS NOT NULL AND page_id <> 'HOME'")
    missing = lambda c: relations.join(ids, F.col(c) == F.col("id"), "left_anti")
    ours = nodes.filter(F.col("type") == kind).select("id").distinct()
    touched = lambda name, c: ours.join(relations.filter(F.col("relationship_type") == name).select(F.col(c).alias("id")), "id", "left_anti")
    lonely = lambda some: notes.filter("dst <> 'Home'").join(some.select("dst"), "dst", "left_anti").join(some.select(F.col("src").alias("dst")), "dst", "left_anti")
    parts = [
        ("files", pages), ("links", links), ("broken_links", links.join(notes, "dst", "left_anti")), ("duplicate_ids", nodes.groupBy("id").count().filter("count > 1")),
        ("unknown_ids", named.join(ids.withColumnRenamed("id", "page_id"), "page_id", "left_anti")), ("unknown_sources", missing("source_id")), ("unknown_targets", missing("target_id")),
        ("without_" + into, touched(into, "target_id")), ("without_" + outof, touched(outof, "source_id")),
        ("orphans", lonely(links)), ("orphans_without_home", lonely(links.filter("src <> 'Home' AND dst <> 'Home'"))),
    ]
    out = finding(*parts[0])
    for part in parts[1:]:
        out = out.unionByName(finding(*part))
    return out
