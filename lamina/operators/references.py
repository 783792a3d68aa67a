"""References to records that do not exist (problem 6).

References and parent keys are co-partitioned on (parent kind, key, salt) and sorted;
one linear merge of the two sorted streams (Spark's sort-merge join, which the plan
asks for by hint) finds each reference's parent.  Before the merge the parents are
reduced to one row per key that holds its validity intervals, so the merge is
many-to-one and no group is ever held in memory.  References are counted per key first; a key with more than
HOT_ROWS is split over as many tasks as it has HOT_ROWS, and only its parent is copied for them.  Of such keys there are no more
than rows / HOT_ROWS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 200_000

# Relationship types whose target is an entity, with its entity_type.
ENTITY_TARGETS = {"BAN_HANH_BOI": "CoQuan", "KY_BOI": "NguoiKy", "AP_DUNG_CHO": "DoiTuongApDung", "THUOC_LINH_VUC": "LinhVuc"}
DOCUMENT_TARGETS = ("THAM_CHIEU", "SUA_DOI_BO_SUNG", "THAY_THE_BOI")


def parent_intervals(parents: DataFrame) -> DataFrame:
    """One row per (kind, key): when a live record first existed, and whether any record ever did.

    `parents` has kind, key, valid_from, deleted_at, timed.  A record that is marked deleted is
    never live.  A record of an untimed kind is live from the beginning of time."""
    live = F.col("deleted_at").isNull()
    return parents.filter(F.col("key").isNotNull()).groupBy("kind", "key").agg(
        F.min(F.when(live & F.col("timed"), F.col("valid_from"))).alias("live_from"),
        F.max(live & ~F.col("timed")).alias("always"),
        F.max(live).alias("ever_live"),
    )


def resolve_references(refs: DataFrame, parents: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds `status` to every reference: found, missing, deleted or late.

    `refs` has table_name, ref_field, row_id, kind, key, at.  A null or empty key is no reference
    and is left out.  found: a live record existed at `at` (untimed kinds: exists).  late: a live
    record exists but only later, or one of the two times is null.  deleted: only deleted records.
    missing: no record.  Repeated rows stay repeated; extra columns pass through; a column `status` gives way."""
    if hot_rows < 1:
        raise ValueError("hot_rows must be positive")
    asked = refs.filter(F.col("key").isNotNull() & (F.col("key") != ""))
    hot = asked.groupBy(F.col("kind").alias("__hot_kind"), F.col("key").alias("__hot_key")).agg(F.count("*").alias("__n")).filter(F.col("__n") > hot_rows)
    hot = hot.select("__hot_kind", "__hot_key", F.ceil(F.col("__n") / hot_rows).cast("int").alias("__parts"))
    same = lambda kind, key: (F.col(kind) == F.col("__hot_kind")) & (F.col(key) == F.col("__hot_key"))
    known = parent_intervals(parents).select(
        F.col("kind").alias("__kind"), F.col("key").alias("__key"), F.col("live_from").alias("__live_from"), F.col("always").alias("__always"), F.col("ever_live").alias("__ever_live"),
    )
    known = known.join(hot, same("__kind", "__key"), "left").withColumn("__psalt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__hot_kind", "__hot_key", "__parts")
    asked = asked.join(hot, same("kind", "key"), "left").withColumn("__salt", F.pmod(F.xxhash64("row_id"), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__hot_kind", "__hot_key", "__parts")
    joined = asked.join(
        known.hint("merge"),
        (F.col("kind") == F.col("__kind")) & (F.col("key") == F.col("__key")) & (F.col("__salt") == F.col("__psalt")),
        "left",
    )
    status = (
        F.when(F.col("__ever_live").isNull(), "missing")
        .when(~F.col("__ever_live"), "deleted")
        .when(F.coalesce(F.col("__always"), F.lit(False)) | F.coalesce(F.col("__live_from") <= F.col("at"), F.lit(False)), "found")
        .otherwise("late")
    )
    return joined.withColumn("status", status).drop("__kind", "__key", "__salt", "__psalt", "__live_from", "__always", "__ever_live")


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References without a record, one row per (table_name, ref_field, row_id, status)."""
    return resolve_references(refs, parents).filter(F.col("status") != "found").dropDuplicates(["table_name", "ref_field", "row_id", "status"])


def orphan_report(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct references per table, field, month of loaded_at and status, found ones included."""
    rows = resolve_references(refs, parents).dropDuplicates(["table_name", "ref_field", "row_id", "status", "at"])
    return rows.groupBy("table_name", "ref_field", F.date_format("at", "yyyy-MM").alias("month"), "status").agg(F.count("*").alias("n"))


def law_references(relationships: DataFrame, doc_relations: DataFrame) -> DataFrame:
    """The references of the two link tables in one form; each table is scanned once."""
    kind = F.when(F.col("relationship_type").isin(*DOCUMENT_TARGETS), F.lit("law_number"))
    for relation, entity in ENTITY_TARGETS.items():
        kind = kind.when(F.col("relationship_type") == relation, F.lit(f"entity:{entity}"))
    sides = F.explode(
        F.array(
            F.struct(F.lit("source").alias("ref_field"), F.lit("law_number").alias("kind"), F.col("source").alias("key")),
            F.struct(F.lit("target").alias("ref_field"), kind.alias("kind"), F.col("target").alias("key")),
        )
    )
    links = relationships.select(F.lit("relationships").alias("table_name"), F.col("rel_id").alias("row_id"), F.col("loaded_at").alias("at"), sides.alias("s"))
    links = links.select("table_name", "s.ref_field", "row_id", "s.kind", "s.key", "at").filter("kind IS NOT NULL")
    others = doc_relations.select(
        F.lit("doc_relations").alias("table_name"), F.lit("other_doc_id").alias("ref_field"), F.col("link_id").alias("row_id"),
        F.lit("law_id").alias("kind"), F.col("other_doc_id").alias("key"), F.col("loaded_at").alias("at"),
    )
    return links.unionByName(others)


def law_parents(law_metadata: DataFrame, entities: DataFrame) -> DataFrame:
    """Document keys (both of them) with their times, and entity names, in one form."""
    keys = F.explode(
        F.array(
            F.struct(F.lit("law_id").alias("kind"), F.col("id").alias("key")),
            F.struct(F.lit("law_number").alias("kind"), F.col("so_ky_hieu").alias("key")),
        )
    )
    laws = law_metadata.select(keys.alias("k"), F.col("loaded_at").alias("valid_from"), "deleted_at").select(
        "k.kind", "k.key", "valid_from", "deleted_at", F.lit(True).alias("timed")
    )
    names = entities.filter(F.col("entity_type").isin(*ENTITY_TARGETS.values())).select(
        F.concat(F.lit("entity:"), F.col("entity_type")).alias("kind"), F.col("canonical_name").alias("key"),
        F.lit(None).cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(False).alias("timed"),
    )
    return laws.unionByName(names)
