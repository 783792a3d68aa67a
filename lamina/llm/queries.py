"""Queries of the training-data problems, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm import confusables, encoding, mixing, packing, residue, scans, split, tokens, variants
from lamina.session import cut_lineage
from lamina.sources import spread, table


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk as its ordered pieces."""
    rows = split.split_chunks(table(spark, d, "chunks"), table(spark, d, "chunk_limits"))
    return rows.select("chunk_id", "strategy", "piece_no", "n_pieces", "char_start", "char_end", "piece_page_start", "piece_page_end", "piece").filter("n_pieces > 1").distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that the splitter cut."""
    rows = split.split_chunks(table(spark, d, "chunks").select("chunk_id", "strategy", "text", "page_start", "page_end"), table(spark, d, "chunk_limits"))
    return rows.filter("n_pieces > 1 AND piece_no = 1").select("chunk_id").distinct()


def p1_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Every divided chunk put together again from its pieces, and whether they keep limit, overlap and order."""
    limits = table(spark, d, "chunk_limits").select("strategy", "max_chars", "overlap_chars")
    own = F.col("char_end") - F.lag("char_end", 1, 0).over(Window.partitionBy("chunk_id").orderBy("piece_no"))
    rows = p1_pieces(spark, d).join(limits, "strategy").withColumn("own", own)
    shared = (F.col("piece_no") == 1) | (F.col("own") + F.col("overlap_chars") == F.length("piece"))
    fair = (F.length("piece") <= F.col("max_chars")) & shared & (F.col("piece_page_start") <= F.col("piece_page_end")).isNotNull().eqNullSafe(F.col("piece_page_start").isNotNull())
    parts = F.array_sort(F.collect_list(F.struct("piece_no", F.expr("right(piece, own)").alias("t"))))
    out = rows.groupBy("chunk_id").agg(parts.alias("p"), F.min(fair).alias("fair"), (F.max("piece_no") == F.max("n_pieces")).alias("complete"))
    return out.select("chunk_id", F.md5(F.array_join(F.transform("p", lambda x: x["t"]), "")).alias("digest"), "fair", "complete")


def _names(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "entities")
    columns = [(entities, "original_name"), (entities, "canonical_name"), (table(spark, d, "extracted_entities_raw"), "entity")]
    parts = [df.filter(F.col("entity_type").isin("CoQuan", "NguoiKy")).select(F.col(c).alias("name"), F.col("entity_type").alias("kind")) for df, c in columns]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p2_names(spark: SparkSession, d: str) -> DataFrame:
    """Every string with the name it stands for."""
    return variants.link_variants(_names(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.variant_pairs(p2_names(spark, d))


def _keyed(spark: SparkSession, d: str, name: str, key: str, column: str) -> DataFrame:
    return spread(table(spark, d, name).select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.col(column).alias("text")))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Garbled rows with the restored text and what was found."""
    rows = _keyed(spark, d, "chunks", "chunk_id", "text").unionByName(_keyed(spark, d, "documents", "doc_id", "text"))
    fixed = encoding.repair_encoding(rows)
    return fixed.filter("text_garbled").select("table_name", "row_key", "text_kinds", "text_restored").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_repaired(spark, d).select("table_name", "row_key").distinct()


def _forms(spark: SparkSession, d: str) -> DataFrame:
    """Rows that pass the gate, which are looked for once and stored, with their consistent forms."""
    parts = [("chunks", "chunk_id", "text"), ("documents", "doc_id", "text"), ("entities", "entity_id", "canonical_name")]
    sources = [_keyed(spark, d, *p) for p in parts]
    gated = cut_lineage(confusables.gated(sources[0].unionByName(sources[1]).unionByName(sources[2]), "text"))
    rules = confusables.learn_rules([(df, "text") for df in sources], [(gated, "text")])
    names = F.col("table_name") == "entities"
    return confusables.unify(gated.filter(~names), "text", rules).unionByName(confusables.unify(gated.filter(names), "text", rules, garbled_too=False))


def p3_unified(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose text held look-alikes, with the consistent form."""
    return _forms(spark, d).filter("text_disguised").select("table_name", "row_key", "text_form").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _forms(spark, d).filter("text_disguised").select("table_name", "row_key").distinct()


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    pages = spread(table(spark, d, "raw_pages").select("page_id", "source", "page", "ocr_used", "text"))
    return scans.repair_scans(pages, scans.fit(pages))


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Noisy pages with their content as continuous paragraphs, and what was mended."""
    return _repaired(spark, d).filter("noisy").select("page_id", "joins", "words", "furniture", "repaired").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).filter("noisy").select("page_id").distinct()


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """Token counts, made once: what follows reads the three small columns several times."""
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    return cut_lineage(docs.select("doc_id", "source", tokens.count_tokens("text").alias("n_tokens")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document's container for every profile."""
    return packing.pack_items(_sized(spark, d).select("doc_id", "n_tokens"), table(spark, d, "pack_profiles"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, d))


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per profile: documents packed, whether no container is overfull, every document is there whole and once, and none is divided
    but those above the capacity."""
    counted = _sized(spark, d)
    packed = cut_lineage(packing.pack_items(counted.select("doc_id", "n_tokens"), table(spark, d, "pack_profiles")))
    loads = packed.groupBy("profile", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("load"))
    loads = loads.groupBy("profile", "capacity_tokens").agg((F.max("load") <= F.first("capacity_tokens")).alias("within_capacity"))
    sizes = counted.select("doc_id", F.col("n_tokens").alias("size"))
    whole = packed.groupBy("profile", "capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts")).join(sizes, "doc_id", "full_outer")
    right = (F.col("n") == F.col("size")) & ((F.col("parts") == 1) | (F.col("size") > F.col("capacity_tokens")))
    kept = whole.groupBy("profile", "capacity_tokens").agg(F.count("*").alias("documents"), F.min(F.coalesce(right, F.lit(False))).alias("whole"))
    return kept.join(loads, ["profile", "capacity_tokens"])


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    """The mixed selection: documents with their number of copies."""
    return mixing.mix_sources(_sized(spark, d), table(spark, d, "mix_targets"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(p8_selection(spark, d), table(spark, d, "mix_targets"))


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per source of the targets: whether its share is reached and no document is used too often."""
    rows = p8_report(spark, d)
    return rows.select("source", "target_share", "max_repeats", (F.abs(F.col("share") - F.col("target_share")) <= 0.01).alias("reached"), (F.col("max_copies") <= F.col("max_repeats")).alias("within_repeats"))


def p8_stretched(spark: SparkSession, d: str) -> DataFrame:
    """A budget half as large again as the targets allow: the exponent falls below 1, and no more, by bisection at the repetition limits."""
    items, goal = _sized(spark, d), table(spark, d, "mix_targets")
    size = mixing.temperature_report(items, goal).agg(F.max("budget")).first()[0] or 0.0
    rows = mixing.temperature_report(items, goal, 1.5 * size)
    return rows.select("source", "max_repeats", ((F.col("exponent") > 0) & (F.col("exponent") < 1)).alias("bent"), (F.col("passes") <= F.col("max_repeats") + 1e-6).alias("within_repeats"), (F.max("passes").over(Window.partitionBy(F.lit(1))) >= 0.999).alias("used"))


def p8_flattened(spark: SparkSession, d: str) -> DataFrame:
    """Plain temperature mixing to the entropy of the target shares: small sources rise, large ones fall, their order stays."""
    goal = table(spark, d, "mix_targets")
    aim = mixing.entropy({r["source"]: r["target_share"] for r in goal.select("source", "target_share").collect()})  # a row for each source
    rows = mixing.temperature_report(_sized(spark, d), goal, spread=aim)
    one = Window.partitionBy(F.lit(1))
    reached = F.abs(-F.sum(F.col("weight") * F.log("weight")).over(one) - aim) < 1e-6
    order = F.rank().over(one.orderBy("natural")) == F.rank().over(one.orderBy("weight"))
    return rows.select("source", reached.alias("reached"), order.alias("order_kept"), (F.col("passes") <= F.col("max_repeats") + 1e-6).alias("within_repeats"))


def p9_judged(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold residue, and by what they were found."""
    return residue.judge_documents(spread(table(spark, d, "documents").select("doc_id", "text")))


def p9_templates(spark: SparkSession, d: str) -> DataFrame:
    """Mined templates that are no prose, with their number of lines."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    model = residue.fit(docs, "doc_id", "text")
    mined = residue.mine_templates(residue.lines_of(residue.look_at(docs, "doc_id", "text", model)), model)
    return mined.filter("verdict <> 'prose'").select("template", "n_lines", "verdict")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_judged(spark, d).select("doc_id").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p1_rejoined": p1_rejoined,
    "p2_found": p2_found,
    "p2_names": p2_names,
    "p3_found": p3_found,
    "p3_unified": p3_unified,
    "p4_found": p4_found,
    "p4_repaired": p4_repaired,
    "p5_found": p5_found,
    "p5_repaired": p5_repaired,
    "p7_containers": p7_containers,
    "p7_report": p7_report,
    "p7_kept": p7_kept,
    "p8_selection": p8_selection,
    "p8_report": p8_report,
    "p8_kept": p8_kept,
    "p8_stretched": p8_stretched,
    "p8_flattened": p8_flattened,
    "p9_found": p9_found,
    "p9_judged": p9_judged,
    "p9_templates": p9_templates,
}

SQL = {
    "p1_rejoined": "SELECT DISTINCT c.chunk_id, md5(c.text) AS digest, TRUE AS fair, TRUE AS complete FROM chunks c JOIN chunk_limits l ON c.strategy = l.strategy WHERE length(c.text) > l.max_chars",
    "p7_kept": "SELECT profile, capacity_tokens::BIGINT AS capacity_tokens, (SELECT count(*) FROM documents) AS documents, TRUE AS whole, TRUE AS within_capacity FROM pack_profiles",
    "p8_kept": "SELECT source, target_share, max_repeats, TRUE AS reached, TRUE AS within_repeats FROM mix_targets",
    "p8_stretched": "SELECT source, max_repeats, TRUE AS bent, TRUE AS within_repeats, TRUE AS used FROM mix_targets WHERE source IN (SELECT source FROM documents WHERE text <> '')",
    "p8_flattened": "SELECT source, TRUE AS reached, TRUE AS order_kept, TRUE AS within_repeats FROM mix_targets WHERE source IN (SELECT source FROM documents WHERE text <> '')",
    "p1_found": "SELECT DISTINCT c.chunk_id FROM chunks c JOIN chunk_limits l ON c.strategy = l.strategy WHERE length(c.text) > l.max_chars",
}
