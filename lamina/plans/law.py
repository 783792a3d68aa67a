"""Queries over the law graph, its quality, roles and sets; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina import api
from lamina.functions.text import composed
from lamina.operators import chunking, dense, graph, quality, security
from lamina.operators.references import ENTITY_TARGETS
from lamina.plans.retrieval import _Q, children, documents_index, questions, scores_sql, vectors
from lamina.plans.sql import SQUEEZED
from lamina.session import among, cut_lineage
from lamina.sources import files, table

ALLOWED = ("THAM_CHIEU", "SUA_DOI_BO_SUNG", "THAY_THE_BOI", *ENTITY_TARGETS)


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_relations").select(F.col("doc_id").alias("src"), F.col("other_doc_id").alias("dst"), F.coalesce("relationship_type", F.lit("")).alias("kind")).distinct()


def _laws(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "law_metadata")


def node_merge(spark: SparkSession, d: str) -> DataFrame:
    """Laws merged into a store of even-numbered ones; given properties win, others stay."""
    laws = _laws(spark, d).filter("id IS NOT NULL").groupBy("id").agg(F.min("title").alias("title"), F.max("so_ky_hieu").alias("number"), F.max("tinh_trang_hieu_luc").alias("status"))
    stored = laws.filter(F.pmod(F.length("title"), F.lit(2)) == 0).select("id", F.upper("title").alias("title"), F.lit("old").alias("status"))
    incoming = laws.select("id", "number", F.when(F.col("status") != "", F.col("status")).alias("status"))
    return graph.merge_nodes(stored, incoming, "id")


def edge_merge(spark: SparkSession, d: str) -> DataFrame:
    """Distinct edges by what became of them."""
    merged = graph.merge_edges(_links(spark, d).filter("dst IS NOT NULL AND dst <> ''"), _laws(spark, d).select("id"), "src", "dst", "kind")
    return merged.groupBy("kind", "status").agg(F.count("*").alias("n"))


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by label and relations by type."""
    nodes = graph.label_counts(table(spark, d, "entities").select(F.concat(F.lit("node:"), F.coalesce("entity_type", F.lit(""))).alias("label")), "label")
    return nodes.unionByName(graph.label_counts(table(spark, d, "relationships").select(F.concat(F.lit("edge:"), F.coalesce("relationship_type", F.lit(""))).alias("label")), "label"))


def optional_links(spark: SparkSession, d: str) -> DataFrame:
    """Every law with the number of its outgoing links and of those that end at a law."""
    laws = _laws(spark, d).filter("id IS NOT NULL").select("id").distinct()
    links = _links(spark, d)
    rows = laws.join(links, F.col("id") == F.col("src"), "left").join(laws.select(F.col("id").alias("t")), F.col("dst") == F.col("t"), "left")
    return rows.groupBy("id").agg(F.count("src").alias("n_links"), F.count("t").alias("n_resolved"))


def unlinked_laws(spark: SparkSession, d: str) -> DataFrame:
    """Laws that no link comes from, or none goes to."""
    laws = _laws(spark, d).filter("id IS NOT NULL").select("id").distinct()
    links = _links(spark, d)
    a = laws.join(links.select(F.col("src").alias("id")), "id", "left_anti").withColumn("kind", F.lit("no_outgoing"))
    return a.unionByName(laws.join(links.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("kind", F.lit("no_incoming")))


def two_step_paths(spark: SparkSession, d: str) -> DataFrame:
    """Laws amended by one that itself has a legal basis, counted by start."""
    links = _links(spark, d)
    paths = graph.chain(links.filter("kind = 'SUA_DOI_BO_SUNG'"), links.filter("kind = 'CAN_CU'"))
    return paths.groupBy("x").agg(F.count("*").alias("n"))


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return _laws(spark, d).filter(F.col("id").rlike("^[0-9]+00$")).select(F.col("id").alias("seed")).distinct()


def hops_undirected(spark: SparkSession, d: str) -> DataFrame:
    """Laws within two hops of those whose id is divisible by 100, over amending and guiding links."""
    links = _links(spark, d).filter(F.col("kind").isin("SUA_DOI_BO_SUNG", "HUONG_DAN", "THAY_THE"))
    return graph.reach(_seeds(spark, d), links, 2)


def hops_directed(spark: SparkSession, d: str) -> DataFrame:
    """Reference chains of one to three steps."""
    return graph.reach(_seeds(spark, d), _links(spark, d).filter("kind = 'CAN_CU'"), 3, directed=True)


def touching_links(spark: SparkSession, d: str) -> DataFrame:
    """Links at either end of a seed."""
    return graph.touching(_links(spark, d), _seeds(spark, d).select(F.col("seed").alias("id")), "src", "dst")


def first_per_law(spark: SparkSession, d: str) -> DataFrame:
    """The first two documents about each law, by id as text."""
    docs = table(spark, d, "documents").filter("so_ky_hieu IS NOT NULL").select("so_ky_hieu", F.col("doc_id").cast("string").alias("id"))
    return graph.first_of_group(docs, "so_ky_hieu", [F.asc("id")], 2)


def allowed_links(spark: SparkSession, d: str) -> DataFrame:
    """Links at either end of a seed, of five kinds, that staff may see at both ends."""
    ids = _laws(spark, d).filter("id IS NOT NULL AND so_ky_hieu IS NOT NULL").select("id", "so_ky_hieu").distinct()
    seen = security.group_roles(_tagged(spark, d).filter("so_ky_hieu IS NOT NULL"), "so_ky_hieu").join(ids, "so_ky_hieu").withColumn("roles", F.split("roles", ","))
    links = _links(spark, d).filter(F.col("kind").isin("SUA_DOI_BO_SUNG", "CAN_CU", "THAY_THE", "VAN_BAN_BO_SUNG", "HOP_NHAT"))
    rows = graph.touching(links, _seeds(spark, d).select(F.col("seed").alias("id")), "src", "dst")
    return graph.allowed_edges(rows, seen, "src", "dst", ["Staff", "Guest"])


def next_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunk after each hierarchical chunk whose number is divisible by 10, staff allowed to see both."""
    rows = children(spark, d)
    edges = chunking.next_edges(rows, "source", "number", "chunk_id")
    tagged = rows.select(F.col("chunk_id").alias("id"), security.allowed_roles(F.lit(""), "text").alias("roles"))
    hits = rows.filter("number % 10 = 0").select(F.lit(1).alias("query_id"), F.col("chunk_id").alias("id"))
    return graph.next_hop(hits, graph.allowed_edges(edges, tagged, "src", "dst", ["Staff"])).select("id", "next_id")


def search_context(spark: SparkSession, d: str) -> DataFrame:
    """For 0, 1 and 2 hops, the nearest three documents of each question, and two of each law within the hops of
    theirs, seeds left out."""
    docs = table(spark, d, "documents").filter("so_ky_hieu IS NOT NULL").select(F.col("doc_id").alias("id"), "so_ky_hieu")
    ids = _laws(spark, d).filter("id IS NOT NULL AND so_ky_hieu IS NOT NULL").select(F.col("id").alias("law"), "so_ky_hieu").distinct()
    near = dense.dense_top_k(table(spark, d, "embeddings"), vectors(spark, d), 3)
    direct = cut_lineage(near.join(docs, "id").select("query_id", "id", "so_ky_hieu"))
    seeds = direct.join(ids, "so_ky_hieu").select("query_id", "law").distinct()
    found = graph.reach(seeds.select(F.col("law").alias("seed")).distinct(), _links(spark, d), 2)
    reached = seeds.join(found, F.col("law") == F.col("seed")).groupBy("query_id", "node").agg(F.min("depth").alias("depth"))
    reached = cut_lineage(reached.join(seeds.select("query_id", F.col("law").alias("node")), ["query_id", "node"], "left_anti"))
    out = None
    for hops in (0, 1, 2):
        one = direct.withColumn("hops", F.lit(0))
        if hops:
            related = reached.filter(F.col("depth") <= hops).join(ids.withColumnRenamed("law", "node"), "node").join(docs, "so_ky_hieu").groupBy("query_id", "id", "so_ky_hieu").agg(F.min("depth").alias("hops"))
            text = related.withColumn("g", F.concat_ws("#", F.col("query_id").cast("string"), "so_ky_hieu")).withColumn("t", F.col("id").cast("string"))
            one = one.unionByName(graph.first_of_group(text, "g", [F.asc("t")], 2).select("query_id", "id", "so_ky_hieu", "hops"))
        one = one.withColumn("setting", F.lit(hops))
        out = one if out is None else out.unionByName(one)
    return out


#: A relation's verification status, which the tables lack: what a rule found counts as verified, what a model found as proposed.
VERIFICATION = "CASE method WHEN 'rule' THEN 'VERIFIED' WHEN 'llm' THEN CASE WHEN confidence IS NULL THEN NULL ELSE 'PROPOSED' END END"


def _stated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "relationships").withColumn("verification_status", F.expr(VERIFICATION))


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Proposed relations between known laws, by confidence."""
    numbers = _laws(spark, d).select(F.col("so_ky_hieu").alias("k")).filter("k IS NOT NULL").distinct()
    rows = _stated(spark, d).filter("verification_status = 'PROPOSED'").select("rel_id", "source", "target", "confidence").distinct()
    rows = rows.join(numbers, F.col("source") == F.col("k"), "left_semi").join(numbers, F.col("target") == F.col("k"), "left_semi")
    return rows.orderBy(F.desc("confidence"), "rel_id")


def unverified_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations that are not verified; one without any status is not told."""
    rows = _stated(spark, d).filter("verification_status <> 'VERIFIED'")
    return rows.groupBy("relationship_type", "verification_status").agg(F.count("*").alias("n"))


def clause_reasoning(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest texts of each question whose law is in force, with the laws theirs refers to and the issuers of
    those, by verified relations or such without status; the twenty best by score."""
    near = dense.dense_top_k(table(spark, d, "embeddings"), vectors(spark, d), 10).select("query_id", "id", (1 - F.col("distance")).alias("score"))
    docs = table(spark, d, "documents").filter("so_ky_hieu IS NOT NULL").select(F.col("doc_id").alias("id"), "so_ky_hieu")
    laws = _laws(spark, d).filter("so_ky_hieu IS NOT NULL").groupBy("so_ky_hieu").agg(F.max("tinh_trang_hieu_luc").alias("status"))
    rows = near.join(docs, "id").join(laws.filter("status <> 'Hết hiệu lực toàn bộ'"), "so_ky_hieu")
    sure = _stated(spark, d).filter("coalesce(verification_status, 'VERIFIED') = 'VERIFIED'")
    edge = lambda kind, a, b: sure.filter(F.col("relationship_type") == kind).select(F.col("source").alias(a), F.col("target").alias(b)).distinct()
    rows = rows.join(edge("THAM_CHIEU", "so_ky_hieu", "law"), "so_ky_hieu", "left").join(edge("BAN_HANH_BOI", "law", "issuer"), "law", "left")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|").alias(c + "s")
    out = rows.groupBy("query_id", "id", "so_ky_hieu", "score").agg(listed("law"), listed("issuer")).withColumn("score", F.round("score", 6))
    return graph.first_of_group(out, "query_id", [F.desc("score"), F.asc("id")], 20)


def law_reasoning(spark: SparkSession, d: str) -> DataFrame:
    """Laws with their distinct issuers and signers by optional joins."""
    laws = _laws(spark, d).filter("so_ky_hieu IS NOT NULL").select("so_ky_hieu").distinct()
    rel = table(spark, d, "relationships")
    part = lambda kind, name: rel.filter(F.col("relationship_type") == kind).groupBy(F.col("source").alias("so_ky_hieu")).agg(F.array_join(F.array_sort(F.collect_set("target")), "|").alias(name))
    return laws.join(part("BAN_HANH_BOI", "issuers"), "so_ky_hieu", "left").join(part("KY_BOI", "signers"), "so_ky_hieu", "left")


def null_counts(spark: SparkSession, d: str) -> DataFrame:
    """A14 over three tables."""
    out = quality.null_counts(_laws(spark, d), "law_metadata")
    for name in ("relationships", "entities"):
        out = out.unionByName(quality.null_counts(table(spark, d, name), name))
    return out


def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of laws and entities that occur more than once."""
    a = quality.duplicate_keys(_laws(spark, d), ["id"]).select(F.lit("law_metadata").alias("table_name"), F.col("id").alias("key"), "n")
    b = quality.duplicate_keys(table(spark, d, "entities"), ["entity_id"]).select(F.lit("entities").alias("table_name"), F.col("entity_id").alias("key"), "n")
    return a.unionByName(b)


def missing_references(spark: SparkSession, d: str) -> DataFrame:
    """Referenced document ids that no law has."""
    return quality.missing_references(table(spark, d, "doc_relations").filter("other_doc_id <> ''"), "other_doc_id", _laws(spark, d), "id")


def integrity_report(spark: SparkSession, d: str) -> DataFrame:
    """Findings over the tables as (check_name, n)."""
    laws, ents, rels = _laws(spark, d), table(spark, d, "entities"), table(spark, d, "doc_relations")
    parts = [
        ("rows:law_metadata", laws), ("rows:entities", ents), ("null:law id", laws.filter("id IS NULL")), ("duplicate:law id", quality.duplicate_keys(laws, ["id"])),
        ("duplicate:entity id", quality.duplicate_keys(ents, ["entity_id"])), ("missing:source_doc_id", ents.join(laws.select(F.col("id").alias("source_doc_id")), "source_doc_id", "left_anti")),
        ("missing:doc_id", rels.join(laws.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")), ("self link", rels.filter("doc_id = other_doc_id")),
    ]
    out = quality.finding(*parts[0])
    for p in parts[1:]:
        out = out.unionByName(quality.finding(*p))
    return out


def relation_validation(spark: SparkSession, d: str) -> DataFrame:
    """Relations by reason for rejecting them."""
    nodes = _laws(spark, d).select(F.col("so_ky_hieu").alias("id")).unionByName(table(spark, d, "entities").select(F.col("canonical_name").alias("id"))).filter("id IS NOT NULL")
    rows = quality.validate_relations(table(spark, d, "relationships"), nodes, ALLOWED)
    return rows.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"), F.sum("n_rows").alias("n_rows"))


def content_audit(spark: SparkSession, d: str) -> DataFrame:
    """Laws with and without documents about them, and documents about no known law."""
    a = _laws(spark, d).filter("so_ky_hieu IS NOT NULL").select("so_ky_hieu", F.lit(True).alias("law")).distinct()
    b = table(spark, d, "documents").filter("so_ky_hieu IS NOT NULL").select("so_ky_hieu", F.lit(True).alias("doc")).distinct()
    kind = F.when(F.col("law").isNull(), "document_only").when(F.col("doc").isNull(), "law_only").otherwise("both")
    return a.join(b, "so_ky_hieu", "full_outer").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def issuers(spark: SparkSession, d: str) -> DataFrame:
    """Distinct issuers by field, in order."""
    return _laws(spark, d).groupBy(F.coalesce("nganh", F.lit("")).alias("nganh")).agg(F.array_join(F.array_sort(F.collect_set("co_quan_ban_hanh")), "|").alias("issuers"))


def id_sets(spark: SparkSession, d: str) -> DataFrame:
    """Union, difference and intersection of the laws that documents and relations name."""
    a = table(spark, d, "documents").select("so_ky_hieu").filter("so_ky_hieu IS NOT NULL")
    b = table(spark, d, "relationships").select(F.col("source").alias("so_ky_hieu")).filter("so_ky_hieu IS NOT NULL")
    parts = [("union", a.union(b).distinct()), ("difference", a.subtract(b)), ("intersection", a.intersect(b))]
    out = None
    for name, df in parts:
        one = df.select(F.lit(name).alias("kind"), "so_ky_hieu")
        out = one if out is None else out.unionByName(one)
    return out


def entity_union(spark: SparkSession, d: str) -> DataFrame:
    """Entities of different shapes in one table."""
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"))
    return a.unionByName(b, allowMissingColumns=True)


def first_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The first mention of each entity, by time and id."""
    rows = table(spark, d, "extracted_entities_raw").filter("entity IS NOT NULL")
    return graph.first_of_group(rows, "entity", [F.asc_nulls_last("extracted_at"), F.asc("mention_id"), F.asc("doc_id")], 1).select("entity", "mention_id", "doc_id")


def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that a store of the semantic ones does not hold yet, the first writer by page winning whole."""
    chunks = table(spark, d, "chunks").select("chunk_id", "strategy", "text", "page_start", "source")
    stored = chunks.filter("strategy = 'semantic'").select("chunk_id")
    incoming = chunks.filter("text IS NOT NULL AND chunk_id IS NOT NULL").select("chunk_id", "text", "page_start", "source")
    return files.insert_ignore(stored, incoming, "chunk_id", ("text",), "page_start").select("chunk_id", "page_start", F.md5("text").alias("digest"))


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Titles of every hundredth document, the order of the ids kept."""
    docs = table(spark, d, "documents").select("doc_id", "title")
    wanted = docs.filter("doc_id % 100 = 0").select("doc_id", (F.col("doc_id") / 100).cast("int").alias("rank"))
    return files.lookup(docs, wanted, "doc_id")


# Words that announce a relation to another document, longest first.
TRIGGERS = ("Sửa đổi, bổ sung", "Nghị định số", "Thông tư số", "Luật số", "thay thế", "bãi bỏ", "Căn cứ", "Circular", "Số:", "xem")
_NUMBER = r"\d+/\d{4}/[\p{Lu}]+-[\p{Lu}]+"
_CANDIDATE = r"(?:" + "|".join(TRIGGERS) + r")[^\n.;]{0,80}?" + _NUMBER


def rule_candidates(spark: SparkSession, d: str) -> DataFrame:
    """2.12: document numbers near trigger words in documents, with trigger and evidence; self references and repeated ones left out."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "so_ky_hieu", composed("text").alias("text"))
    rows = docs.select(F.col("doc_id").alias("source_id"), F.col("so_ky_hieu").alias("source_so_ky_hieu"), F.explode(F.regexp_extract_all("text", F.lit(_CANDIDATE), F.lit(0))).alias("evidence"))
    rows = rows.withColumn("target_so_ky_hieu", F.regexp_extract("evidence", _NUMBER + "$", 0)).withColumn("trigger", F.regexp_extract("evidence", "^(" + "|".join(TRIGGERS) + ")", 1))
    rows = rows.filter("target_so_ky_hieu <> '' AND (source_so_ky_hieu IS NULL OR target_so_ky_hieu <> source_so_ky_hieu)")
    return rows.groupBy("source_id", "source_so_ky_hieu", "target_so_ky_hieu", "trigger").agg(F.min("evidence").alias("evidence"))


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("roles", security.allowed_roles("title", "text"))


def role_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Role patterns and the share of documents they hold."""
    return security.pattern_counts(_tagged(spark, d))


def tag_audit(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each role pattern with a sample, none among them without a role; roles read back from JSON."""
    stored = _tagged(spark, d).select("doc_id", F.to_json("roles").alias("allowed_roles"))
    return security.tag_audit(stored.withColumn("roles", security.parse_roles("allowed_roles")), "doc_id")


def graph_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per law the number of its documents, of those that are tagged, its roles, and its first three documents with theirs."""
    rows = _tagged(spark, d).filter("so_ky_hieu IS NOT NULL").select("so_ky_hieu", F.col("doc_id").cast("string").alias("id"), "roles")
    counts = rows.groupBy("so_ky_hieu").agg(F.count("*").alias("n"), F.count_if(F.size("roles") > 0).alias("n_tagged"))
    few = graph.first_of_group(rows, "so_ky_hieu", [F.asc("id")], 3).groupBy("so_ky_hieu").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "roles"))), lambda x: F.concat(x["id"], F.lit(":"), F.array_join(x["roles"], ","))), ";").alias("sample")
    )
    return counts.join(security.group_roles(rows, "so_ky_hieu"), "so_ky_hieu", "left").join(few, "so_ky_hieu")


def role_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Documents each role may see."""
    return security.role_coverage(_tagged(spark, d))


def law_roles(spark: SparkSession, d: str) -> DataFrame:
    """Union of the roles of a law's documents."""
    return security.group_roles(_tagged(spark, d).filter("so_ky_hieu IS NOT NULL"), "so_ky_hieu")


def secure(spark: SparkSession, d: str) -> api.SecureRetriever:
    """Over all documents; the logit stands in for a cross-encoder's."""
    docs = _tagged(spark, d).select(F.col("doc_id").alias("id"), "title", "so_ky_hieu", F.lit(None).cast("string").alias("article"), "text", "roles")
    near = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    logit = lambda df: df.withColumn("logit", F.coalesce(F.length("text") % 7 - 3, F.lit(-3)).cast("double"))
    return api.SecureRetriever(docs, near, logit, index=documents_index(spark, d))


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Questions that have a vector too."""
    return questions(spark, d).join(vectors(spark, d), "query_id")


def secure_bm25(spark: SparkSession, d: str) -> DataFrame:
    """What guests get, ranked after the role filter."""
    return secure(spark, d).retrieve(questions(spark, d), ["Guest"], "bm25", 5)


def secure_dense(spark: SparkSession, d: str) -> DataFrame:
    """Nearest documents that guests may see."""
    return secure(spark, d).ranked(asked(spark, d), ["Guest"], "dense", 5)


def secure_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Both fused for guests, in the order of the score at six digits, then lexical before dense rows."""
    return secure(spark, d).ranked(asked(spark, d), ["Guest"], "hybrid", 5).select("query_id", "id", "rrf_score", "rank")


def secure_hybrid_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best of both, reranked for guests."""
    return secure(spark, d).ranked(asked(spark, d), ["Guest"], "secure", 5).select("query_id", "id", "fused_rank", "rerank_score", "rank")


def secure_keyword(spark: SparkSession, d: str) -> DataFrame:
    """R13 graph method, P09: documents that hold a title in any of four fields, by id, ten of each."""
    return secure(spark, d).ranked(questions(spark, d), ["Staff", "Guest"], "graph", 10).select("query_id", "id", "rank")


def blocked_rows(spark: SparkSession, d: str) -> DataFrame:
    """How many of an administrator's twenty best rows a guest may not see."""
    best = secure(spark, d).ranked(questions(spark, d), ["Admin"], "bm25", 20)
    top = best.join(among(_tagged(spark, d).select(F.col("doc_id").alias("id"), "roles"), best, "id"), "id")
    return top.groupBy("query_id").agg(F.count_if(~security.may_see("roles", ["Guest"])).alias("n_blocked"), F.count("*").alias("n"))


def leakage_audit(spark: SparkSession, d: str) -> DataFrame:
    """Every restricted document that asks is the target of its own case, by its chunk's id or (where that is divisible by 200) by its
    law: guests must not get it among ten reranked rows, and staff of the risk side, or else HR, must."""
    rows = asked(spark, d).join(_tagged(spark, d).select(F.col("doc_id").alias("query_id"), "so_ky_hieu", "roles"), "query_id").filter(~security.may_see("roles", ["Guest"]))
    by_chunk = (F.col("query_id") % 200 != 0) | F.col("so_ky_hieu").isNull()
    rows = cut_lineage(rows.select("query_id", "question", "vector", by_chunk.alias("by_chunk"), F.when(by_chunk, F.col("query_id").cast("string")).otherwise(F.col("so_ky_hieu")).alias("target"), security.may_see("roles", ["HR"]).alias("hr")))
    document = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("so_ky_hieu").alias("document"))
    engine = secure(spark, d)

    def got(some: DataFrame, role: str) -> DataFrame:
        found = engine.ranked(some.select("query_id", "question", "vector"), [role], "hybrid_rerank", 10).select("query_id", "id").join(document, "id", "left")
        return found.select("query_id", F.col("id").cast("string").alias("id"), "document")

    permitted = got(rows.filter("hr"), "HR").unionByName(got(rows.filter("NOT hr"), "Risk_Manager"))
    return security.leakage(rows, got(rows, "Guest"), permitted)


QUERIES = {
    f.__name__: f
    for f in (
        node_merge, edge_merge, label_counts, optional_links, unlinked_laws, two_step_paths, hops_undirected, hops_directed, touching_links, allowed_links, next_chunks, first_per_law, search_context, review_queue,
        unverified_relations, clause_reasoning, law_reasoning,
        null_counts, duplicate_keys, missing_references, integrity_report, relation_validation, content_audit, issuers, id_sets, entity_union, first_mentions, insert_ignore, point_lookup, rule_candidates,
        role_patterns, tag_audit, graph_audit, role_coverage, law_roles, secure_bm25, secure_dense, secure_hybrid, secure_hybrid_rerank, secure_keyword, blocked_rows, leakage_audit,
    )
}

_LINKS = "links AS (SELECT DISTINCT doc_id AS src, other_doc_id AS dst, coalesce(relationship_type, '') AS kind FROM doc_relations)"
_SEEDS = "seeds AS (SELECT DISTINCT id AS seed FROM law_metadata WHERE regexp_matches(id, '^[0-9]+00$'))"


def _reach(where: str, hops: int, directed: bool) -> str:
    other = "" if directed else f" UNION SELECT dst, src FROM links WHERE {where} AND src IS NOT NULL AND dst IS NOT NULL AND src <> dst"
    loop = "" if directed else " AND src <> dst"
    return f"""pairs AS (SELECT src AS a, dst AS b FROM links WHERE {where} AND src IS NOT NULL AND dst IS NOT NULL{loop}{other}),
walk AS (SELECT seed, seed AS node, 0 AS depth FROM seeds UNION SELECT walk.seed, b, depth + 1 FROM walk JOIN pairs ON node = a WHERE depth < {hops}),
reached AS (SELECT seed, node, min(depth) AS depth FROM walk GROUP BY seed, node HAVING min(depth) > 0)"""


def _words(names: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(b, '{w}')" for w in names)


_TAG = f"""tag AS (SELECT *, CASE WHEN {_words(security.HR_WORDS)} THEN ['Admin','HR'] WHEN {_words(security.RISK_WORDS)} THEN ['Admin','Risk_Manager','Staff'] ELSE ['Admin','HR','Risk_Manager','Staff','Guest'] END AS roles
  FROM (SELECT *, lower(coalesce(title, '') || ' ' || coalesce(text, '')) AS b FROM documents))"""


_ALL = scores_sql(_Q)
_V = "qv AS (SELECT q.query_id, question, embedding FROM q JOIN embeddings ON vec_id = query_id)"


def _side(name: str, role: str, lex: int, near: int) -> str:
    """name_l and name_n (the best of either search that a role may see) and name_f (both fused)."""
    return f"""{name}_l AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM allscore JOIN tag ON id = doc_id WHERE list_contains(roles, '{role}')) WHERE rank <= {lex}),
{name}_n AS (SELECT * FROM (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (SELECT a.query_id, b.vec_id AS id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance
  FROM qv a, embeddings b JOIN tag ON tag.doc_id = b.vec_id WHERE list_contains(tag.roles, '{role}'))) WHERE rank <= {near}),
{name}_f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, br NULLS LAST, sr NULLS LAST, id) AS fused_rank FROM (SELECT coalesce(l.query_id, n.query_id) AS query_id, coalesce(l.id, n.id) AS id, l.rank AS br, n.rank AS sr,
  round(coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + n.rank), 0), 6) AS rrf_score FROM {name}_l l FULL JOIN {name}_n n ON l.query_id = n.query_id AND l.id = n.id) WHERE query_id IN (SELECT query_id FROM qv)),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank, id) AS rank FROM (SELECT f.*, round(1 / (1 + exp(-coalesce(length(text) % 7 - 3, -3)::DOUBLE)), 6) AS rerank_score FROM {name}_f f JOIN documents ON id = doc_id WHERE fused_rank <= 20))"""


def _nulls() -> str:
    columns = {
        "law_metadata": "id title so_ky_hieu ngay_ban_hanh loai_van_ban ngay_co_hieu_luc ngay_het_hieu_luc nguon_thu_thap ngay_dang_cong_bao nganh linh_vuc co_quan_ban_hanh chuc_danh nguoi_ky pham_vi thong_tin_ap_dung tinh_trang_hieu_luc loaded_at deleted_at",
        "relationships": "rel_id source target relationship_type method confidence evidence extracted_at loaded_at",
        "entities": "entity_id source_doc_id entity_type canonical_name original_name source method confidence evidence extracted_at",
    }
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS n_null FROM {t}" for t, names in columns.items() for c in names.split())


SQL = {
    "node_merge": """WITH l AS (SELECT id, min(title) AS title, max(so_ky_hieu) AS number, max(tinh_trang_hieu_luc) AS status FROM law_metadata WHERE id IS NOT NULL GROUP BY id),
  s AS (SELECT id, upper(title) AS title, 'old' AS status FROM l WHERE length(title) % 2 = 0), i AS (SELECT id, number, nullif(status, '') AS status FROM l)
  SELECT coalesce(i.id, s.id) AS id, s.title, coalesce(i.status, s.status) AS status, i.number FROM s FULL JOIN i ON s.id = i.id""",
    "edge_merge": f"""WITH {_LINKS}, n AS (SELECT DISTINCT id FROM law_metadata) SELECT kind, status, count(*) AS n FROM (SELECT DISTINCT src, kind, dst, CASE WHEN a.id IS NULL AND b.id IS NULL THEN 'both_missing' WHEN a.id IS NULL THEN 'source_missing'
  WHEN b.id IS NULL THEN 'target_missing' ELSE 'merged' END AS status FROM links LEFT JOIN n a ON src = a.id LEFT JOIN n b ON dst = b.id WHERE dst IS NOT NULL AND dst <> '') GROUP BY kind, status""",
    "label_counts": "SELECT 'node:' || coalesce(entity_type, '') AS label, count(*) AS n FROM entities GROUP BY 1 UNION ALL SELECT 'edge:' || coalesce(relationship_type, ''), count(*) FROM relationships GROUP BY 1",
    "optional_links": f"WITH {_LINKS}, n AS (SELECT DISTINCT id FROM law_metadata WHERE id IS NOT NULL) SELECT n.id, count(src) AS n_links, count(t.id) AS n_resolved FROM n LEFT JOIN links ON n.id = src LEFT JOIN n t ON dst = t.id GROUP BY n.id",
    "unlinked_laws": f"WITH {_LINKS}, n AS (SELECT DISTINCT id FROM law_metadata WHERE id IS NOT NULL) SELECT id, 'no_outgoing' AS kind FROM n WHERE NOT EXISTS (FROM links WHERE src = id) UNION ALL SELECT id, 'no_incoming' FROM n WHERE NOT EXISTS (FROM links WHERE dst = id)",
    "two_step_paths": f"WITH {_LINKS} SELECT a.src AS x, count(*) AS n FROM links a JOIN links b ON a.dst = b.src WHERE a.kind = 'SUA_DOI_BO_SUNG' AND b.kind = 'CAN_CU' GROUP BY a.src",
    "hops_undirected": f"WITH RECURSIVE {_LINKS}, {_SEEDS}, {_reach("kind IN ('SUA_DOI_BO_SUNG','HUONG_DAN','THAY_THE')", 2, False)} SELECT seed, node, depth FROM reached",
    "hops_directed": f"WITH RECURSIVE {_LINKS}, {_SEEDS}, {_reach("kind = 'CAN_CU'", 3, True)} SELECT seed, node, depth FROM reached",
    "touching_links": f"WITH {_LINKS}, {_SEEDS} SELECT src, dst, kind FROM links WHERE src IN (SELECT seed FROM seeds) OR dst IN (SELECT seed FROM seeds)",
    "first_per_law": "SELECT so_ky_hieu, id FROM (SELECT so_ky_hieu, doc_id::VARCHAR AS id, row_number() OVER (PARTITION BY so_ky_hieu ORDER BY doc_id::VARCHAR) AS r FROM documents WHERE so_ky_hieu IS NOT NULL) WHERE r <= 2",
    "allowed_links": f"""WITH {_LINKS}, {_SEEDS}, {_TAG}, lr AS (SELECT so_ky_hieu, bool_or(list_has_any(roles, ['Staff', 'Guest'])) AS ok FROM tag WHERE so_ky_hieu IS NOT NULL GROUP BY 1), seen AS (SELECT DISTINCT id FROM law_metadata JOIN lr USING (so_ky_hieu) WHERE ok AND id IS NOT NULL)
  SELECT src, dst, kind FROM links WHERE kind IN ('SUA_DOI_BO_SUNG', 'CAN_CU', 'THAY_THE', 'VAN_BAN_BO_SUNG', 'HOP_NHAT') AND (src IN (SELECT seed FROM seeds) OR dst IN (SELECT seed FROM seeds)) AND src IN (SELECT id FROM seen) AND dst IN (SELECT id FROM seen)""",
    "next_chunks": f"""WITH c AS (SELECT DISTINCT ON (chunk_id) chunk_id, source, lower(' ' || coalesce(text, '')) AS b, coalesce(try_cast(nullif(regexp_extract(chunk_id, ':([0-9]+)$', 1), '') AS BIGINT), 0) AS number FROM chunks WHERE strategy = 'hierarchical' AND chunk_id IS NOT NULL),
  o AS (SELECT *, NOT ({_words(security.HR_WORDS)}) AS ok, lead(chunk_id) OVER w AS next_id FROM c WINDOW w AS (PARTITION BY source ORDER BY number, chunk_id)) SELECT o.chunk_id AS id, o.next_id FROM o JOIN o p ON p.chunk_id = o.next_id WHERE o.number % 10 = 0 AND o.ok AND p.ok""",
    "search_context": f"""WITH RECURSIVE {_LINKS}, docs AS (SELECT doc_id AS id, so_ky_hieu FROM documents WHERE so_ky_hieu IS NOT NULL), ids AS (SELECT DISTINCT id AS law, so_ky_hieu FROM law_metadata WHERE id IS NOT NULL AND so_ky_hieu IS NOT NULL),
  near AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)) WHERE rank <= 3),
  direct AS (SELECT query_id, id, so_ky_hieu FROM near JOIN docs USING (id)), qs AS (SELECT DISTINCT query_id, law FROM direct JOIN ids USING (so_ky_hieu)), seeds AS (SELECT DISTINCT law AS seed FROM qs), {_reach("TRUE", 2, False)},
  nl AS (SELECT query_id, node, min(depth) AS depth FROM qs JOIN reached ON law = seed GROUP BY query_id, node), nx AS (SELECT * FROM nl WHERE NOT EXISTS (FROM qs WHERE qs.query_id = nl.query_id AND qs.law = nl.node)), st(setting) AS (VALUES (0), (1), (2)),
  rel AS (SELECT setting, query_id, docs.id, docs.so_ky_hieu, min(depth) AS hops FROM st, nx JOIN ids ON law = node JOIN docs USING (so_ky_hieu) WHERE depth <= setting GROUP BY ALL)
  SELECT query_id, id, so_ky_hieu, 0 AS hops, setting FROM direct, st UNION ALL SELECT query_id, id, so_ky_hieu, hops, setting FROM (SELECT *, row_number() OVER (PARTITION BY setting, query_id, so_ky_hieu ORDER BY id::VARCHAR) AS r FROM rel) WHERE r <= 2""",
    "review_queue": "SELECT DISTINCT rel_id, source, target, confidence FROM relationships WHERE method = 'llm' AND confidence IS NOT NULL AND source IN (SELECT so_ky_hieu FROM law_metadata WHERE so_ky_hieu IS NOT NULL) AND target IN (SELECT so_ky_hieu FROM law_metadata WHERE so_ky_hieu IS NOT NULL)",
    "unverified_relations": "SELECT relationship_type, 'PROPOSED' AS verification_status, count(*) AS n FROM relationships WHERE method = 'llm' AND confidence IS NOT NULL GROUP BY 1",
    "clause_reasoning": f"""WITH near AS (SELECT * FROM (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)) WHERE rank <= 10),
  laws AS (SELECT so_ky_hieu, max(tinh_trang_hieu_luc) AS status FROM law_metadata WHERE so_ky_hieu IS NOT NULL GROUP BY 1), sure AS (SELECT DISTINCT source, target, relationship_type FROM relationships WHERE coalesce({VERIFICATION}, 'VERIFIED') = 'VERIFIED'),
  j AS (SELECT query_id, id, d.so_ky_hieu, round(1 - distance, 6) AS score, a.target AS law, b.target AS issuer FROM near JOIN documents d ON id = doc_id JOIN laws USING (so_ky_hieu) LEFT JOIN sure a ON a.relationship_type = 'THAM_CHIEU' AND a.source = d.so_ky_hieu LEFT JOIN sure b ON b.relationship_type = 'BAN_HANH_BOI' AND b.source = a.target WHERE status <> 'Hết hiệu lực toàn bộ')
  SELECT query_id, id, so_ky_hieu, score, coalesce(string_agg(DISTINCT law, '|' ORDER BY law), '') AS laws, coalesce(string_agg(DISTINCT issuer, '|' ORDER BY issuer), '') AS issuers FROM j GROUP BY ALL""",
    "law_reasoning": """WITH l AS (SELECT DISTINCT so_ky_hieu FROM law_metadata WHERE so_ky_hieu IS NOT NULL), p AS (SELECT source, string_agg(DISTINCT target, '|' ORDER BY target) FILTER (relationship_type = 'BAN_HANH_BOI') AS issuers,
  string_agg(DISTINCT target, '|' ORDER BY target) FILTER (relationship_type = 'KY_BOI') AS signers, count(*) FILTER (relationship_type = 'BAN_HANH_BOI') AS ni, count(*) FILTER (relationship_type = 'KY_BOI') AS ns FROM relationships GROUP BY source)
  SELECT so_ky_hieu, CASE WHEN ni > 0 THEN coalesce(issuers, '') END AS issuers, CASE WHEN ns > 0 THEN coalesce(signers, '') END AS signers FROM l LEFT JOIN p ON so_ky_hieu = source""",
    "null_counts": _nulls(),
    "duplicate_keys": "SELECT 'law_metadata' AS table_name, id AS key, count(*) AS n FROM law_metadata GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'entities', entity_id, count(*) FROM entities GROUP BY entity_id HAVING count(*) > 1",
    "missing_references": "SELECT other_doc_id AS key, count(*) AS n FROM doc_relations WHERE other_doc_id IS NOT NULL AND other_doc_id <> '' AND NOT EXISTS (FROM law_metadata WHERE id = other_doc_id) GROUP BY other_doc_id",
    "integrity_report": """SELECT 'rows:law_metadata' AS check_name, count(*) AS n FROM law_metadata UNION ALL SELECT 'rows:entities', count(*) FROM entities UNION ALL SELECT 'null:law id', count(*) FROM law_metadata WHERE id IS NULL
  UNION ALL SELECT 'duplicate:law id', count(*) FROM (SELECT id FROM law_metadata GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'duplicate:entity id', count(*) FROM (SELECT entity_id FROM entities GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'missing:source_doc_id', count(*) FROM entities e WHERE NOT EXISTS (FROM law_metadata WHERE id = e.source_doc_id) UNION ALL SELECT 'missing:doc_id', count(*) FROM doc_relations r WHERE NOT EXISTS (FROM law_metadata WHERE id = r.doc_id)
  UNION ALL SELECT 'self link', count(*) FROM doc_relations WHERE doc_id = other_doc_id""",
    "relation_validation": f"""WITH n AS (SELECT so_ky_hieu AS id FROM law_metadata WHERE so_ky_hieu IS NOT NULL UNION SELECT canonical_name FROM entities WHERE canonical_name IS NOT NULL), r AS (SELECT source, target, relationship_type, max(evidence) AS evidence, count(*) AS n_rows FROM relationships GROUP BY ALL)
  SELECT CASE WHEN a.id IS NULL THEN 'unknown_source' WHEN NOT coalesce(relationship_type IN {ALLOWED!r}, FALSE) THEN 'type_not_allowed' WHEN b.id IS NULL THEN 'unknown_target' WHEN source = target THEN 'self_loop' WHEN trim(coalesce(evidence, '')) = '' THEN 'no_evidence' ELSE 'valid' END AS reason,
  count(*) AS n, sum(n_rows) AS n_rows FROM r LEFT JOIN n a ON source = a.id LEFT JOIN n b ON target = b.id GROUP BY 1""",
    "content_audit": "SELECT CASE WHEN a.so_ky_hieu IS NULL THEN 'document_only' WHEN b.so_ky_hieu IS NULL THEN 'law_only' ELSE 'both' END AS kind, count(*) AS n FROM (SELECT DISTINCT so_ky_hieu FROM law_metadata WHERE so_ky_hieu IS NOT NULL) a FULL JOIN (SELECT DISTINCT so_ky_hieu FROM documents WHERE so_ky_hieu IS NOT NULL) b ON a.so_ky_hieu = b.so_ky_hieu GROUP BY 1",
    "issuers": "SELECT coalesce(nganh, '') AS nganh, coalesce(string_agg(DISTINCT co_quan_ban_hanh, '|' ORDER BY co_quan_ban_hanh), '') AS issuers FROM law_metadata GROUP BY 1",
    "id_sets": """WITH a AS (SELECT DISTINCT so_ky_hieu FROM documents WHERE so_ky_hieu IS NOT NULL), b AS (SELECT DISTINCT source AS so_ky_hieu FROM relationships WHERE source IS NOT NULL)
  SELECT 'union' AS kind, so_ky_hieu FROM (FROM a UNION FROM b) UNION ALL SELECT 'difference', so_ky_hieu FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'intersection', so_ky_hieu FROM (FROM a INTERSECT FROM b)""",
    "entity_union": "SELECT c_custkey AS id, c_name AS name, 'customer' AS kind, c_mktsegment AS segment, NULL::INT AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier', NULL, s_nationkey FROM supplier",
    "first_mentions": "SELECT entity, mention_id, doc_id FROM extracted_entities_raw WHERE entity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity ORDER BY extracted_at NULLS LAST, mention_id, doc_id) = 1",
    "insert_ignore": """SELECT chunk_id, page_start, md5(text) AS digest FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE strategy = 'semantic' AND chunk_id IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY page_start NULLS FIRST, text, source) = 1""",
    "point_lookup": "SELECT doc_id, (doc_id / 100)::INT AS rank, title FROM documents WHERE doc_id % 100 = 0",
    "rule_candidates": f"""SELECT source_id, source_so_ky_hieu, target_so_ky_hieu, trigger, min(evidence) AS evidence FROM (SELECT source_id, source_so_ky_hieu, evidence, regexp_extract(evidence, '{_NUMBER}$') AS target_so_ky_hieu, regexp_extract(evidence, '^({"|".join(TRIGGERS)})', 1) AS trigger
  FROM (SELECT doc_id AS source_id, so_ky_hieu AS source_so_ky_hieu, unnest(regexp_extract_all(nfc_normalize(text), '{_CANDIDATE}')) AS evidence FROM documents WHERE text IS NOT NULL)) WHERE target_so_ky_hieu <> '' AND (source_so_ky_hieu IS NULL OR target_so_ky_hieu <> source_so_ky_hieu) GROUP BY ALL""",
    "tag_audit": f"WITH {_TAG} SELECT array_to_string(roles, ',') AS pattern, count(*) AS n, min(doc_id) AS sample FROM tag GROUP BY 1",
    "graph_audit": f"""WITH {_TAG}, r AS (SELECT so_ky_hieu, doc_id::VARCHAR AS id, roles FROM tag WHERE so_ky_hieu IS NOT NULL), f AS (SELECT *, row_number() OVER (PARTITION BY so_ky_hieu ORDER BY id) AS k FROM r), u AS (SELECT so_ky_hieu, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM (SELECT so_ky_hieu, unnest(roles) AS role FROM r) GROUP BY 1)
  SELECT so_ky_hieu, count(*) AS n, count(*) FILTER (len(f.roles) > 0) AS n_tagged, any_value(u.roles) AS roles, string_agg(id || ':' || array_to_string(f.roles, ','), ';' ORDER BY id) FILTER (k <= 3) AS sample FROM f JOIN u USING (so_ky_hieu) GROUP BY so_ky_hieu""",
    "role_patterns": f"WITH {_TAG} SELECT array_to_string(roles, ',') AS pattern, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM documents), 4) AS percent FROM tag GROUP BY 1",
    "role_coverage": f"WITH {_TAG} SELECT role, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM documents), 4) AS percent FROM (SELECT unnest(roles) AS role FROM tag) GROUP BY role",
    "law_roles": f"WITH {_TAG} SELECT so_ky_hieu, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM (SELECT so_ky_hieu, unnest(roles) AS role FROM tag WHERE so_ky_hieu IS NOT NULL) GROUP BY so_ky_hieu",
    "secure_bm25": f"WITH {_ALL}, {_V}, {_TAG}, {_side('s', 'Guest', 5, 5)} SELECT query_id, id, rank, '[' || CASE WHEN trim(coalesce(so_ky_hieu, '')) <> '' THEN 'Số ' || so_ky_hieu ELSE coalesce(title, '') END || ' |  | ' || id || ']' AS display FROM s_l JOIN documents ON id = doc_id",
    "secure_dense": f"WITH {_ALL}, {_V}, {_TAG}, {_side('s', 'Guest', 5, 5)} SELECT query_id, id, distance, rank FROM s_n",
    "secure_hybrid": f"WITH {_ALL}, {_V}, {_TAG}, {_side('s', 'Guest', 20, 20)} SELECT query_id, id, rrf_score, fused_rank AS rank FROM s_f WHERE fused_rank <= 5",
    "secure_hybrid_rerank": f"WITH {_ALL}, {_V}, {_TAG}, {_side('s', 'Guest', 20, 20)} SELECT query_id, id, fused_rank, rerank_score, rank FROM s_r WHERE rank <= 5",
    "secure_keyword": f"""WITH {_Q}, {_TAG}, w AS (SELECT query_id, replace(lower({SQUEEZED.format('question')}), 'ß', 'ss') AS word FROM q) SELECT query_id, id, r AS rank FROM (SELECT query_id, doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS r FROM tag, w
  WHERE list_has_any(roles, ['Staff', 'Guest']) AND (contains(replace(lower(coalesce(title, '')), 'ß', 'ss'), word) OR contains(replace(lower(coalesce(text, '')), 'ß', 'ss'), word) OR contains(replace(lower(coalesce(so_ky_hieu, '')), 'ß', 'ss'), word))) WHERE r <= 10""",
    "blocked_rows": f"WITH {_ALL}, {_V}, {_TAG}, {_side('s', 'Admin', 20, 20)} SELECT query_id, count(*) FILTER (NOT list_contains(roles, 'Guest')) AS n_blocked, count(*) AS n FROM s_l JOIN tag ON id = doc_id GROUP BY query_id",
    "leakage_audit": f"""WITH {_ALL}, {_V}, {_TAG}, {_side('g', 'Guest', 20, 20)}, {_side('h', 'HR', 20, 20)}, {_side('m', 'Risk_Manager', 20, 20)},
  ca AS (SELECT qv.query_id, so_ky_hieu, list_contains(roles, 'HR') AS hr, qv.query_id % 200 <> 0 OR so_ky_hieu IS NULL AS by_chunk, CASE WHEN qv.query_id % 200 <> 0 OR so_ky_hieu IS NULL THEN qv.query_id::VARCHAR ELSE so_ky_hieu END AS target FROM qv JOIN tag ON doc_id = qv.query_id WHERE NOT list_contains(roles, 'Guest')),
  un AS (SELECT query_id, id FROM g_r WHERE rank <= 10), au AS (SELECT query_id, id FROM h_r JOIN ca USING (query_id) WHERE hr AND rank <= 10 UNION ALL SELECT query_id, id FROM m_r JOIN ca USING (query_id) WHERE NOT hr AND rank <= 10),
  hit AS (SELECT ca.query_id, s.side, count(*) AS n, bool_or(coalesce(CASE WHEN by_chunk THEN s.id::VARCHAR = target ELSE d.so_ky_hieu = target END, FALSE)) AS hit FROM ca JOIN (SELECT *, 'u' AS side FROM un UNION ALL SELECT *, 'a' FROM au) s USING (query_id) LEFT JOIN documents d ON d.doc_id = s.id GROUP BY 1, 2)
  SELECT ca.query_id, target, coalesce(u.n, 0) AS n_unauthorised, coalesce(a.n, 0) AS n_authorised, coalesce(u.hit, FALSE) AS leaked, coalesce(a.hit, FALSE) AS found, NOT coalesce(u.hit, FALSE) AND coalesce(a.hit, FALSE) AS passed FROM ca LEFT JOIN hit u ON u.query_id = ca.query_id AND u.side = 'u' LEFT JOIN hit a ON a.query_id = ca.query_id AND a.side = 'a'""",
}
