"""Queries over chunks, pages and documents: text functions, chunkers, hierarchy, loading checks; and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import text as t
from lamina.operators import answers, chunking, hierarchy, quality
from lamina.plans.retrieval import children
from lamina.plans.sql import BLANK, CHILD, NORM, SQUEEZED, STRIP, WORDS, windows_sql
from lamina.sources import files, spread, table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return chunking.page_documents(spread(table(spark, d, "raw_pages").select("source", "page", "text", "ocr_used")))


def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """C01, F06, F07 over all scanned documents."""
    rows = chunking.fixed_chunks(_pages(spark, d))
    return rows.select("source", "number", "chunk_id", "page_start", "page_end", "start", F.length("text").alias("n"), F.md5("text").alias("digest"))


def joined_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each source as one text, with the places where pages end."""
    rows = chunking.join_pages(_pages(spark, d))
    return rows.select("source", "page_count", "ocr_used", F.length("text").alias("n_chars"), F.element_at("page_ends", -1).alias("last_end"))


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    """Chunk lengths by source and strategy."""
    rows = chunking.chunk_statistics(table(spark, d, "chunks"), ["source", "strategy"])
    return rows.withColumn("label", t.length_label("length_min", "length_max"))


def _solid(c: str) -> Column:
    return F.length(F.regexp_replace(c, f"[{t.SPACE}]", ""))


def _kept(rows: DataFrame, short: Column) -> DataFrame:
    """Per source: what must hold of its chunks, and the characters they hold, white space aside."""
    return rows.groupBy("source").agg(
        F.sum(_solid("text")).alias("solid"), F.min(short).alias("within_limit"), (F.max("number") == F.count("*")).alias("numbered"),
        F.min((F.col("page_start") >= 1) & (F.col("page_end") >= F.col("page_start"))).alias("pages_in_order"), F.max("page_end").alias("last_page"),
    )


def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    """C02 over all scanned documents: no character is lost, none is over the limit, numbers and pages are in order."""
    return _kept(chunking.semantic_chunks(_pages(spark, d)), F.length("text") <= 1200).select("source", "solid", "within_limit", "numbered", "pages_in_order")


def hierarchical_chunks(spark: SparkSession, d: str) -> DataFrame:
    """C03 over all scanned documents: the same, but that a heading line is never cut; and the headings found."""
    rows = chunking.hierarchical_chunks(_pages(spark, d))
    kept = _kept(rows, (F.length("text") <= 1200) | ~F.contains("text", F.lit("\n")))
    found = rows.groupBy("source").agg(F.count_distinct("structure.article").alias("n_articles"), F.max(F.col("warning").isNotNull()).alias("no_heading"))
    return kept.join(found, "source").select("source", "solid", "within_limit", "numbered", "pages_in_order", "last_page", "n_articles", "no_heading")


def text_flags(spark: SparkSession, d: str) -> DataFrame:
    """F04 over pages."""
    pages = spread(table(spark, d, "raw_pages")).select("page_id", F.explode(t.text_problems(t.normalise("text"))).alias("flag")).distinct()
    return pages.groupBy("flag").agg(F.count("*").alias("n"))


def dry_run(spark: SparkSession, d: str) -> DataFrame:
    """Documents that would be read by OCR, with their bad pages."""
    rows = files.dry_run(spread(table(spark, d, "raw_pages")).filter("source IS NOT NULL AND page IS NOT NULL").withColumn("text", t.normalise("text")))
    return rows.select("source", "would_use_ocr", F.array_join("bad_pages", ",").alias("bad_pages"), "n_pages")


def token_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Tokens, distinct terms and mean length per source of documents."""
    rows = spread(table(spark, d, "documents").select("source", "text")).filter("text IS NOT NULL").select("source", t.tokens("text").alias("w"))
    return rows.groupBy("source").agg(F.sum(F.size("w")).alias("n_tokens"), F.round(F.avg(F.size("w")), 4).alias("mean_tokens"), F.count("*").alias("n_documents"))


def squeezed_titles(spark: SparkSession, d: str) -> DataFrame:
    """titles in plain form, and whether they name a loan."""
    rows = table(spark, d, "documents")
    return rows.select("doc_id", t.squeeze("title").alias("title"), t.preview(t.normalise("text")).alias("preview"), F.coalesce(t.contains_folded("title", "KHOẢN VAY"), F.lit(False)).alias("names_loan"))


def composed_differs(spark: SparkSession, d: str) -> DataFrame:
    """chunks whose composed form differs from the stored one."""
    rows = table(spark, d, "chunks").select("chunk_id", "text", t.normalise("text").alias("composed"))
    return rows.filter("text <> composed").select("chunk_id", F.length("text").alias("stored"), F.length("composed").alias("composed")).distinct()


def line_headings(spark: SparkSession, d: str) -> DataFrame:
    """F05 over all lines of chunks and pages."""
    rows = table(spark, d, "chunks").select("text").unionByName(table(spark, d, "raw_pages").select("text"))
    lines = spread(rows).filter("text IS NOT NULL").select(F.explode(F.split("text", t.LINE_END)).alias("line"))
    return lines.select(t.heading_level("line").alias("level")).filter("level IS NOT NULL").groupBy("level").agg(F.count("*").alias("n"))


def legal_refs(spark: SparkSession, d: str) -> DataFrame:
    """references to provisions by kind and number."""
    refs = table(spark, d, "documents").select("doc_id", F.explode(t.legal_references("text")).alias("reference"))
    return refs.groupBy("reference").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_documents"))


def chunk_problems(spark: SparkSession, d: str) -> DataFrame:
    """Chunk records by problem."""
    rows = quality.validate_chunks(table(spark, d, "chunks"), files.STRATEGIES)
    return rows.groupBy(F.coalesce("problem", F.lit("valid")).alias("problem")).agg(F.count("*").alias("n"))


def loader_statistics(spark: SparkSession, d: str) -> DataFrame:
    """What loading the semantic chunks counts."""
    rows = quality.validate_chunks(table(spark, d, "chunks"), files.STRATEGIES).withColumn("file", F.col("source"))
    return files.loader_statistics(rows, "semantic")


def hierarchy_children(spark: SparkSession, d: str) -> DataFrame:
    """C08, W12, F08, F09."""
    rows = children(spark, d)
    return rows.select("chunk_id", "source", "number", "chapter", "article", "clause", "point", "method", "ambiguous", F.array_join("warnings", "; ").alias("warnings"))


def parent_windows(spark: SparkSession, d: str) -> DataFrame:
    """C09, A11, F10."""
    rows = hierarchy.parent_windows(children(spark, d), 2000)
    return rows.withColumn("child_ids", F.array_join("child_ids", ",")).withColumn("text", F.md5("text"))


def hierarchy_audit(spark: SparkSession, d: str) -> DataFrame:
    """A09, A10, M13."""
    rows = children(spark, d)
    return hierarchy.hierarchy_audit(rows, hierarchy.parent_windows(rows, 2000))


def _html(spark: SparkSession, d: str) -> DataFrame:
    """Documents as HTML: each line a paragraph, tags in either case, text between paragraphs that is none."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    text = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<html><script>var p = '<p>';</script>đầu trang không thuộc đoạn nào<P>"), F.replace(text, F.lit("\n"), F.lit('</P>phần đứng ngoài mọi đoạn văn<p class="x">')), F.lit("</p>cuối trang không thuộc đoạn nào</html>"))
    return chunking.html_chunks(docs.select("doc_id", page.alias("html")), "doc_id", "html")


def html_chunks(spark: SparkSession, d: str) -> DataFrame:
    """F29, C05."""
    return _html(spark, d).select("doc_id", "number", "chunk_id", F.md5("text").alias("digest"))


def chunk_edges(spark: SparkSession, d: str) -> DataFrame:
    """NEXT and PARENT_OF edges per document."""
    rows = _html(spark, d).select("doc_id", "number", "chunk_id")
    a = chunking.next_edges(rows, "doc_id", "number", "chunk_id").withColumn("kind", F.lit("NEXT"))
    b = chunking.parent_edges(rows, "doc_id", "number", "chunk_id").withColumn("kind", F.lit("PARENT_OF"))
    return a.unionByName(b)


def citations(spark: SparkSession, d: str) -> DataFrame:
    """Displays of chunks."""
    rows = table(spark, d, "chunks").filter("page_start IS NOT NULL AND page_end IS NOT NULL AND source IS NOT NULL")
    number = t.trailing_number(F.col("chunk_id"))
    return rows.select(
        "chunk_id", t.citation("source", "page_start", "page_end", "chunk_id").alias("display"), t.page_label("page_start", "page_end").alias("pages"),
        number.alias("number"), t.structure_path("structure").alias("path"), t.chunk_id(t.file_stem("source"), "strategy", number).alias("made_id"),
        t.scored_citation(F.lit("E1"), "source", "page_start", "page_end", F.lit(0.5)).alias("short_display"),
    ).distinct()


def variant_filter(spark: SparkSession, d: str) -> DataFrame:
    """C10 on the titles of documents: each asks, and its neighbours in id stand for generated variants."""
    docs = table(spark, d, "documents").filter("title IS NOT NULL").select("doc_id", "title")
    ask = docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("question"))
    near = docs.withColumn("query_id", F.floor(F.col("doc_id") / 100) * 100 + 100).select("query_id", F.col("doc_id").alias("n"), F.col("title").alias("text"))
    return answers.filter_variants(ask, near, 4)


def wiki_checks(spark: SparkSession, d: str) -> DataFrame:
    """C11, F22, F23, M09, A23 on a wiki of all laws: each page links along the law's relations, Home to some pages; some pages
    have ids that no law has."""
    laws = table(spark, d, "law_metadata").filter("id IS NOT NULL").select("id").distinct()
    rels = table(spark, d, "doc_relations").filter("other_doc_id <> ''").select(F.col("doc_id").alias("source_id"), F.coalesce("relationship_type", F.lit("")).alias("relationship_type"), F.col("other_doc_id").alias("target_id")).distinct()
    lines = rels.groupBy(F.col("source_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- [["), "target_id", F.lit("|"), "relationship_type", F.lit("x]]")))), "\n").alias("l"))
    stated = F.when(F.col("id").endswith("3"), F.concat(F.lit("X"), "id")).otherwise(F.col("id"))
    body = F.concat(F.lit("---\ntype: VanBan\nid: "), stated, F.lit("\n---\n\n# "), "id", F.lit("\n"), F.coalesce("l", F.lit("")))
    pages = laws.join(lines, "id", "left").select(F.col("id").alias("note"), body.alias("body"))
    home = laws.filter(F.col("id").endswith("7")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("[["), "id", F.lit("]]")))), " ").alias("l"))
    pages = pages.unionByName(home.select(F.lit("Home").alias("note"), F.concat(F.lit("---\nid: HOME\n---\n"), "l").alias("body")))
    nodes = table(spark, d, "law_metadata").filter("id IS NOT NULL").select("id", F.lit("VanBan").alias("type"))
    return quality.validate_wiki(pages, nodes, rels, ("VanBan", "SUA_DOI_BO_SUNG", "CAN_CU"))


def formatted_values(spark: SparkSession, d: str) -> DataFrame:
    """Display forms of customers."""
    c = table(spark, d, "customer")
    return c.select(
        "c_custkey", t.money(F.col("c_acctbal") * 1000).alias("balance"), t.money("c_name").alias("no_number"), t.entity_title(F.col("c_custkey").cast("string"), "c_name").alias("title"),
        t.file_name(F.concat(F.lit("\t "), "c_name", F.lit(':"?'))).alias("file"), t.edge_label("c_name", F.lit("IN"), "c_mktsegment").alias("label"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        fixed_chunks, joined_pages, chunk_stats, semantic_chunks, hierarchical_chunks, text_flags, dry_run, token_statistics, squeezed_titles, composed_differs, line_headings, legal_refs, chunk_problems,
        loader_statistics, hierarchy_children, parent_windows, hierarchy_audit, html_chunks, chunk_edges, citations, variant_filter, wiki_checks, formatted_values,
    )
}

_HTML = f"""lines AS (SELECT doc_id, i, {STRIP.format('x')} AS text FROM (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))),
hc AS (SELECT doc_id, r AS number, doc_id || '_chunk_' || r AS chunk_id, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS r FROM lines WHERE length(text) > 20))"""
_PG = f"""pg AS (SELECT source, page, max(coalesce({NORM.format('text')}, '')) AS text, bool_or(coalesce(ocr_used, FALSE)) AS ocr FROM raw_pages WHERE source IS NOT NULL AND page IS NOT NULL GROUP BY source, page),
ds AS (SELECT source, count(*) AS page_count, bool_or(ocr) AS ocr_used, max(page) AS last_page, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM pg GROUP BY source),
pe AS (SELECT *, sum(length(text) + 2) OVER (PARTITION BY source ORDER BY page) - 2 AS e FROM pg)"""
_LINES = r"regexp_split_to_array({}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{{2028}}\x{{2029}}]')"


def _level(line: str) -> str:
    end = r"([^\p{L}\p{N}_]|$)"
    tests = [
        ("chapter", rf"(?i)^{BLANK}*(CHƯƠNG|PHẦN){BLANK}+[IVXLCDM0-9]+{end}"), ("section", rf"(?i)^{BLANK}*MỤC{BLANK}+[IVXLCDM0-9]+{end}"), ("article", rf"(?i)^{BLANK}*ĐIỀU{BLANK}+\p{{Nd}}+{end}"),
        ("clause", rf"^{BLANK}*\p{{Nd}}+\.{BLANK}+."), ("point", rf"(?i)^{BLANK}*[a-zđ]\){BLANK}+."),
    ]
    return "CASE " + " ".join(f"WHEN regexp_matches({line}, '{x}') THEN '{name}'" for name, x in tests) + " END"


_FLAG = rf"""fl AS (SELECT page_id, source, page, list_filter([CASE WHEN solid = 0 THEN '{t.FLAGS[0]}' END, CASE WHEN contains(x, chr(65533)) THEN '{t.FLAGS[1]}' END, CASE WHEN regexp_matches(x, 'Ã.|Ä.|Â.|\x{{fffd}}') THEN '{t.FLAGS[2]}' END,
  CASE WHEN len(regexp_extract_all(regexp_replace(x, '([A-Za-zĐđ])', '\1\1', 'g'), '[A-Za-zĐđ]\p{{Nd}}[A-Za-zĐđ]')) >= 3 THEN '{t.FLAGS[3]}' END,
  CASE WHEN len(list_filter(regexp_extract_all(x, '[\p{{L}}\p{{N}}_]+'), lambda y: regexp_full_match(y, '[A-Za-zĐđ]*[a-zđ][A-ZĐ][A-Za-zĐđ]*'))) >= 3 THEN '{t.FLAGS[4]}' END,
  CASE WHEN solid > 0 AND length(x) - length(regexp_replace(x, '[\x00-\x08\x0b-\x1f]', '', 'g')) > 0.02 * solid THEN '{t.FLAGS[5]}' END], lambda z: z IS NOT NULL) AS flags
  FROM (SELECT page_id, source, page, x, length(regexp_replace(x, '{BLANK}', '', 'g')) AS solid FROM (SELECT page_id, source, page, coalesce({NORM.format('text')}, '') AS x FROM raw_pages)))"""
_WIKI = """laws AS (SELECT DISTINCT id FROM law_metadata WHERE id IS NOT NULL), rl AS (SELECT DISTINCT doc_id AS s, coalesce(relationship_type, '') AS k, other_doc_id AS t FROM doc_relations WHERE other_doc_id <> ''),
lk AS (SELECT s AS src, t AS dst FROM rl JOIN laws ON s = id UNION ALL SELECT 'Home', id FROM laws WHERE id LIKE '%7'), nt AS (SELECT id AS note FROM laws UNION ALL SELECT 'Home')"""

SQL = {
    "fixed_chunks": rf"""WITH {_PG}, st AS (SELECT source, page_count, ocr_used, text, unnest(range(0, length(text), 1050)) AS start FROM ds),
  cu AS (SELECT *, {STRIP.format('substr(text, start + 1, 1200)')} AS x FROM st), nu AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY start) AS number FROM cu WHERE x <> ''),
  pp AS (SELECT nu.source, nu.number, coalesce(min(pe.page), 1) AS p FROM nu LEFT JOIN pe ON pe.source = nu.source AND length(pe.text) > 0 AND pe.e > nu.start GROUP BY 1, 2)
  SELECT source, number, regexp_replace(source, '(.)\.[^.]*$', '\1') || ':fixed-size:' || lpad(number::VARCHAR, greatest(4, length(number::VARCHAR))::INT, '0') AS chunk_id, CASE WHEN ocr_used THEN 1 ELSE p END AS page_start, CASE WHEN ocr_used THEN page_count ELSE p END AS page_end, start, length(x) AS n, md5(x) AS digest FROM nu JOIN pp USING (source, number)""",
    "joined_pages": f"WITH {_PG} SELECT source, page_count, ocr_used, length(text) AS n_chars, length(text) AS last_end FROM ds",
    "chunk_stats": "SELECT *, length_min || '–' || length_max AS label FROM (SELECT source, strategy, count(text) AS chunk_count, coalesce(min(length(text)), 0) AS length_min, coalesce(max(length(text)), 0) AS length_max, coalesce(round(avg(length(text)), 2), 0) AS length_avg FROM chunks GROUP BY source, strategy)",
    "semantic_chunks": f"WITH {_PG} SELECT source, length(regexp_replace(text, '{BLANK}', '', 'g')) AS solid, TRUE AS within_limit, TRUE AS numbered, TRUE AS pages_in_order FROM ds WHERE regexp_replace(text, '{BLANK}', '', 'g') <> ''",
    "hierarchical_chunks": f"""WITH {_PG}, ln AS (SELECT source, page, unnest({_LINES.format('text')}) AS line FROM pg), lv AS (SELECT source, {_level('line')} AS level, {STRIP.format('line')} AS line FROM ln),
  ha AS (SELECT source, count(*) FILTER (level IS NOT NULL) AS n, count(DISTINCT line) FILTER (level = 'article') AS n_articles FROM lv GROUP BY source)
  SELECT source, length(regexp_replace(text, '{BLANK}', '', 'g')) AS solid, TRUE AS within_limit, TRUE AS numbered, TRUE AS pages_in_order, CASE WHEN ocr_used THEN page_count ELSE last_page END AS last_page, n_articles, n = 0 AS no_heading FROM ds JOIN ha USING (source) WHERE regexp_replace(text, '{BLANK}', '', 'g') <> ''""",
    "text_flags": f"WITH {_FLAG} SELECT flag, count(DISTINCT page_id) AS n FROM (SELECT page_id, unnest(flags) AS flag FROM fl) GROUP BY flag",
    "dry_run": f"WITH {_FLAG}, p AS (SELECT source, page, bool_or(len(flags) > 0) AS bad FROM fl WHERE source IS NOT NULL AND page IS NOT NULL GROUP BY 1, 2) SELECT source, bool_or(bad) AS would_use_ocr, coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (bad), '') AS bad_pages, count(*) AS n_pages FROM p GROUP BY source",
    "token_statistics": f"SELECT source, sum(len(w)) AS n_tokens, round(avg(len(w)), 4) AS mean_tokens, count(*) AS n_documents FROM (SELECT source, {WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL) GROUP BY source",
    "squeezed_titles": f"SELECT doc_id, {SQUEEZED.format('title')} AS title, replace(substr({NORM.format('text')}, 1, 100), chr(10), ' ') AS preview, coalesce(contains(lower(title), 'khoản vay'), FALSE) AS names_loan FROM documents",
    "composed_differs": f"SELECT DISTINCT chunk_id, length(text) AS stored, length({NORM.format('text')}) AS composed FROM chunks WHERE text <> {NORM.format('text')}",
    "line_headings": f"SELECT level, count(*) AS n FROM (SELECT {_level('line')} AS level FROM (SELECT unnest({_LINES.format('text')}) AS line FROM (SELECT text FROM chunks UNION ALL SELECT text FROM raw_pages) WHERE text IS NOT NULL)) WHERE level IS NOT NULL GROUP BY level",
    "legal_refs": r"SELECT reference, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '(điều|khoản|điểm|chương|thông tư|nghị định|luật)\s+\d+')) AS reference FROM documents) GROUP BY reference",
    "chunk_problems": """SELECT problem, count(*) AS n FROM (SELECT CASE WHEN trim(coalesce(text, '')) = '' THEN 'skipped_blank' WHEN chunk_id IS NULL OR source IS NULL OR strategy IS NULL THEN 'missing_field'
  WHEN strategy NOT IN ('fixed-size', 'semantic', 'hierarchical') THEN 'bad_strategy' WHEN page_start IS NULL OR page_end IS NULL THEN 'missing_page' WHEN page_start < 1 THEN 'bad_page' WHEN page_start > page_end THEN 'page_order' ELSE 'valid' END AS problem FROM chunks) GROUP BY problem""",
    "loader_statistics": """SELECT count(DISTINCT source) AS files, count(*) AS records, count(*) FILTER (strategy = 'semantic') AS selected, count(*) FILTER (strategy = 'semantic' AND trim(coalesce(text, '')) = '') AS empty,
  count(*) FILTER (strategy = 'semantic' AND trim(coalesce(text, '')) <> '' AND chunk_id IS NOT NULL AND source IS NOT NULL AND page_start >= 1 AND page_end >= page_start) AS valid FROM chunks""",
    "hierarchy_children": f"WITH {CHILD} SELECT chunk_id, source, number, chapter, article, clause, point, method, ambiguous, warnings FROM ch",
    "parent_windows": f"WITH RECURSIVE {windows_sql(2000)} SELECT * REPLACE (md5(text) AS text) FROM pw",
    "hierarchy_audit": f"""WITH RECURSIVE {windows_sql(2000)} SELECT 'method:' || method AS metric, count(*)::DOUBLE AS value FROM ch GROUP BY method UNION ALL SELECT 'parent_min', min(char_count) FROM pw
  UNION ALL SELECT 'parent_max', max(char_count) FROM pw UNION ALL SELECT 'parent_median', median(char_count) FROM pw UNION ALL SELECT 'parents', count(*) FROM pw UNION ALL SELECT 'oversized_parents', count(*) FROM pw WHERE oversize
  UNION ALL SELECT 'children', count(*) FROM ch UNION ALL SELECT 'ambiguous', count(*) FILTER (ambiguous) FROM ch UNION ALL SELECT 'warnings', sum(CASE WHEN warnings = '' THEN 0 ELSE len(string_split(warnings, '; ')) END) FROM ch""",
    "html_chunks": f"WITH {_HTML} SELECT doc_id, number, chunk_id, md5(text) AS digest FROM hc",
    "chunk_edges": f"""WITH {_HTML}, o AS (SELECT *, lag(chunk_id) OVER w AS p, first_value(chunk_id) OVER w AS f, row_number() OVER w AS r FROM hc WINDOW w AS (PARTITION BY doc_id ORDER BY number, chunk_id))
  SELECT p AS src, chunk_id AS dst, 'NEXT' AS kind FROM o WHERE p IS NOT NULL UNION ALL SELECT f, chunk_id, 'PARENT_OF' FROM o WHERE r > 1""",
    "citations": r"""SELECT DISTINCT chunk_id, '[Nguồn: ' || source || ', ' || pages || ', chunk: ' || chunk_id || ']' AS display, pages, number, coalesce(nullif(concat_ws(' › ', structure.chapter, structure.section, structure.article, structure.clause, structure.point), ''), '—') AS path,
  regexp_replace(source, '(.)\.[^.]*$', '\1') || ':' || strategy || ':' || lpad(number::VARCHAR, greatest(4, length(number::VARCHAR))::INT, '0') AS made_id, '[E1] Nguồn: ' || source || ' (p.' || page_start || '-' || page_end || ') - Rerank Score: 0.50' AS short_display
  FROM (SELECT *, coalesce(try_cast(nullif(regexp_extract(chunk_id, ':([0-9]+)$', 1), '') AS BIGINT), 0) AS number, CASE WHEN page_start = page_end THEN 'tr. ' || page_start ELSE 'tr. ' || page_start || '-' || page_end END AS pages FROM chunks WHERE page_start IS NOT NULL AND page_end IS NOT NULL AND source IS NOT NULL)""",
    "variant_filter": rf"""WITH d AS (SELECT doc_id, title FROM documents WHERE title IS NOT NULL), b AS (SELECT doc_id AS query_id, {SQUEEZED.format('title')} AS q0 FROM d WHERE doc_id % 100 = 0),
  c AS (SELECT floor(doc_id / 100) * 100 + 100 AS query_id, doc_id AS n, {SQUEEZED.format('title')} AS text FROM d),
  k AS (SELECT c.query_id::BIGINT AS query_id, n, text, replace(lower(text), 'ß', 'ss') AS folded FROM c JOIN b USING (query_id) WHERE text <> '' AND length(text) <= 300 AND replace(lower(text), 'ß', 'ss') <> replace(lower(q0), 'ß', 'ss')
    AND len(list_filter(regexp_extract_all(lower(text), 'điều\s+\d+'), lambda x: NOT list_contains(regexp_extract_all(lower(q0), 'điều\s+\d+'), x))) = 0),
  u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n) AS r FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY query_id, folded ORDER BY n) = 1))
  SELECT query_id, 'Q0' AS variant_id, q0 AS text FROM b UNION ALL SELECT query_id, 'Q' || r, text FROM u WHERE r < 4""",
    "wiki_checks": f"""WITH {_WIKI} SELECT 'files' AS check_name, count(*) AS n FROM nt UNION ALL SELECT 'links', count(*) FROM lk UNION ALL SELECT 'broken_links', count(*) FROM lk WHERE dst NOT IN (SELECT note FROM nt)
  UNION ALL SELECT 'duplicate_ids', count(*) FROM (SELECT id FROM law_metadata WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'unknown_ids', count(*) FROM laws WHERE id LIKE '%3' AND 'X' || id NOT IN (SELECT id FROM laws)
  UNION ALL SELECT 'unknown_sources', count(*) FROM rl WHERE s NOT IN (SELECT id FROM laws) UNION ALL SELECT 'unknown_targets', count(*) FROM rl WHERE t NOT IN (SELECT id FROM laws)
  UNION ALL SELECT 'without_SUA_DOI_BO_SUNG', count(*) FROM laws WHERE id NOT IN (SELECT t FROM rl WHERE k = 'SUA_DOI_BO_SUNG') UNION ALL SELECT 'without_CAN_CU', count(*) FROM laws WHERE id NOT IN (SELECT s FROM rl WHERE k = 'CAN_CU')
  UNION ALL SELECT 'orphans', count(*) FROM laws WHERE id NOT IN (SELECT src FROM lk) AND id NOT IN (SELECT dst FROM lk) UNION ALL SELECT 'orphans_without_home', count(*) FROM laws WHERE id NOT IN (SELECT src FROM lk) AND id NOT IN (SELECT dst FROM lk WHERE src <> 'Home')""",
    "formatted_values": r"""SELECT c_custkey, format('{:,.0f}', c_acctbal * 1000) || ' VNĐ' AS balance, c_name || ' VNĐ' AS no_number, CASE WHEN trim(c_name) IN ('', c_custkey::VARCHAR) THEN c_custkey::VARCHAR ELSE c_custkey || ' - ' || trim(c_name) END AS title,
  trim(translate(c_name || ':"?', '<>:"/\\|?*', '_________')) AS file, c_name || ' ==[IN]==> ' || c_mktsegment AS label FROM customer""",
}
