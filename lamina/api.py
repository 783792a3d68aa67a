"""Retrieval pipelines over any corpus, many questions at once.

`corpus` has id, source, page_start, page_end, text; `vectors` has id, embedding; `questions` has query_id,
question and, for dense search, vector; model outputs come as columns through the plug-ins given."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.config import Retrieval
from lamina.functions.text import citation, fold, secure_citation, squeeze, strip, tokens
from lamina.operators import answers, dense, fusion, graph, lexical, security
from lamina.session import cut_lineage, shared_folder
from lamina.sources.files import STRATEGIES

MODES = ("bm25", "semantic", "hybrid", "hybrid_rerank")
PARENT_MODES = ("single_flat", "multi_flat", "single_parent", "multi_parent")
SECURE_METHODS = ("bm25", "dense", "graph", "hybrid", "hybrid_rerank", "secure")
TRIED = 100  # questions of one pass of the graph method
Scorer = Callable[[DataFrame], DataFrame]


def question_problem(longest: int = 2000) -> Column:
    """Why a question can't be asked: empty, without a token, too long; null if it can."""
    text = strip(F.coalesce("question", F.lit("")))
    return F.when(text == "", "empty question").when(F.size(tokens(text)) == 0, "question without a token").when(F.length(text) > longest, "question too long")


def check_questions(questions: DataFrame, longest: int = 2000) -> DataFrame:
    """Questions trimmed; one that is blank, without a token or too long raises."""
    bad = question_problem(longest)
    return questions.filter(F.when(bad.isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(True)).withColumn("question", strip("question"))


def check_request(top_k: int, strategy: str) -> None:
    if isinstance(top_k, bool) or not isinstance(top_k, int) or not 1 <= top_k <= 20:
        raise ValueError("top_k must be a whole number from 1 to 20")
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")


def build_index(corpus: DataFrame, key: str = "id", text: str = "text") -> lexical.Index:
    """An index in the shared folder."""
    spark = corpus.sparkSession
    path = f"{shared_folder(spark)}/lamina-index-{uuid.uuid4().hex}"
    lexical.write_index(corpus, key, text, path)
    return lexical.read_index(spark, path)


class Retriever:
    """Flat and hierarchical retrieval.  rerank adds a column logit to rows with query_id, question, id, text.

    `parents` (for the hierarchical modes) has id, parent_id, source, page_start, page_end, text, ambiguous_count: a row per
    child, with what holds for its parent.  `manifest` is checked against what the vectors were stored with."""

    def __init__(
        self, corpus: DataFrame, vectors: DataFrame | None = None, config: Retrieval | None = None, rerank: Scorer | None = None, parents: DataFrame | None = None,
        index: lexical.Index | None = None, manifest: tuple[dict, dict] | None = None,
    ) -> None:
        self.corpus, self.vectors, self.config, self.rerank, self.parents = corpus, vectors, config or Retrieval(), rerank, parents
        self._index, self.manifest = index, manifest

    @cached_property
    def index(self) -> lexical.Index:
        """Written at the first lexical search and read by all later ones."""
        return self._index or build_index(self.corpus)

    def bm25_search(self, questions: DataFrame, k: int | None = None) -> DataFrame:
        return lexical.bm25_top_k(self.index, questions, k or self.config.bm25_candidates)

    def semantic_search(self, questions: DataFrame, k: int | None = None) -> DataFrame:
        """Nearest rows; an empty store gives none."""
        if self.vectors is None:
            raise ValueError("dense search needs vectors")
        if self.manifest:
            dense.check_manifest(*self.manifest)
        return dense.dense_top_k(self.vectors, questions.select("query_id", "vector"), k or self.config.semantic_candidates, "id")

    def hybrid_search(self, questions: DataFrame) -> DataFrame:
        c = self.config
        lex = self.bm25_search(questions) if c.bm25_weight else None
        near = self.semantic_search(questions) if c.semantic_weight else None
        shared = tuple(x for x in ("text", "source", "page_start", "page_end") if self.vectors is not None and x in self.vectors.columns)
        if shared and lex is not None and near is not None:
            lex = lex.join(self.corpus.select("id", *shared), "id")
            near = near.join(self.vectors.select("id", *shared), "id")
            return fusion.fuse_two(lex, near, c.rrf_k, (c.bm25_weight, c.semantic_weight), shared).drop(*shared)
        return fusion.fuse_two(lex, near, c.rrf_k, (c.bm25_weight, c.semantic_weight))

    def rerank_candidates(self, candidates: DataFrame, questions: DataFrame) -> DataFrame:
        if self.rerank is None:
            raise ValueError("reranker_unavailable")
        rows = candidates.filter(F.col("fused_rank") <= self.config.rerank_candidates).join(self.corpus.select("id", "text"), "id").join(questions.select("query_id", "question"), "query_id")
        scored = self.rerank(rows).drop("text", "question")
        return fusion.rerank(scored, "logit", self.config.rerank_candidates, self.config.final_top_k)

    def evidence(self, questions: DataFrame, mode: str) -> DataFrame:
        """Ranked rows of a mode with `accepted`: query_id, id, rank, accepted.

        Rows of mode bm25 have no distance, so none of them passes the gate of the set."""
        c = self.config
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if mode == "bm25":
            rows = fusion.gate_set(self.bm25_search(questions, c.final_top_k).withColumn("distance", F.lit(None).cast("double")), most=c.max_distance)
        elif mode == "semantic":
            rows = fusion.gate_rows(self.semantic_search(questions, c.final_top_k), "distance", most=c.max_distance)
        elif mode == "hybrid":
            fused = self.hybrid_search(questions)
            rows = fusion.gate_set(fused.filter(F.col("fused_rank") <= c.final_top_k).withColumn("rank", F.col("fused_rank")), most=c.max_distance)
        else:
            rows = fusion.gate_rows(self.rerank_candidates(self.hybrid_search(questions), questions).withColumn("rank", F.col("rerank_rank")), "rerank_score", least=c.min_rerank_score)
        return rows.select("query_id", "id", "rank", "accepted")

    def query_pipeline(self, questions: DataFrame, mode: str, generate: Scorer | None = None) -> DataFrame:
        """One row per question: n_evidence, n_accepted, prompt, answer with citations, n_warnings, status.

        A question that can't be asked has status retrieval_error; without a reranker all of mode hybrid_rerank have
        reranker_unavailable and the fused rows as evidence.  generate takes rows with query_id and prompt, only those
        with accepted evidence, and adds answer; none or a blank one gives retrieval_only."""
        checked = questions.withColumn("__problem", question_problem())
        wrong, asked = checked.filter("__problem IS NOT NULL"), checked.filter("__problem IS NULL").drop("__problem").withColumn("question", strip("question"))
        lacking = mode == "hybrid_rerank" and self.rerank is None
        if lacking:
            top = self.hybrid_search(asked).filter(F.col("fused_rank") <= self.config.final_top_k)
            ranked = top.select("query_id", "id", F.col("fused_rank").alias("rank"), F.lit(False).alias("accepted"))
        else:
            ranked = self.evidence(asked, mode)
        shown = ranked.join(self.corpus, "id").withColumn("display", citation("source", "page_start", "page_end", F.col("id").cast("string")))
        accepted = answers.labelled(shown.filter("accepted"))
        prompts = answers.prompts(accepted, asked)
        counted = shown.groupBy("query_id").agg(F.count("*").alias("n_evidence"), F.count_if("accepted").alias("n_accepted"))
        rows = asked.select("query_id").join(counted, "query_id", "left").fillna(0).join(prompts, "query_id", "left")
        if generate is None:
            rows = rows.select("*", F.lit(None).cast("string").alias("answer"), F.lit("").alias("citations"), F.lit(0).alias("n_warnings"))
        else:
            cited = answers.cite(generate(prompts).select("query_id", "answer"), accepted.select("query_id", "label", "display"))
            rows = rows.join(cited, "query_id", "left").fillna("", ["citations"]).fillna(0, ["n_warnings"])
        none = F.trim(F.coalesce("answer", F.lit(""))) == ""
        status = F.lit("reranker_unavailable") if lacking else F.when(F.col("n_accepted") == 0, "insufficient_evidence").when(none, "retrieval_only").otherwise("answered")
        rows = rows.withColumn("status", status)
        said = F.when(F.col("status") == "insufficient_evidence", answers.NO_EVIDENCE).when(F.col("status") == "retrieval_only", answers.NO_ANSWER).otherwise(F.coalesce("answer", F.lit("")))
        rows = rows.withColumn("answer", said)
        failed = wrong.select(
            "query_id", F.lit(0).cast("long").alias("n_evidence"), F.lit(0).cast("long").alias("n_accepted"), F.lit(None).cast("string").alias("prompt"),
            F.lit("").alias("answer"), F.lit("").alias("citations"), F.lit(1).alias("n_warnings"), F.lit("retrieval_error").alias("status"),
        )
        return rows.select(failed.columns).unionByName(failed)

    def compare(self, questions: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
        """Rank of each row under each mode."""
        parts = [self.evidence(questions, m).withColumn("mode", F.lit(m)) for m in modes]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return fusion.compare_modes(out, list(modes))

    def child_hits(self, variants: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Per variant the best children (query_id, variant_id, id, rank), and the variants that can't be asked."""
        c = self.config
        checked = variants.withColumn("__problem", question_problem())
        failures = checked.filter("__problem IS NOT NULL").select("query_id", "variant_id", F.col("__problem").alias("error"))
        good = checked.filter("__problem IS NULL").drop("__problem")
        keyed = good.withColumn("query_id", F.concat_ws("#", F.col("query_id").cast("string"), "variant_id"))
        hits = (self.hybrid_search(keyed) if self.vectors is not None else self.bm25_search(keyed).withColumn("fused_rank", F.col("rank"))).filter(F.col("fused_rank") <= c.per_query_candidates)
        back = good.select(F.concat_ws("#", F.col("query_id").cast("string"), "variant_id").alias("k"), F.col("query_id").alias("q"), "variant_id").distinct()
        return hits.join(back, F.col("query_id") == F.col("k")).select(F.col("q").alias("query_id"), "variant_id", "id", F.col("fused_rank").alias("rank")), failures

    def multi_query_child_search(self, variants: DataFrame) -> tuple[DataFrame, DataFrame]:
        """`variants` has query_id, variant_id, question (and vector): children fused over the variants, and each
        question's status.  A question whose Q0 failed has no children; other failures leave the rest."""
        c = self.config
        hits, failures = self.child_hits(variants)
        failures = cut_lineage(failures)
        lost = failures.filter("variant_id = 'Q0'").select("query_id")
        rows = hits.join(lost, "query_id", "left_anti").join(self.corpus.select("id", "text", "source"), "id")
        return fusion.fuse_many(rows, c.rrf_k, c.original_weight, c.variant_weight, ("text", "source")), fusion.multi_query_status(variants, failures)

    def parent_retrieve(self, children: DataFrame) -> DataFrame:
        """Parents of fused children within the context's budget, best first: parent_rank (from 1 after the budget), the ids of
        their children, source, pages, text, ambiguous, and whether the first alone exceeds the budget."""
        c = self.config
        if self.parents is None:
            raise ValueError("hierarchy_not_ready")
        scored = fusion.score_parents(children, self.parents, c.parent_rrf_k, c.parent_child_limit)
        about = self.parents.groupBy("parent_id").agg(*[F.first(x).alias(x) for x in ("source", "page_start", "page_end", "text", "ambiguous_count")])
        sized = scored.join(about, "parent_id").withColumn("n_chars", F.length("text"))
        kept = fusion.keep_within_budget(sized, c.context_max_chars, candidates=c.parent_candidates)
        rows = kept.join(sized.withColumn("parent_id", F.col("parent_id").cast("string")).drop("parent_rank"), ["query_id", "parent_id"])
        return rows.withColumnRenamed("context_rank", "parent_rank").withColumn("ambiguous", F.col("ambiguous_count") > 0).drop("ambiguous_count")

    def execute_pipeline(self, variants: DataFrame, mode: str, generate: Scorer | None = None) -> tuple[DataFrame, DataFrame]:
        """The ranked candidates, and one row per question: status, prompt, answer, n_accepted.

        single_flat and multi_flat rank children, single_parent and multi_parent parents; single modes use Q0 only.  The
        candidates are reranked on their whole text, the best final_parent_top_k gated by score and labelled P1 ..."""
        if mode not in PARENT_MODES:
            raise ValueError(f"mode must be one of {PARENT_MODES}")
        c = self.config
        used = variants if mode.startswith("multi") else variants.filter("variant_id = 'Q0'")
        children, states = self.multi_query_child_search(used)
        if mode.endswith("flat"):
            about = self.corpus.select("id", "page_start", "page_end")
            rows = children.join(about, "id").select(
                "query_id", F.col("id").alias("parent_id"), F.col("fused_rank").alias("parent_rank"), F.col("id").alias("anchor_id"), F.array("id").alias("supporting_ids"),
                "source", "page_start", "page_end", "text", F.lit(False).alias("ambiguous"),
            )
        else:
            kept = self.parent_retrieve(children)
            rows = kept.select("query_id", "parent_id", "parent_rank", "anchor_id", "supporting_ids", "source", "page_start", "page_end", "text", "ambiguous")
        asked = used.filter("variant_id = 'Q0'").select("query_id", "question")
        if self.rerank is None:
            out = asked.join(states, "query_id").select(
                "query_id", F.when(F.col("status") == "multi_query_failed", F.col("status")).otherwise("reranker_unavailable").alias("status"),
                F.lit(None).cast("string").alias("prompt"), F.lit(None).cast("string").alias("answer"), F.lit(0).cast("long").alias("n_accepted"),
            )
            return rows, out
        scored = self.rerank(rows.filter(F.col("parent_rank") <= c.parent_candidates).join(asked, "query_id").withColumn("id", F.col("parent_id"))).drop("question", "id")
        ranked = cut_lineage(fusion.rerank_parents(scored, "logit", c.parent_candidates, c.final_parent_top_k, c.min_rerank_score))
        accepted = answers.labelled(ranked.filter("accepted").withColumn("rank", F.col("rerank_rank")), "P")
        prompts = answers.parent_prompts(accepted, asked)
        counted = accepted.groupBy("query_id").agg(F.count("*").alias("n_accepted"))
        rows = states.join(counted, "query_id", "left").fillna(0, ["n_accepted"]).join(prompts, "query_id", "left")
        said = generate(prompts).select("query_id", "answer") if generate else None
        rows = rows.join(said, "query_id", "left") if said is not None else rows.withColumn("answer", F.lit(None).cast("string"))
        done = F.when(F.col("answer").isNull() & F.lit(generate is not None), "generation_failed").otherwise("success")
        status = F.when(F.col("status") == "multi_query_failed", F.col("status")).when(F.col("n_accepted") == 0, "insufficient_evidence").otherwise(done)
        return ranked.join(accepted.select("query_id", "parent_id", "label"), ["query_id", "parent_id"], "left"), rows.select("query_id", status.alias("status"), "prompt", "answer", "n_accepted")

    def compare_parent_modes(self, variants: DataFrame) -> DataFrame:
        """Per question and parent mode: status, accepted units, their sources and characters."""
        out = None
        for mode in PARENT_MODES:
            ranked, states = self.execute_pipeline(variants, mode)
            kept = ranked.filter("accepted") if "accepted" in ranked.columns else ranked.limit(0)
            counted = kept.groupBy("query_id").agg(
                F.count_distinct("parent_id").alias("unique_parents"), F.count_distinct("source").alias("unique_sources"), F.sum(F.length("text")).alias("context_chars"),
            )
            one = states.select("query_id", F.lit(mode).alias("mode"), "status").join(counted, "query_id", "left").fillna(0)
            out = one if out is None else out.unionByName(one)
        return out

    def search_context(self, questions: DataFrame, documents: DataFrame, edges: DataFrame, k: int = 3, hops: int = 1, most: int = 2) -> DataFrame:
        """Nearest chunks and, for each document within the hops of theirs, its first chunks by id as text.

        `documents` maps id to document; `edges` has src, dst.  Seeds are left out of the related documents."""
        direct = self.semantic_search(questions, k).join(documents, "id").select("query_id", "id", "document", F.lit(0).alias("hops"))
        if hops <= 0:
            return direct
        seeds = direct.select("query_id", "document").distinct()
        reached = graph.reach(seeds.select(F.col("document").alias("seed")), edges, hops)
        near = seeds.join(reached, F.col("document") == F.col("seed")).groupBy("query_id", F.col("node").alias("document")).agg(F.min("depth").alias("hops")).join(seeds, ["query_id", "document"], "left_anti")
        rows = near.join(documents, "document").withColumn("__g", F.concat_ws("#", F.col("query_id").cast("string"), F.col("document").cast("string")))
        few = graph.first_of_group(rows, "__g", [F.col("id").cast("string")], most)
        return direct.unionByName(few.select("query_id", "id", "document", "hops"))

    def compare_hops(self, questions: DataFrame, documents: DataFrame, edges: DataFrame, k: int = 3, hops: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
        """Contexts of every question under each number of hops: setting, and the columns of search_context."""
        out = None
        for h in hops:
            one = self.search_context(questions, documents, edges, k, h).withColumn("setting", F.lit(h))
            out = one if out is None else out.unionByName(one)
        return out


class SecureRetriever:
    """Retrieval in which a user's roles filter rows before they are ranked or reranked.

    `corpus` has id, title, so_ky_hieu, article, text and roles (array); malformed roles see nothing.  The statistics of
    lexical search are those of all rows."""

    def __init__(self, corpus: DataFrame, vectors: DataFrame | None = None, rerank: Scorer | None = None, candidates: int = 20, index: lexical.Index | None = None) -> None:
        self.corpus, self.vectors, self.rerank, self.candidates, self._index = corpus, vectors, rerank, candidates, index

    @cached_property
    def index(self) -> lexical.Index:
        return self._index or build_index(self.corpus)

    def _seen(self, roles: list[str]) -> DataFrame:
        return self.corpus.filter(security.may_see("roles", roles))

    def _containing(self, seen: DataFrame, questions: DataFrame, k: int) -> DataFrame:
        """Rows that hold a whole question in one of four fields, letter case aside.

        The questions go to each row as one array, TRIED at a time: a row passes on the questions it holds, so there is no
        pair of a row and a question but those that match."""
        asked = questions.select("query_id", fold(squeeze("question")).alias("word")).filter("word <> ''")
        numbered = asked.withColumn("part", F.floor((F.row_number().over(Window.orderBy("query_id")) - 1) / TRIED))
        parts = numbered.groupBy("part").agg(F.collect_list(F.struct("query_id", "word")).alias("qs"))
        fields = F.array(*[fold(F.coalesce(c, F.lit(""))) for c in ("title", "text", "so_ky_hieu", "article")])
        held = lambda q: F.exists("fields", lambda f: F.contains(f, q["word"]))
        met = seen.select("id", fields.alias("fields")).crossJoin(parts.select("qs")).select("id", F.explode(F.filter("qs", held)).alias("q"))
        return graph.first_of_group(met.select(F.col("q.query_id").alias("query_id"), "id"), "query_id", [F.asc("id")], k)

    def ranked(self, questions: DataFrame, roles: list[str], method: str, k: int = 5) -> DataFrame:
        """query_id, id, rank (and the scores of the method)."""
        if method not in SECURE_METHODS:
            raise ValueError(f"method must be one of {SECURE_METHODS}")
        seen = self._seen(roles)
        ids = seen.select("id")
        lex = lambda n: lexical.bm25_top_k(self.index, questions, n, ids)
        near = lambda n: dense.dense_top_k(self.vectors.join(ids, "id", "left_semi"), questions.select("query_id", "vector"), n, "id")
        if method == "bm25":
            return lex(k)
        if method == "dense":
            return near(k)
        if method == "graph":
            return self._containing(seen, questions, k).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("id")))
        fused = fusion.fuse_two(lex(self.candidates), near(self.candidates), secure=True)
        if method == "hybrid":
            return fused.filter(F.col("fused_rank") <= k).withColumn("rank", F.col("fused_rank"))
        if self.rerank is None:
            raise ValueError("reranker_unavailable")
        scored = self.rerank(fused.join(seen.select("id", "text"), "id").join(questions.select("query_id", "question"), "query_id"))
        return fusion.rerank(scored.drop("text", "question"), "logit", self.candidates, k).withColumn("rank", F.col("rerank_rank"))

    def retrieve(self, questions: DataFrame, roles: list[str], method: str, k: int = 5) -> DataFrame:
        """query_id, id, rank and a citation; no roles, no rows."""
        shown = self._seen(roles).select("id", secure_citation("so_ky_hieu", "title", "article", F.col("id").cast("string")).alias("display"))
        return self.ranked(questions, roles, method, k).select("query_id", "id", "rank").join(shown, "id").select("query_id", "id", "rank", "display")
