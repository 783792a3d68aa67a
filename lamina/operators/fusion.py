"""Rank fusion, rerank, gates, and parents under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.scores import rrf_term, sigmoid


def _mismatch(differs: Column, value: Column) -> Column:
    """The value, or an error that names the id whose shared fields differ."""
    return F.when(differs, F.raise_error(F.concat(F.lit("metadata mismatch for "), F.col("id").cast("string"))).cast("double")).otherwise(value)


def fuse_two(
    lexical: DataFrame | None, dense: DataFrame | None, k: int = 60, weights: tuple[float, float] = (1.0, 1.0), payload: tuple[str, ...] = (), secure: bool = False
) -> DataFrame:
    """Reciprocal rank fusion of (query_id, id, rank[, score]) and (query_id, id, rank, distance).

    A side of weight 0 is left out of the plan.  Order: score, best rank, dense rank, lexical rank, id; with `secure`
    the score at six digits, then lexical rows in their order before dense ones.  The `payload` columns stand on
    both sides; where they differ for an id the fusion raises."""
    if min(weights) < 0 or max(weights) == 0:
        raise ValueError("weights must be 0 or more, one of them above 0")
    carry = F.struct(*payload) if payload else F.lit(None).cast("string")
    a = lexical.select("query_id", "id", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"), carry.alias("__pa")) if weights[0] else None
    b = dense.select("query_id", "id", F.col("rank").alias("semantic_rank"), "distance", carry.alias("__pb")) if weights[1] else None
    if a is None:
        both = b.withColumn("bm25_rank", F.lit(None).cast("int")).withColumn("bm25_score", F.lit(None).cast("double")).withColumn("__pa", F.col("__pb"))
    elif b is None:
        both = a.withColumn("semantic_rank", F.lit(None).cast("int")).withColumn("distance", F.lit(None).cast("double")).withColumn("__pb", F.col("__pa"))
    else:
        both = a.join(b, ["query_id", "id"], "full_outer")
    x, y = F.col("__pa"), F.col("__pb")
    score = F.round(rrf_term("bm25_rank", weights[0], k) + rrf_term("semantic_rank", weights[1], k), 6 if secure else 9)
    both = both.withColumn("rrf_score", _mismatch(x.isNotNull() & y.isNotNull() & ~x.eqNullSafe(y), score) if payload else score)
    both = (both.withColumn("__p", F.coalesce(x, y)).select("*", "__p.*").drop("__p") if payload else both).drop("__pa", "__pb")
    matched = F.array_compact(F.array(F.when(F.col("bm25_rank").isNotNull(), "bm25"), F.when(F.col("semantic_rank").isNotNull(), "semantic")))
    semantic, lex = F.asc_nulls_last("semantic_rank"), F.asc_nulls_last("bm25_rank")
    order = [lex, semantic] if secure else [F.least("bm25_rank", "semantic_rank"), semantic, lex]
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), *order, "id")
    return both.withColumn("matched_by", F.array_join(matched, "+")).withColumn("fused_rank", F.row_number().over(w))


def fusion_trace(fused: DataFrame) -> DataFrame:
    """Per question: candidates of either side, their union and overlap."""
    lex, semantic = F.col("bm25_rank").isNotNull(), F.col("semantic_rank").isNotNull()
    return fused.groupBy("query_id").agg(
        F.count_if(lex).alias("bm25_candidates"), F.count_if(semantic).alias("semantic_candidates"), F.count("*").alias("union_count"), F.count_if(lex & semantic).alias("overlap_count")
    )


def rerank(candidates: DataFrame, logit: str, take: int = 20, keep: int = 5) -> DataFrame:
    """The `take` best fused rows scored by the plugged-in logit column, the `keep` best of them kept."""
    top = candidates.filter(F.col("fused_rank") <= take).withColumn("rerank_score", F.round(sigmoid(logit), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "fused_rank", "id")
    ranked = top.withColumn("rerank_rank", F.row_number().over(w)).filter(F.col("rerank_rank") <= keep)
    return ranked.withColumn("rank_change", F.col("fused_rank") - F.col("rerank_rank"))


def gate_rows(df: DataFrame, column: str, most: float | None = None, least: float | None = None) -> DataFrame:
    """`accepted` row by row; a null is not accepted."""
    test = F.col(column) <= most if most is not None else F.col(column) >= least
    return df.withColumn("accepted", F.coalesce(test, F.lit(False)))


def gate_set(df: DataFrame, column: str = "distance", most: float = 0.45) -> DataFrame:
    """`accepted` for all rows of a question if any row passes."""
    passes = F.coalesce(F.col(column) <= most, F.lit(False))
    return df.withColumn("accepted", F.max(passes).over(Window.partitionBy("query_id")))


def _in_order(c: Column) -> Column:
    """Variant ids by number, Q0 first."""
    pairs = F.transform(F.array_distinct(c), lambda v: F.struct(F.regexp_extract(v, r"(\d+)$", 1).cast("int").alias("n"), v.alias("v")))
    return F.transform(F.array_sort(pairs), lambda x: x["v"])


def fuse_many(hits: DataFrame, k: int = 60, original: float = 1.5, variant: float = 1.0, payload: tuple[str, ...] = ()) -> DataFrame:
    """Weighted fusion over question variants: (query_id, variant_id, id, rank) to one row per (query_id, id).

    Q0 is the original.  Order: score, support, best rank, id.  Rows of one id whose `payload` columns differ raise."""
    weight = F.when(F.col("variant_id") == "Q0", F.lit(original)).otherwise(F.lit(variant))
    same = F.struct(*payload) if payload else F.lit(0)
    fused = hits.groupBy("query_id", "id").agg(
        F.round(F.sum(weight / (k + F.col("rank"))), 9).alias("score"), F.count_distinct("variant_id").alias("support"), _in_order(F.collect_set("variant_id")).alias("variants"),
        F.map_from_entries(F.collect_set(F.struct("variant_id", "rank"))).alias("ranks"), F.min("rank").alias("best_rank"), F.min(same).alias("__a"), F.max(same).alias("__b"),
    )
    fused = fused.withColumn("score", _mismatch(~F.col("__a").eqNullSafe(F.col("__b")), F.col("score"))) if payload else fused
    fused = fused.select("*", "__a.*") if payload else fused
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("support"), "best_rank", "id")
    return fused.drop("__a", "__b").withColumn("fused_rank", F.row_number().over(w))


def multi_query_status(variants: DataFrame, failures: DataFrame) -> DataFrame:
    """Per question: variants, how many failed, and the status: failed if the original did, partial if any other did.

    `variants` and `failures` have query_id and variant_id.  The children of a failed question are to be left out."""
    bad = failures.select("query_id", "variant_id", F.lit(True).alias("bad")).distinct()
    rows = variants.select("query_id", "variant_id").distinct().join(bad, ["query_id", "variant_id"], "left").groupBy("query_id").agg(
        F.count("*").alias("n_variants"), F.count_if("bad").alias("n_failed"), F.count_if(F.col("bad") & (F.col("variant_id") == "Q0")).alias("__q0")
    )
    status = F.when(F.col("__q0") > 0, "multi_query_failed").when(F.col("n_failed") > 0, "multi_query_partial").otherwise("multi_query_success")
    return rows.select("query_id", "n_variants", "n_failed", status.alias("status"))


def score_parents(children: DataFrame, registry: DataFrame, k: int = 60, cap: int = 3) -> DataFrame:
    """Parents by the reciprocal ranks of their `cap` best children.

    `children` has query_id, id, fused_rank, variants; `registry` has id, parent_id.  scoring_ids are the children that
    count, supporting_ids all of them, both in rank order; support_query_ids the variants of all.  A child without
    a parent raises."""
    joined = children.join(registry.select("id", "parent_id"), "id", "left")
    joined = joined.withColumn("parent_id", F.coalesce("parent_id", F.raise_error(F.concat(F.lit("no parent: "), F.col("id").cast("string")))))
    held = F.array_sort(F.collect_list(F.struct("fused_rank", "id", "variants")))
    rows = joined.groupBy("query_id", "parent_id").agg(held.alias("__c"))
    rows = rows.withColumn("__best", F.slice("__c", 1, cap))
    ids = lambda c: F.transform(c, lambda x: x["id"])
    scored = rows.select(
        "query_id", "parent_id", F.round(F.aggregate("__best", F.lit(0.0), lambda s, x: s + F.lit(1.0) / (k + x["fused_rank"])), 9).alias("parent_score"),
        F.element_at("__c", 1)["fused_rank"].alias("best_child_rank"), F.element_at("__c", 1)["id"].alias("anchor_id"), F.size("__c").alias("n_children"),
        ids("__best").alias("scoring_ids"), ids("__c").alias("supporting_ids"), _in_order(F.flatten(F.transform("__c", lambda x: x["variants"]))).alias("support_query_ids"),
    ).withColumn("n_variants", F.size("support_query_ids"))
    order = Window.partitionBy("query_id").orderBy(F.desc("parent_score"), F.desc("n_variants"), "best_child_rank", "parent_id")
    return scored.withColumn("parent_rank", F.row_number().over(order))


def keep_within_budget(parents: DataFrame, budget: int, size: str = "n_chars", candidates: int = 10) -> DataFrame:
    """Parents in rank order while they fit what is left of the budget, later smaller ones included.

    The first is always kept, with a warning if it alone exceeds the budget.  At most `candidates` rows per
    question are folded."""
    top = parents.filter(F.col("parent_rank") <= candidates)
    entry = F.struct("parent_rank", "parent_id", F.col(size).alias("size"))
    rows = top.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("__rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<parent_id:string,over:boolean>>").alias("kept"))

    def step(acc, x):
        first = F.size(acc["kept"]) == 0
        fits = first | (acc["used"] + x["size"] <= budget)
        item = F.array(F.struct(x["parent_id"].cast("string").alias("parent_id"), (first & (x["size"] > budget)).alias("over")))
        return F.when(fits, F.struct((acc["used"] + x["size"]).cast("long").alias("used"), F.concat(acc["kept"], item).alias("kept"))).otherwise(acc)

    folded = rows.select("query_id", F.aggregate("__rows", start, step).alias("f"))
    return folded.select("query_id", F.posexplode("f.kept").alias("__p", "k")).select(
        "query_id", (F.col("__p") + 1).alias("context_rank"), F.col("k.parent_id").alias("parent_id"), F.col("k.over").alias("first_exceeds_budget")
    )


def parent_trace(children: DataFrame, scored: DataFrame, kept: DataFrame, candidates: int = 10) -> DataFrame:
    """Per question: children, parents, parents dropped by the candidate limit and by the budget, characters of the
    children and of the kept parents, and how much the one expands the other (0 without children).

    `children` has query_id and text or n_chars, `scored` one row per parent, `kept` query_id and text or n_chars."""
    chars = lambda df: F.coalesce(F.sum("n_chars" if "n_chars" in df.columns else F.length("text")), F.lit(0))
    a = children.groupBy("query_id").agg(F.count("*").alias("n_children"), chars(children).alias("child_chars"))
    b = scored.groupBy("query_id").agg(F.count("*").alias("n_parents"))
    c = kept.groupBy("query_id").agg(F.count("*").alias("n_kept"), chars(kept).alias("parent_chars"))
    rows = a.join(b, "query_id", "left").join(c, "query_id", "left").fillna(0)
    factor = F.round(F.coalesce(F.try_divide(F.col("parent_chars"), F.col("child_chars")), F.lit(0.0)), 6)
    tried = F.least(F.col("n_parents"), F.lit(candidates))
    return rows.select(
        "query_id", "n_children", "n_parents", (F.col("n_parents") - tried).alias("dropped_by_limit"), (tried - F.col("n_kept")).alias("dropped_by_budget"),
        "child_chars", "parent_chars", factor.alias("expansion_factor"),
    )


def rerank_parents(parents: DataFrame, logit: str = "logit", candidates: int = 10, keep: int = 3, least: float = 0.5) -> DataFrame:
    """Parents (query_id, parent_id, parent_rank, a logit) by rerank score, with rank, rank change and `accepted`.

    The first `candidates` by parent rank take part; accepted are those among the `keep` best that reach `least`."""
    top = parents.filter(F.col("parent_rank") <= candidates).withColumn("rerank_score", F.round(sigmoid(logit), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "parent_rank", "parent_id")
    ranked = top.withColumn("rerank_rank", F.row_number().over(w)).withColumn("rank_change", F.col("parent_rank") - F.col("rerank_rank"))
    return ranked.withColumn("accepted", F.coalesce((F.col("rerank_rank") <= keep) & (F.col("rerank_score") >= least), F.lit(False)))


def compare_modes(rows: DataFrame, modes: list[str]) -> DataFrame:
    """One row per (query_id, id) with its rank under each mode."""
    return rows.groupBy("query_id", "id").pivot("mode", modes).agg(F.min("rank"))
