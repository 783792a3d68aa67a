"""Retrieval metrics over ranked rows and gold labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_question(ranked: DataFrame, gold: DataFrame, questions: DataFrame, k: int, by: tuple[str, ...] = (), n_gold: DataFrame | None = None) -> DataFrame:
    """Recall, reciprocal rank, DCG and nDCG at k of every question, and of every value of the columns `by`.

    `ranked`: query_id, id, rank and `by`; `gold`: query_id, id; `questions`: query_id and `by`.  A question without gold
    scores 0 and is marked out_of_scope.  Where `n_gold` (query_id, n_gold) has the number of labels, `gold` need hold none that is not ranked."""
    keys = ["query_id", *by]
    labels = gold.select("query_id", "id").distinct()
    n_gold = labels.groupBy("query_id").agg(F.count("*").alias("n_gold")) if n_gold is None else n_gold
    hits = ranked.filter(F.col("rank") <= k).join(labels, ["query_id", "id"]).groupBy(*keys).agg(
        F.count("*").alias("n_hit"), F.min("rank").alias("first_hit"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg")
    )
    rows = questions.select(*keys).distinct().join(n_gold, "query_id", "left").join(hits, keys, "left")
    n = F.coalesce("n_gold", F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(k))).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return rows.select(
        *keys, n.alias("n_gold"), (n == 0).alias("out_of_scope"),
        F.round(F.coalesce(F.try_divide(F.coalesce("n_hit", F.lit(0)), n), F.lit(0.0)), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first_hit"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce("dcg", F.lit(0.0)), 6).alias("dcg"),
        F.round(F.when(n == 0, 0.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / ideal), 6).alias("ndcg"),
    )


def dcg_helper(ranked: DataFrame, k: int) -> DataFrame:
    """nDCG at k against the best order of what was retrieved: query_id, dcg, ndcg.  `ranked` has query_id, rank, relevance."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "rank")
    rows = ranked.withColumn("__ideal", F.row_number().over(w))
    gain = lambda place: F.coalesce(F.sum(F.when(F.col(place) <= k, F.col("relevance") / F.log2(F.col(place) + 1))), F.lit(0.0))
    sums = rows.groupBy("query_id").agg(gain("rank").alias("dcg"), gain("__ideal").alias("best"))
    return sums.select("query_id", F.round("dcg", 6).alias("dcg"), F.round(F.coalesce(F.try_divide(F.col("dcg"), F.col("best")), F.lit(0.0)), 6).alias("ndcg"))


def parent_metrics(accepted: DataFrame, gold_parents: DataFrame, gold_children: DataFrame, questions: DataFrame) -> DataFrame:
    """Per question over all accepted evidence, without a cut: mrr, parent_recall, child_recall, context_chars.

    `accepted` has query_id, parent_id, rank (of the accepted), supporting_ids, text or n_chars; the gold tables have query_id and id."""
    chars = "n_chars" if "n_chars" in accepted.columns else F.length("text")
    parents = gold_parents.select("query_id", F.col("id").alias("parent_id"), F.lit(True).alias("good")).distinct()
    hit = accepted.join(parents, ["query_id", "parent_id"], "left").groupBy("query_id").agg(
        F.count_if("good").alias("hits"), F.min(F.when(F.col("good"), F.col("rank"))).alias("first"), F.sum(chars).alias("context_chars")
    )
    seen = accepted.select("query_id", F.explode("supporting_ids").alias("id")).distinct().join(gold_children.select("query_id", "id").distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("child_hits"))
    count = lambda df, name: df.select("query_id", "id").distinct().groupBy("query_id").agg(F.count("*").alias(name))
    rows = questions.select("query_id").distinct()
    for df in (hit, seen, count(gold_parents, "n_parents"), count(gold_children, "n_children")):
        rows = rows.join(df, "query_id", "left")
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return rows.select(
        "query_id", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), share("hits", "n_parents").alias("parent_recall"),
        share("child_hits", "n_children").alias("child_recall"), F.coalesce("context_chars", F.lit(0)).cast("long").alias("context_chars"),
    )


def means(rows: DataFrame, keys: list[str], latency: str | None = None) -> DataFrame:
    """Means by mode, over all questions and over those in scope; of a column of latencies also mean and upper median."""
    timed = [F.round(F.avg(latency), 6).alias("latency_mean")] if latency else []
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n_questions"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("recall", "mrr", "ndcg")],
        F.round(F.avg(F.when(~F.col("out_of_scope"), F.col("recall"))), 6).alias("in_scope_recall"), *timed,
    )
    return out.join(upper_median(rows, keys, latency, "latency_p50"), keys, "left") if latency else out


def upper_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The element at n // 2 of a group's sorted values, without gathering the group: by rank."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    ranked = df.filter(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(w.orderBy(value))).withColumn("__n", F.count("*").over(w))
    return ranked.filter(F.col("__r") == F.floor(F.col("__n") / 2) + 1).select(*keys, F.col(value).alias(name))
