"""Mixing sources to target weights (problem 8).

Temperature mixing: the token shares of the sources are raised to an exponent and normalised.  With a reference
distribution r the weight is share ** (1 - e) * r ** e, so e = 0 keeps the natural shares and e = 1 gives r; with r
uniform this is plain temperature mixing, share ** (1 / T) with 1 / T = 1 - e.  The exponent is bisected
* to the target entropy asked for (temperature: r is uniform), or
* to the repetition limits (targets: r is the target shares): it falls from 1, where the targets are met, only as far as
  the token budget forces it to.  Without a budget the largest one that meets the targets within all limits is
  taken, so the exponent is 1.
The weights are realised as budgeted block permutations: whole passes over a source, then part of a pass in hashed order, cut by
prefix sums: over groups of blocks, over the blocks of a group, and within the one block that is cut, so no window holds
a whole source.

Defined cases: a document of no tokens or of a source without a target is not
selected; a source with a target but no tokens gets nothing and the rest share its
part; ties in the hash are broken by key; an entropy beyond what the sources allow gives the nearest; an empty table gives
an empty selection.
"""

from __future__ import annotations

import math

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, GROUP_BLOCKS = 2048, 4096


def tempered(shares: dict[str, float], reference: dict[str, float], e: float) -> dict[str, float]:
    """share ** (1 - e) * reference ** e, normalised."""
    raw = {s: x ** (1 - e) * reference[s] ** e for s, x in shares.items()}
    norm = sum(raw.values())
    return {s: x / norm for s, x in raw.items()}


def entropy(shares: dict[str, float]) -> float:
    return -sum(x * math.log(x) for x in shares.values() if x > 0)


def bisect(holds: Callable[[float], bool]) -> float:
    """The largest exponent from 0 to 1 for which `holds`, which must do so up to some exponent only; 0 if it never does."""
    if holds(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    return low


def flattened(tokens: dict[str, int], target: float) -> tuple[float, dict[str, float]]:
    """Exponent and weights of plain temperature mixing whose entropy is the target's: entropy rises with e up to uniform weights."""
    total = sum(tokens.values())
    natural = {s: n / total for s, n in tokens.items() if n > 0}
    if not natural:
        return 0.0, {}
    uniform = dict.fromkeys(natural, 1 / len(natural))
    e = bisect(lambda x: entropy(tempered(natural, uniform, x)) <= target)
    return e, tempered(natural, uniform, e)


def weights(tokens: dict[str, int], target: dict[str, float], repeats: dict[str, int], budget: float | None = None, spread: float | None = None) -> tuple[float, float, dict[str, float]]:
    """Token budget, exponent and normalised weight of each source; `spread` is an entropy to aim at in place of the targets.

    The number of sources is bounded by the table of targets; their token totals are all that is looked at."""
    have = {s: n for s, n in tokens.items() if n > 0 and target.get(s, 0) > 0 and repeats.get(s, 0) > 0}
    if not have:
        return 0.0, 1.0, {}
    total, whole = sum(have.values()), sum(target[s] for s in have)
    natural = {s: n / total for s, n in have.items()}
    aim = {s: target[s] / whole for s in have}
    fits = lambda w, size: all(w[s] * size <= have[s] * repeats[s] * (1 + 1e-12) for s in have)
    most = lambda w: min(have[s] * repeats[s] / w[s] for s in have)
    if spread is not None:
        e, w = flattened(have, spread)
        return min(most(w), budget if budget is not None else math.inf), e, w
    if budget is None:
        return most(aim), 1.0, aim
    budget = min(budget, max(most(aim), most(natural)))  # what no exponent can fill is not asked for
    e = bisect(lambda x: fits(tempered(natural, aim, x), budget))
    w = tempered(natural, aim, e)
    return min(budget, most(w)), e, w


def mix_sources(items: DataFrame, targets: DataFrame, key: str = "doc_id", size: str = "n_tokens", budget: float | None = None, spread: float | None = None, seed: int = 17) -> DataFrame:
    """The selection: source, key, copies (1 up to max_repeats), n_tokens of one copy.

    `items` has one row per key, with source and size.  The token totals of the sources that
    `targets` names (one row each) are the only values that reach the driver."""
    goal = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.select("source", "target_share", "max_repeats").collect()}
    base = items.select("source", F.col(key).alias("__key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n_tokens"))
    base = base.filter((F.col("n_tokens") > 0) & F.col("source").isin(list(goal)))
    counted = {r["source"]: (r["t"], r["n"]) for r in base.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    aim, _, share = weights({s: t for s, (t, _) in counted.items()}, {s: g[0] for s, g in goal.items()}, {s: g[1] for s, g in goal.items()}, budget, spread)
    plan = []
    for s, w in share.items():
        tokens, n = counted[s]
        whole, rest = divmod(round(w * aim), tokens)
        plan.append((s, int(whole), int(rest), max(1, math.ceil(n / BLOCK_ROWS))))
    spark = items.sparkSession
    rules = spark.createDataFrame(plan, "source string, __whole int, __rest long, __blocks int")
    # one row per source of the target table
    dealt = base.join(F.broadcast(rules), "source").withColumn("__order", F.xxhash64(F.lit(seed), "source", F.col("__key").cast("string")))
    dealt = dealt.withColumn("__block", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("__key").cast("string")), F.col("__blocks")))
    # a source's blocks are ordered by number (keys are dealt to them by hash); groups of them first, so that no window has many rows
    blocks = dealt.groupBy("source", "__block").agg(F.sum("n_tokens").alias("__sum")).withColumn("__group", F.floor(F.col("__block") / GROUP_BLOCKS))
    running = lambda *keys: Window.partitionBy("source", *keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = blocks.groupBy("source", "__group").agg(F.sum("__sum").alias("__all"))
    groups = groups.select("source", "__group", F.coalesce(F.sum("__all").over(running("__group")), F.lit(0)).alias("__start"))
    blocks = blocks.withColumn("__inner", F.coalesce(F.sum("__sum").over(running("__group", "__block")), F.lit(0))).join(groups, ["source", "__group"])
    blocks = blocks.select("source", "__block", (F.col("__start") + F.col("__inner")).alias("__before"))
    placed = dealt.join(blocks, ["source", "__block"])
    within = Window.partitionBy("source", "__block").orderBy("__order", "__key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("__upto", F.col("__before") + F.sum("n_tokens").over(within))
    # a document counts when more than half of it lies within the budget, which rounds the cut without bias
    extra = (F.col("__upto") - F.col("n_tokens") / 2 <= F.col("__rest")).cast("int")
    chosen = placed.withColumn("copies", F.col("__whole") + extra).filter("copies > 0")
    return chosen.select("source", F.col("__key").alias(key), "copies", "n_tokens")


def temperature_report(items: DataFrame, targets: DataFrame, budget: float | None = None, spread: float | None = None) -> DataFrame:
    """Per source that has tokens: its natural share, its weight and the passes over it that the budget asks for, with the exponent."""
    goal = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.select("source", "target_share", "max_repeats").collect()}
    counted = {r["source"]: r["t"] for r in items.filter(F.col("source").isin(list(goal))).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect() if r["t"]}
    size, e, w = weights(counted, {s: g[0] for s, g in goal.items()}, {s: g[1] for s, g in goal.items()}, budget, spread)
    total = sum(counted.values())
    rows = [(s, counted[s] / total, x, x * size / counted[s], goal[s][1], e, float(size)) for s, x in sorted(w.items())]
    return items.sparkSession.createDataFrame(rows, "source string, natural double, weight double, passes double, max_repeats int, exponent double, budget double")


def mix_report(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the targets: tokens selected, share reached, share aimed at, most copies of one document."""
    got = selection.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.max("copies").alias("max_copies"), F.count("*").alias("documents"))
    rows = targets.join(got, "source", "left").fillna(0, ["tokens", "max_copies", "documents"])
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return rows.withColumn("share", F.round(F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0)), 6)).select(
        "source", "target_share", "share", "max_repeats", "max_copies", "documents", "tokens"
    )
