"""Property-graph operators on node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.security import may_see
from lamina.session import cut_lineage


def merge_nodes(stored: DataFrame, incoming: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Upsert on the key: listed properties are overwritten where given, others are kept.

    Of several incoming rows of a key the last by `order` (then by all columns) counts."""
    by = [F.desc(order)] if order else []
    w = Window.partitionBy(key).orderBy(*by, *[F.desc_nulls_last(c) for c in incoming.columns if c != key])
    new = incoming.filter(F.col(key).isNotNull()).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    a, b = stored.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    names = [*stored.columns, *[c for c in incoming.columns if c not in stored.columns]]
    pick = lambda c: F.coalesce(*[F.col(f"{side}.{c}") for side, df in (("b", new), ("a", stored)) if c in df.columns])
    return joined.select(*[pick(c).alias(c) for c in names])


def merge_edges(edges: DataFrame, nodes: DataFrame, src: str, dst: str, kind: str, node: str = "id") -> DataFrame:
    """Distinct edges with `status`: merged, or which endpoint is missing.  Dropped edges are told, not lost silently."""
    ids = nodes.select(F.col(node).alias("__id")).distinct()
    one = edges.select(src, kind, dst).distinct()
    joined = one.join(ids.withColumnRenamed("__id", "__a"), F.col(src) == F.col("__a"), "left").join(ids.withColumnRenamed("__id", "__b"), F.col(dst) == F.col("__b"), "left")
    status = F.when(F.col("__a").isNull() & F.col("__b").isNull(), "both_missing").when(F.col("__a").isNull(), "source_missing").when(F.col("__b").isNull(), "target_missing").otherwise("merged")
    return joined.select(src, kind, dst, status.alias("status"))


def neighbours(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Each edge in both directions."""
    return edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).unionByName(edges.select(F.col(dst).alias("a"), F.col(src).alias("b"))).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()


def reach(seeds: DataFrame, edges: DataFrame, hops: int, directed: bool = False, src: str = "src", dst: str = "dst") -> DataFrame:
    """(seed, node, depth): nodes within `hops` of each seed, the seed left out, at their least depth.

    One join a hop; the frontier holds new nodes only, and each hop's is stored, so the plan does not grow with the hops.
    A hub's edges are one large key of that join: AQE splits it, as neither side is aggregated before."""
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct() if directed else neighbours(edges, src, dst)
    pairs = cut_lineage(pairs) if hops > 1 else pairs
    frontier = seen = seeds.select(F.col("seed"), F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct()
    for depth in range(1, hops + 1):
        step = frontier.join(pairs, F.col("node") == F.col("a")).select("seed", F.col("b").alias("node")).distinct()
        frontier = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth))
        frontier = cut_lineage(frontier) if depth < hops else frontier
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def touching(edges: DataFrame, ids: DataFrame, src: str, dst: str) -> DataFrame:
    """Edges with either end among the ids: two equi-joins and a distinct, not one join on an OR."""
    one = ids.select(F.col("id").alias("__i")).distinct()
    a = edges.join(one, F.col(src) == F.col("__i"), "left_semi")
    b = edges.join(one, F.col(dst) == F.col("__i"), "left_semi")
    return a.unionByName(b).distinct()


def allowed_edges(edges: DataFrame, nodes: DataFrame, src: str, dst: str, roles: list[str], key: str = "id", column: str = "roles") -> DataFrame:
    """Edges both of whose ends the roles may see; `nodes` has an array of roles per key."""
    seen = nodes.filter(may_see(column, roles)).select(F.col(key).alias("__k")).distinct()
    one = edges.join(seen, F.col(src) == F.col("__k"), "left_semi")
    return one.join(seen, F.col(dst) == F.col("__k"), "left_semi")


def next_hop(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, id, next_id): the chunk after each hit; `hits` has query_id and id, `edges` are NEXT edges (src, dst)."""
    return hits.select("query_id", "id").join(edges, F.col("id") == F.col("src")).select("query_id", "id", F.col("dst").alias("next_id"))


def wipe(graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of a graph without their rows; writing them over the stored ones wipes it."""
    return {name: df.limit(0) for name, df in graph.items()}


def first_of_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def chain(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two-edge paths (x, y, z) over (src, dst) tables."""
    return a.select(F.col("src").alias("x"), F.col("dst").alias("y")).join(b.select(F.col("src").alias("y"), F.col("dst").alias("z")), "y").select("x", "y", "z")
