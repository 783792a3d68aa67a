"""Filling fixed-capacity containers with items (problem 7).

Items are dealt by hash into blocks of about BLOCK_WINDOWS containers' worth of
tokens.  Within a block Karmarkar-Karp multiway differencing builds the windows: the
two partial partitions with the largest imbalance are merged, largest part of one
onto smallest of the other, until one partition is left.  Where a window exceeds the
capacity the number of windows rises and the block is differenced again.

Defined cases: an item above the capacity is divided into full containers of its own
and a rest that is packed like any item; an item of no tokens (null or empty text)
goes into a block's first container at no cost; equal sizes are ordered by item key,
so results are repeatable; an item without a key is packed like any other; repeated
rows are items of their own; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_WINDOWS = 96


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp over `windows` parts: the indexes of each part, near-equal in sum.

    A partial partition keeps only its non-empty parts, as (sum, node) in rising order; node is an
    index or a pair of nodes, unfolded at the end."""
    if windows < 1:
        raise ValueError("at least one window is needed")
    if windows == 1:
        return [list(range(len(sizes)))]
    heap = [(-s, i, [(s, i, i)], 0) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a, _ = heapq.heappop(heap)
        _, _, b, _ = heapq.heappop(heap)
        spare = windows - len(a) - len(b)
        if spare >= 0:
            parts = sorted(a + b)
        else:
            # -spare parts must be shared: the smallest of a meet the largest-first order of b
            meet = -spare
            short, long = (a, b) if len(a) <= len(b) else (b, a)
            # with both padded by empty parts to `windows`, rank r of one meets rank windows-1-r of the other
            parts = []
            n, m = len(long), len(short)
            for r in range(m):
                j = windows - 1 - (windows - m + r)  # rank of the partner counted from the smallest of `windows`
                k = j - (windows - n)
                s, key, node = short[r]
                if k >= 0:
                    t, other, tree = long[k]
                    parts.append((s + t, min(key, other), (node, tree)))
                else:
                    parts.append(short[r])
            used = {windows - 1 - (windows - m + r) - (windows - n) for r in range(m)}
            parts += [long[k] for k in range(n) if k not in used]
            assert len(parts) == n + m - meet
            parts.sort(key=lambda p: (p[0], p[1]))
        low = parts[0][0] if len(parts) == windows else 0
        heapq.heappush(heap, (-(parts[-1][0] - low), serial, parts, 0))
        serial += 1
    out = []
    for _, _, node in heap[0][2] if heap else []:
        flat, todo = [], [node]
        while todo:
            x = todo.pop()
            todo.extend(x) if isinstance(x, tuple) else flat.append(x)
        out.append(sorted(flat))
    return out + [[] for _ in range(windows - len(out))]


def pack_block(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most `capacity`, as few as differencing reaches when the count only rises."""
    total, largest = sum(sizes), max(sizes, default=0)
    if largest > capacity:
        raise ValueError("an item exceeds the capacity")
    windows = max(1, math.ceil(total / capacity))
    while True:
        parts = difference(sizes, windows)
        worst = max((sum(sizes[i] for i in p) for p in parts), default=0)
        if worst <= capacity:
            return [p for p in parts if p] or [[]]
        windows += max(1, math.ceil(windows * (worst - capacity) / capacity / 8))


def pack_items(items: DataFrame, profiles: DataFrame, key: str = "doc_id", size: str = "n_tokens", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Containers for every item and profile: profile, capacity_tokens, container_id, key, part_no, token_start, n_tokens.

    `items` has one row per key.  A block holds about block_windows * capacity tokens whatever the
    table's size, so tasks stay alike; only one number per profile, the total, is looked up first."""
    base = items.select(F.col(key).cast("string").alias("__key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("__size"))
    totals = base.agg(F.sum("__size").alias("__total"))
    # totals has exactly one row, profiles has a row per container kind
    want = profiles.select("profile", F.col("capacity_tokens").cast("long").alias("capacity_tokens")).crossJoin(totals)
    want = want.withColumn("__blocks", F.greatest(F.lit(1), F.ceil(F.coalesce("__total", F.lit(0)) / (F.col("capacity_tokens") * block_windows))).cast("long"))
    rules = want.agg(F.collect_list(F.struct("profile", "capacity_tokens", "__blocks")).alias("__rules"))
    dealt = base.crossJoin(F.broadcast(rules)).select("__key", "__size", F.explode("__rules").alias("__r"))
    dealt = dealt.select(
        "__key", "__size", F.col("__r.profile").alias("profile"), F.col("__r.capacity_tokens").alias("capacity_tokens"),
        F.pmod(F.xxhash64("__key"), F.col("__r.__blocks")).alias("__block"),
    )
    schema = "profile string, capacity_tokens long, container_id string, __key string, part_no int, token_start long, n_tokens long"
    packed = dealt.groupBy("profile", "capacity_tokens", "__block").applyInPandas(_pack_group, schema)
    kind = dict(items.dtypes)[key]
    return packed.withColumn(key, F.col("__key").cast(kind)).drop("__key")


def _pack_group(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    profile, capacity, block = key[0], int(key[1]), int(key[2])
    rows, rest = [], []
    for k, s in sorted(zip(frame["__key"], frame["__size"].astype("int64"), strict=True), key=lambda x: (-x[1], x[0] is None, x[0] or "")):
        full = (s - 1) // capacity if s > capacity else 0
        for part in range(full):
            rows.append((profile, capacity, f"{profile}-{block}-{k}-{part}", k, part, part * capacity, capacity))
        rest.append((k, full, full * capacity, s - full * capacity))
    weighty = [r for r in rest if r[3] > 0]
    windows = pack_block([r[3] for r in weighty], capacity)
    for w, members in enumerate(windows):
        rows += [(profile, capacity, f"{profile}-{block}-w{w}", *weighty[i]) for i in members]
    rows += [(profile, capacity, f"{profile}-{block}-w0", *r) for r in rest if r[3] == 0]
    return pd.DataFrame(rows, columns=["profile", "capacity_tokens", "container_id", "__key", "part_no", "token_start", "n_tokens"])


def fill_report(packed: DataFrame) -> DataFrame:
    """Per profile: containers, the least number that could do, the greatest load and the share of space used."""
    loads = packed.groupBy("profile", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("load"))
    return loads.groupBy("profile", "capacity_tokens").agg(
        F.count("*").alias("containers"), F.ceil(F.sum("load") / F.first("capacity_tokens")).alias("least_containers"),
        F.max("load").alias("max_load"), F.round(F.sum("load") / (F.count("*") * F.first("capacity_tokens")), 4).alias("used_share"),
    )
