"""Connected components of a graph given as pairs, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, root) that connect what the links a[k]-b[k] among nodes 0..n-1 connect; at most n - 1 of them, root < i."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b = a[differ], b[differ]
        low, high = np.minimum(ra, rb)[differ], np.maximum(ra, rb)[differ]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    i = np.flatnonzero(root != np.arange(n))
    return i, root[i]


#: Rows of one key that a task joins: at least so many, or this share of all; more are few keys, whose values are broadcast.
TASK_ROWS, TASK_SHARE = 1024, 4096


def crowd(total: int) -> int:
    """Rows of one key beyond which it crowds a task; at most TASK_SHARE keys of so many rows have more."""
    return max(TASK_ROWS, -(-total // TASK_SHARE))


def look_up(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of many rows (total in number) with a table of one row a key, whose column n says how many rows ask.

    Values of keys with very many rows are broadcast, of which there are TASK_SHARE
    at most, so that no task has all rows of one.
    """
    limit = crowd(total)
    hot, cold = table.where(F.col("n") > limit).drop("n"), table.where(F.col("n") <= limit).drop("n")
    names = [c for c in hot.columns if c != key]
    marked = rows.join(F.broadcast(hot.withColumn("_vesper_hot", F.lit(True))), key, "left")
    rest = marked.where("_vesper_hot is null").drop("_vesper_hot", *names)
    return marked.where("_vesper_hot").drop("_vesper_hot").unionByName(rest.join(cold, key))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that edges (a, b) name.

    Every step groups with a map-side minimum, and hubs' minima are broadcast, so a
    hub's edges are spread over tasks; nothing is collected but two counters a round.
    Loops (a = b) and repeated edges do no harm; nulls are left out; an empty
    table has no nodes.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    pairs = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, total = None, 2 * pairs.count()
    for _ in range(rounds):
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = look_up(both, least, "u", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = look_up(large, least, "u", total).select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        pairs = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before, total = now, max(total, 2 * now.n)
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return nodes.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
