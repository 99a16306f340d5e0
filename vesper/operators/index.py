"""Cluster-pruned indexes: centres with true radii, memberships, and conjunctive search through them.

An index of a channel is two tables: clusters(channel, cluster_id, centre, radius,
n) and members(channel, cluster_id, row_id). Any choice of centres gives right
results, as the radius is the greatest distance found: what lies in a cluster whose
distance less its radius is over the threshold can't be within the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .search import against

CHANNELS = ("meta", "cam", "btree", "embed")
#: Records that a tree of clusters is grown on at most; it has half as many leaves at most, of however many records.
SAMPLE = 1 << 16


@dataclass
class Tree:
    """Two-way splits by the nearer of two poles; children are nodes, or leaves as -1 - leaf."""

    poles: np.ndarray
    children: list[list[int]]
    centres: np.ndarray

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out = np.zeros(len(vectors), np.int64)
        todo = [(0, np.arange(len(vectors)))] if self.children else []
        while todo:
            node, rows = todo.pop()
            far = [np.bitwise_count(vectors[rows] ^ pole).sum(axis=1, dtype=np.int64) for pole in self.poles[node]]
            right = far[1] < far[0]
            for child, part in zip(self.children[node], (rows[~right], rows[right]), strict=True):
                if child < 0:
                    out[part] = -1 - child
                elif len(part):
                    todo.append((child, part))
        return out

    def merged(self, sizes: np.ndarray, least: int) -> np.ndarray:
        """By leaf the leaf that it becomes part of, so that each has at least so many records, or all are one."""
        to = np.arange(len(self.centres))
        held = [(0, 0)] * len(self.children)  # leaf and size of a node that is one leaf; size -1: it has several

        def of(child: int) -> tuple[int, int]:
            return (-1 - child, int(sizes[-1 - child])) if child < 0 else held[child]

        for node in range(len(self.children) - 1, -1, -1):  # children come after their parents
            (a, n), (b, m) = (of(c) for c in self.children[node])
            if n >= 0 and m >= 0 and min(n, m) < least:
                to[to == b] = a
                held[node] = (a, n + m)
            elif min(n, m) >= 0 or max(n, m) >= least or min(n, m) < 0 and max(n, m) < 0:
                held[node] = (-1, -1)
            else:
                # a small leaf beside a branch of several goes to the branch's first leaf
                small, branch = (a, self.children[node][1]) if n >= 0 else (b, self.children[node][0])
                while branch >= 0:
                    branch = self.children[branch][0]
                to[to == small] = to[-1 - branch]
                held[node] = (-1, -1)
        return to


def grow(sample: np.ndarray, records: int, least: int) -> Tree:
    """A tree on sample rows (words as int64) that stand for so many records, of leaves of at least `least` records, by that reckoning.

    The poles of a node are the row farthest from its first row, and the row farthest from that.
    """
    weight = records / max(1, len(sample))
    poles: list[np.ndarray] = []
    children: list[list[int]] = []
    centres: list[np.ndarray] = []
    todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(sample)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop(0)
        x = sample[rows]
        from_first = np.bitwise_count(x ^ x[0]).sum(axis=1, dtype=np.int64)
        a = x[int(from_first.argmax())]
        from_a = np.bitwise_count(x ^ a).sum(axis=1, dtype=np.int64)
        b = x[int(from_a.argmax())]
        right = np.bitwise_count(x ^ b).sum(axis=1, dtype=np.int64) < from_a
        if min(int(right.sum()), int((~right).sum())) * weight >= least and right.any():
            here = len(children)
            poles.append(np.stack([a, b]))
            children.append([0, 0])
            todo += [(rows[~right], here, 0), (rows[right], here, 1)]
        else:
            here = -1 - len(centres)
            # the row whose farthest is nearest, of a few
            few = x[: 64]
            apart = np.stack([np.bitwise_count(few ^ c).sum(axis=1, dtype=np.int64) for c in few]).max(axis=1)
            centres.append(few[int(apart.argmin())])
        if parent >= 0:
            children[parent][side] = here
    words = sample.shape[1]
    return Tree(np.stack(poles) if poles else np.zeros((0, 2, words), np.int64), children, np.stack(centres))


def _words(column) -> np.ndarray:
    values = column.flatten().to_numpy()
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def tree_members(records: DataFrame, channel: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(cluster_id, centre), and (channel, cluster_id, row_id, dist) of all records: leaves of a tree, each of at least `least` records.

    The tree is grown on SAMPLE records chosen by hash; every record goes down the
    tree, and leaves that turn out too small become part of their neighbours.
    Records without a vector are left out; an empty table has no cluster.
    """
    spark = records.sparkSession
    rows = records.where(F.col(channel).isNotNull()).select(F.col("row_id").cast("long").alias("row_id"), F.col(channel).alias("vector"))
    n = rows.count()
    kind = records.schema[channel].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"cluster_id int, centre {kind}"), spark.createDataFrame([], "channel string, cluster_id int, row_id bigint, dist bigint")
    sample = rows.orderBy(F.xxhash64("row_id"), "row_id").limit(SAMPLE).select("vector").toArrow()
    tree = grow(_words(sample.column(0).combine_chunks()), n, least)
    held = spark.sparkContext.broadcast(tree)

    def leaves(batches):
        for batch in batches:
            found = held.value.leaves(_words(batch.column(0)))
            kept, size = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(size.astype(np.int64))], names=["leaf", "n"])

    sizes = np.zeros(len(tree.centres), np.int64)
    for r in rows.select("vector").mapInArrow(leaves, "leaf bigint, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        sizes[r.leaf] = r.n
    to = tree.merged(sizes, least)
    own = spark.sparkContext.broadcast(to)

    def place(batches):
        for batch in batches:
            x = _words(batch.column(1))
            found = own.value[held.value.leaves(x)]
            far = np.bitwise_count(x ^ held.value.centres[found]).sum(axis=1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), batch.column(0), pa.array(far)], names=["cluster_id", "row_id", "dist"])

    placed = rows.mapInArrow(place, "cluster_id int, row_id bigint, dist bigint").select(F.lit(channel).alias("channel"), "cluster_id", "row_id", "dist")
    centres = spark.createDataFrame([(int(k), [int(w) for w in tree.centres[k]]) for k in np.unique(to)], f"cluster_id int, centre {kind}")
    return centres, placed


def assign(records: DataFrame, channel: str, centre_table: DataFrame) -> DataFrame:
    """(channel, cluster_id, row_id, dist): the nearest centre of each record, the first of equally near ones.

    The centres are one array in each task, which is sent to all; no pair is made for a row and a centre.
    """
    table = centre_table.agg(F.array_sort(F.collect_list(F.struct(F.col("cluster_id").cast("int").alias("cluster_id"), "centre"))).alias("_centres"))
    best = F.array_min(F.transform("_centres", lambda c: F.struct(V.hamming(c["centre"], F.col(channel)).alias("dist"), c["cluster_id"].alias("cluster_id"))))
    placed = records.select("row_id", channel).crossJoin(F.broadcast(table)).withColumn("_best", best)
    return placed.select(F.lit(channel).alias("channel"), F.col("_best.cluster_id").alias("cluster_id"), "row_id", F.col("_best.dist").alias("dist"))


def build_channel(records: DataFrame, channel: str, least: int = 64, centre_table: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(clusters, members) of a channel: by a tree of leaves of at least `least` records, or by the nearest of given centres."""
    if centre_table is None:
        centre_table, members = tree_members(records, channel, least)
    else:
        members = assign(records, channel, centre_table)
    sizes = members.groupBy("channel", "cluster_id").agg(F.max("dist").alias("radius"), F.count("*").alias("n"))
    return sizes.join(F.broadcast(centre_table), "cluster_id").select("channel", "cluster_id", "centre", "radius", "n"), members.select("channel", "cluster_id", "row_id")


def build(records: DataFrame, rows: int = 64, given: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Indexes of all four channels, as (clusters, members); clusters have at least `rows` records, or the centres given."""
    parts = [build_channel(records, c, rows, given[c] if given else None) for c in CHANNELS]
    return reduce(DataFrame.unionByName, [p[0] for p in parts]), reduce(DataFrame.unionByName, [p[1] for p in parts])


def overlapping(clusters: DataFrame, channel: str, query: Column, most: int) -> DataFrame:
    """Clusters of a channel that can hold a row within `most` of the query."""
    distance = V.hamming(F.col("centre"), query)
    return clusters.where(F.col("channel") == channel).withColumn("centre_dist", distance).where(F.greatest(F.col("centre_dist") - F.col("radius"), F.lit(0)) <= most)


def candidates(clusters: DataFrame, members: DataFrame, channel: str, query: Column, most: int) -> DataFrame:
    """Ids of the rows in overlapping clusters."""
    near = overlapping(clusters, channel, query, most).select("cluster_id")
    return members.where(F.col("channel") == channel).join(near, "cluster_id", "left_semi").select("row_id")


def insert(clusters: DataFrame, members: DataFrame, records: DataFrame, channel: str) -> tuple[DataFrame, DataFrame]:
    """The index of one channel with further records in their nearest clusters, whose radii grow as needed."""
    mine = clusters.where(F.col("channel") == channel)
    if mine.isEmpty():
        raise ValueError(f"the index of {channel} has no cluster to insert into; build it first")
    placed = assign(records, channel, mine.select("cluster_id", "centre"))
    grown = placed.groupBy("cluster_id").agg(F.max("dist").alias("more"), F.count("*").alias("added"))
    updated = mine.join(grown, "cluster_id", "left").select("channel", "cluster_id", "centre", F.greatest("radius", F.coalesce("more", "radius")).alias("radius"), (F.col("n") + F.coalesce("added", F.lit(0))).alias("n"))
    return clusters.where(F.col("channel") != channel).unionByName(updated), members.unionByName(placed.select("channel", "cluster_id", "row_id"))


def learn(clusters: DataFrame, members: DataFrame, records: DataFrame, update_meta: bool = False) -> tuple[DataFrame, DataFrame]:
    """Further records in the indexes of all channels but meta.

    As search begins with meta, such rows are found only after a rebuild;
    update_meta=True inserts them there, too.
    """
    for channel in CHANNELS if update_meta else CHANNELS[1:]:
        clusters, members = insert(clusters, members, records, channel)
    return clusters, members


def search(records: DataFrame, clusters: DataFrame, members: DataFrame, query: dict[str, Column], thresholds: tuple[int, int, int, int]) -> tuple[DataFrame, DataFrame]:
    """Hits (row_id and four distances) of one query, and one row of counters.

    Channel after channel: candidates of the index meet the survivors in a semi
    join, then their distances are computed. The sorted result is by embed
    distance and row id.
    """
    stats = []
    alive = records
    for i, channel in enumerate(CHANNELS):
        found = candidates(clusters, members, channel, query[channel], thresholds[i])
        fetched = alive.join(found, "row_id", "left_semi")
        stats.append(fetched.agg(F.count("*").alias("n")).select(F.lit(channel).alias("channel"), "n"))
        alive = fetched.withColumn(f"{channel}_dist", V.hamming(F.col(channel), query[channel])).where(F.col(f"{channel}_dist") <= thresholds[i])
    hits = alive.select("row_id", *[f"{c}_dist" for c in CHANNELS]).orderBy("embed_dist", "row_id")
    meta = clusters.where("channel = 'meta'")
    total = meta.agg(F.count("*").alias("fragments_total"))
    kept = overlapping(clusters, "meta", query["meta"], thresholds[0]).agg(F.count("*").alias("kept"))
    read = reduce(DataFrame.unionByName, stats).groupBy().pivot("channel", list(CHANNELS)).agg(F.first("n"))
    counters = total.crossJoin(kept).crossJoin(read).select("fragments_total", (F.col("fragments_total") - F.col("kept")).alias("fragments_pruned"), F.col("meta").alias("meta_scanned"), F.col("cam").alias("cam_fetched"), F.col("btree").alias("btree_fetched"), F.col("embed").alias("embed_fetched"))  # one row each
    return hits, counters


def search_many(records: DataFrame, clusters: DataFrame, members: DataFrame, queries: DataFrame, channel: str, most: int) -> DataFrame:
    """(query_id, row_id, dist) of a query set on one channel: pruned clusters by query, then rows by cluster."""
    asked = queries.select("query_id", F.col(channel).alias("q_vector"))
    near = against(clusters.where(F.col("channel") == channel), asked).where(F.greatest(V.hamming(F.col("centre"), F.col("q_vector")) - F.col("radius"), F.lit(0)) <= most).select("query_id", "q_vector", "cluster_id")
    # memberships of clusters that some query reaches, then their records only
    kept = members.where(F.col("channel") == channel).select("cluster_id", "row_id").join(near.select("cluster_id").distinct(), "cluster_id", "left_semi")
    rows = records.select("row_id", channel).join(kept, "row_id")
    return rows.join(near, "cluster_id").select("query_id", "row_id", V.hamming(F.col(channel), F.col("q_vector")).alias("dist")).where(F.col("dist") <= most)


def search_set(records: DataFrame, clusters: DataFrame, members: DataFrame, queries: DataFrame, thresholds: tuple[int, int, int, int]) -> tuple[DataFrame, DataFrame]:
    """Hits (query_id, row_id and four distances) of a query set, and a row of counters for each query.

    As `search`, channel after channel. Each row carries its clusters and each
    query the clusters that it reaches, so that only the first channel's
    candidates are paired and nothing is paired again.
    """
    asked = queries.select("query_id", *[F.col(c).alias(f"q_{c}") for c in CHANNELS])
    reach = asked
    for channel, most in zip(CHANNELS, thresholds, strict=True):
        pairs = against(clusters.where(F.col("channel") == channel), asked.select("query_id", F.col(f"q_{channel}").alias("q_vector")))
        near = pairs.where(F.greatest(V.hamming(F.col("centre"), F.col("q_vector")) - F.col("radius"), F.lit(0)) <= most)
        reach = reach.join(near.groupBy("query_id").agg(F.collect_list("cluster_id").alias(f"near_{channel}")), "query_id", "left")
    of_row = members.groupBy("row_id").pivot("channel", list(CHANNELS)).agg(F.first("cluster_id"))
    rows = records.join(of_row.select("row_id", *[F.col(c).alias(f"in_{c}") for c in CHANNELS]), "row_id")
    pairs = reach.withColumn("in_meta", F.explode("near_meta")).join(rows, "in_meta")
    alive = F.lit(True)
    read = []
    for channel, most in zip(CHANNELS, thresholds, strict=True):
        fetched = alive & F.coalesce(F.array_contains(f"near_{channel}", F.col(f"in_{channel}")), F.lit(False)) if channel != "meta" else alive
        read.append(F.count_if(fetched).alias(f"n_{channel}"))
        alive = fetched & (F.col(f"{channel}_dist") <= most)
    pairs = pairs.select("query_id", "row_id", *[f"{x}_{c}" for c in CHANNELS for x in ("near", "in")], *[V.hamming(F.col(c), F.col(f"q_{c}")).alias(f"{c}_dist") for c in CHANNELS])
    hits = pairs.where(alive).select("query_id", "row_id", *[f"{c}_dist" for c in CHANNELS])
    total = clusters.where("channel = 'meta'").agg(F.count("*").alias("fragments_total"))
    kept = reach.select("query_id", F.coalesce(F.size("near_meta"), F.lit(0)).alias("kept")).withColumn("kept", F.greatest("kept", F.lit(0)).cast("long"))
    found = kept.join(pairs.groupBy("query_id").agg(*read), "query_id", "left").fillna(0).crossJoin(total)  # total is one row
    counters = found.select("query_id", "fragments_total", (F.col("fragments_total") - F.col("kept")).alias("fragments_pruned"), F.col("n_meta").alias("meta_scanned"), F.col("n_cam").alias("cam_fetched"), F.col("n_btree").alias("btree_fetched"), F.col("n_embed").alias("embed_fetched"))
    return hits, counters
