"""Embedding near-duplicates by an inverted multi-index.

Two codebooks, one for each half of the vectors, span a grid of cells. Every
vector lies in its home cell and visits cells by the multi-sequence algorithm: of
the rows of the grid, each with a pointer to its next cell, the one of least sum of
the two squared distances advances. A vector's sequence ends at the first sum that
exceeds its home cell's by more than a reach, at which what lies further holds less
than 1 - recall of the vectors at exactly the least similarity. Where a visitor
meets a cell's vectors, cosines are computed in double precision. Equal vectors are
one row of the index; vectors of each length have an index of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest, look_up
from .session import bound_batches, cut
from .simhash import key_groups

#: Different vectors that codebooks are fitted on: at least, if there are, and for each code.
SAMPLE, CODE_ROWS = 8192, 16
#: Vectors of a cell that one task holds are two such blocks at most.
BLOCK = 2048
#: Vectors to a cell that the codebooks' size aims at, and the largest codebook: 16 million cells.
CELL_ROWS, CODES = 32, 4096
#: Vector lengths that have codebooks, the most frequent ones; those of another length are one cell, whose blocks meet pairwise.
LENGTHS = 64


def units(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision, without overflow."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


@dataclass
class Index:
    """Codebooks, and by how much a visited cell's cost may exceed the home cell's."""

    first: np.ndarray
    second: np.ndarray
    reach: float

    def costs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves to all codes."""
        half = self.first.shape[1]
        return _squared(x[:, :half], self.first), _squared(x[:, half:], self.second)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, whether it is the row's home) of all cells that rows visit, nearest first for each row."""
        a, b = self.costs(x)
        limit = a.min(axis=1) + b.min(axis=1) + self.reach
        order_a, a = _nearest(a, limit - b.min(axis=1))
        order_b, b = _nearest(b, limit - a[:, 0])
        b = np.concatenate([b, np.full((len(b), 1), np.inf)], axis=1)
        order_b = np.concatenate([order_b, order_b[:, :1]], axis=1)
        # all rows of x advance together, each in its own sequence
        rows, cells, home = [], [], []
        going = np.arange(len(x))
        after = np.zeros(a.shape, np.int64)  # by code of the first half: the second half's code that comes next
        while len(going):
            cost = a[going] + np.take_along_axis(b[going], after[going], 1)
            i = cost.argmin(axis=1)
            near = cost[np.arange(len(going)), i] <= limit[going]
            going, i = going[near], i[near]
            j = after[going, i]
            rows.append(going)
            cells.append(order_a[going, i] * len(self.second) + order_b[going, j])
            home.append((i == 0) & (j == 0))
            after[going, i] += 1
        return np.concatenate(rows), np.concatenate(cells), np.concatenate(home)

    def visits(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Whether each row visits the cell beside it."""
        a, b = self.costs(x)
        at = np.arange(len(x))
        return a[at, cell // len(self.second)] + b[at, cell % len(self.second)] <= a.min(axis=1) + b.min(axis=1) + self.reach


def _nearest(cost: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes in order of cost, and the costs, of as many codes as some row has within its most."""
    n = int((cost <= most[:, None]).sum(axis=1).max()) if len(cost) else 1
    n = max(n, 1)
    order = np.argpartition(cost, n - 1, axis=1)[:, :n] if n < cost.shape[1] else np.broadcast_to(np.arange(cost.shape[1]), cost.shape).copy()
    order.sort(axis=1)  # equal costs in order of code
    found = np.take_along_axis(cost, order, 1)
    by = np.argsort(found, axis=1, kind="stable")
    return np.take_along_axis(order, by, 1), np.take_along_axis(found, by, 1)


def _squared(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    # einsum, row by row: the same vector gets the same costs in any batch
    return np.einsum("ij,ij->i", codes, codes)[None, :] - 2 * np.einsum("ij,kj->ik", x, codes, optimize=False) + np.einsum("ij,ij->i", x, x)[:, None]


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means, started from different rows."""
    codes = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((codes**2).sum(1)[None, :] - 2 * x @ codes.T).argmin(axis=1)
        count = np.bincount(near, minlength=len(codes))
        sums = np.zeros_like(codes)
        np.add.at(sums, near, x)
        codes[count > 0] = sums[count > 0] / count[count > 0, None]
    return codes


def codes_for(rows: int) -> int:
    """Codes of each half for so many different vectors."""
    return int(np.clip(round((rows / CELL_ROWS) ** 0.5), 1, CODES))


def one_cell(size: int) -> Index:
    """An index of vectors of that length whose only cell is everyone's home."""
    half = max(1, size // 2)
    return Index(np.zeros((1, half)), np.zeros((1, size - half)), 1e-9)


def fit(sample: np.ndarray, rows: int, least: float, recall: float, seed: int = 0) -> Index:
    """Codebooks for so many rows, and the reach at which pairs of exactly the least cosine meet with that probability.

    The reach comes from the sample's vectors and random partners at that cosine:
    a pair meets if either visits the other's home.
    """
    rng = np.random.default_rng(seed)
    half = max(1, sample.shape[1] // 2)
    k = codes_for(rows)
    index = Index(_codebook(sample[:, :half], k, rng), _codebook(sample[:, half:], k, rng), 0.0)
    x = sample[rng.choice(len(sample), 4096)]
    noise = rng.standard_normal(x.shape)
    noise -= np.einsum("ij,ij->i", noise, x)[:, None] * x
    length = np.sqrt(np.einsum("ij,ij->i", noise, noise))[:, None]
    y = least * x + (1 - least**2) ** 0.5 * noise / np.maximum(length, 1e-300)
    excess = []
    for p, q in ((x, y), (y, x)):
        a, b = index.costs(p)
        c, d = index.costs(q)
        at = np.arange(len(p))
        excess.append(a[at, c.argmin(1)] + b[at, d.argmin(1)] - a.min(1) - b.min(1))
    index.reach = float(np.quantile(np.minimum(*excess), recall)) + 1e-9
    return index


def _met(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(x @ y.T >= least)


def link(distinct: DataFrame, indexes: dict[int, Index], dtype: str, least: float) -> DataFrame:
    """From (node, v, n): rows (a, b, links): links of node a to add; or, with links 0, a pair of a spanning forest of a cell's links.

    Each pair that meets is counted once for either node, in the home cell of one
    of the two: where both visit the other's home, that of the smaller node.
    indexes: by length of the vectors in bytes.
    """
    held = distinct.sparkSession.sparkContext.broadcast(indexes)
    width = np.dtype(dtype).itemsize
    indexed = lambda size: held.value.get(size) or one_cell(size // width)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy()
            for size in np.unique(sizes).tolist():
                same = batch.filter(pa.array(sizes == size))
                index = indexed(size)
                step = max(1, min(2048, (1 << 21) // len(index.first)))
                for lo in range(0, same.num_rows, step):
                    part = same.slice(lo, step)
                    rows, cells, home = index.cells(units(_rows(part.column(1), dtype)))
                    of = pa.array(rows)
                    own = np.zeros(part.num_rows, np.int64)
                    own[rows[home]] = cells[home]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), size, np.int32)), pa.array(cells), part.column(0).take(of), part.column(1).take(of), part.column(2).take(of), pa.array(own[rows])], names=["size", "cell", "node", "v", "n", "home"])

    dealt = distinct.select("node", "v", "n").mapInArrow(deal, "size int, cell bigint, node bigint, v binary, n bigint, home bigint")
    large = dealt.groupBy("size", "cell").agg(F.count("*").alias("rows"), F.count_if(F.col("home") == F.col("cell")).alias("own")).where("own > 0 and rows > 1").select("size", "cell", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    spread = dealt.join(large, ["size", "cell"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks")).cast("int"))
    spread = spread.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("size", "cell", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "v", "n", "home")
    spread = spread.repartition("size", "cell", "i", "j").sortWithinPartitions("size", "cell", "i", "j")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, cell, i, j, block, node, v, n, home in key_groups(batches, 4):
            index = indexed(int(size[0]))
            x = units(np.frombuffer(b"".join(v.tolist()), dtype).reshape(len(v), -1))
            own = home == cell[0]
            sides = [(own, own), (~own, own)] if i[0] == j[0] else [(own & (block == i[0]), own & (block == j[0])), (~own & (block == i[0]), own & (block == j[0])), (~own & (block == j[0]), own & (block == i[0]))]
            pairs_a, pairs_b = [], []
            for s, (left, right) in enumerate(sides):
                left, right = np.flatnonzero(left), np.flatnonzero(right)
                for lo in range(0, len(left), 512):
                    p, q = _met(x[left[lo : lo + 512]], x[right], least)
                    p, q = left[lo + p], right[q]
                    if s == 0:
                        keep = p < q if i[0] == j[0] else np.ones(len(p), bool)
                    else:
                        keep = (node[p] > node[q]) | ~index.visits(x[q], home[p])
                    pairs_a.append(p[keep])
                    pairs_b.append(q[keep])
            a, b = np.concatenate([np.zeros(0, np.int64), *pairs_a]), np.concatenate([np.zeros(0, np.int64), *pairs_b])
            if not len(a):
                continue
            add = np.bincount(a, n[b], len(node)) + np.bincount(b, n[a], len(node))
            some = np.flatnonzero(add)
            f, g = forest(a, b, len(node))
            out = [np.concatenate([node[some], node[f]]), np.concatenate([node[some], node[g]]), np.concatenate([add[some].astype(np.int64), np.zeros(len(f), np.int64)])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["a", "b", "links"])

    return spread.mapInArrow(meet, "a bigint, b bigint, links bigint")


def _rows(v: pa.Array, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(v.to_pylist()), dtype).reshape(len(v), -1)


def vectors(table: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """(id_col, v): the vectors' components as bytes, null for vectors that link with nothing; and the components' type."""
    double = table.schema[vector_col].dataType.elementType.simpleString() != "float"
    dtype = "<f8" if double else "<f4"
    kind = table.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)  # null components are NaN
            sizes = np.array([0 if s is None else s for s in pc.list_value_length(lists).to_pylist()], np.int64)
            ends = np.cumsum(sizes)
            good = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            some = np.concatenate([[0], np.cumsum(values != 0)])
            values = values + np.array(0, dtype)  # one zero: -0.0 is 0.0
            out = [values[e - s : e].tobytes() if s and good[e] == good[e - s] and some[e] > some[e - s] else None for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "v"])

    return table.select(id_col, F.col(vector_col).cast("array<double>" if double else "array<float>")).mapInArrow(run, f"`{id_col}` {kind}, v binary"), dtype


def near_duplicates(table: DataFrame, least: float = 0.95, recall: float = 0.99, seed: int = 0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of table: id_col, n_links, component_id, kept.

    Links are pairs of rows whose vectors are of one length and of a cosine of at
    least `least`; n_links counts the other rows linked, component_id is the
    smallest id reachable, kept whether that is the row's own. Vectors that are
    null, empty or zero, or hold null or non-finite components link with nothing.
    Rows without an id are linked and counted like others; rows that repeat keep a
    row each; an empty table has no rows. The index holds every row; the codebooks
    of a length come from at most SAMPLE different vectors, or CODE_ROWS for each
    code, chosen by hash.
    """
    bound_batches(table.sparkSession)
    rows, dtype = vectors(table, id_col, vector_col)
    rows = cut(rows.withColumn("node", F.xxhash64("v")))
    distinct = cut(rows.where("v is not null").groupBy("node", "v").agg(F.min(id_col).alias("rep"), F.count("*").alias("n")))
    width = np.dtype(dtype).itemsize
    sizes = distinct.groupBy(F.octet_length("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(LENGTHS).collect()
    indexes = {}
    for r in sizes:
        if codes_for(r["count"]) > 1:
            most = max(SAMPLE, CODE_ROWS * codes_for(r["count"]))
            sample = [x.v for x in distinct.where(F.octet_length("v") == r.size).orderBy(F.xxhash64("node"), "node").limit(most).select("v").collect()]
            indexes[r.size] = fit(units(np.frombuffer(b"".join(sample), dtype).reshape(len(sample), r.size // width)), r["count"], least, recall, seed)
    found = cut(link(distinct, indexes, dtype, least))
    counts = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    parts = components(found.where("links = 0").select("a", "b"))
    nodes = distinct.select("node", "rep", "n").join(counts, "node", "left").join(parts, "node", "left")
    nodes = cut(nodes.select("node", "rep", F.col("n").alias("rows"), F.coalesce("component", "node").alias("component"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links")))
    least_ids = nodes.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("n"))
    nodes = look_up(nodes, least_ids, "component", nodes.count()).select("node", "n_links", "least", F.col("rows").alias("n"))
    alone = rows.where("v is null").select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.col(id_col).isNotNull().alias("kept"))
    joined = look_up(rows.where("v is not null").select(id_col, "node"), nodes, "node", rows.count())
    component = F.coalesce("least", F.col(id_col))
    return joined.select(id_col, "n_links", component.alias("component_id"), F.coalesce(F.col(id_col) == component, F.lit(False)).alias("kept")).unionByName(alone)


#: DuckDB SQL of near_duplicates() at a cosine of 0.95 over the table embeddings, all pairs compared.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), usable AS (
  SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), components AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counts AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT c.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM components c LEFT JOIN counts USING (vec_id)
"""
