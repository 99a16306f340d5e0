"""SimHash near-duplicates: fingerprints, candidate search over segment popcounts, exact verification, components.

Every 64-bit fingerprint is embedded as the popcounts of 32 two-bit segments.
The Manhattan distance of two embeddings never exceeds the Hamming distance of
the fingerprints, so it is a lower bound. The segments are dealt to
``limit // 2 + 1`` groups, so that one group's distance must be at most one grid
step if the fingerprints are within the limit; each group's popcounts are a grid
cell, and a range join visits a cell and the cells one step up. Pairs that meet
in a cell are verified by exclusive or. Only a spanning forest of the links found
in a cell leaves it, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .components import components, forest, look_up
from .session import bound_batches, cut

#: Fingerprints that one task holds of a cell's two blocks at most.
BLOCK = 4096
#: Candidates that are verified at once.
PAIRS = 1 << 21


def fingerprints_of(texts: pa.Array, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """One unsigned 64-bit fingerprint for each text."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for first, end, data, offsets in K.blocks(texts):
        starts, ends, of = K.words(data, offsets, K.SPACED)
        if not len(starts):
            continue
        # one blank between words: shingles are then slices of the buffer
        lower = K.LOWER[data]
        sizes = ends - starts
        to = np.cumsum(sizes + 1) - sizes - 1
        joined = np.full(int(to[-1] + sizes[-1] + 1), 0x20, np.uint8)
        joined[np.repeat(to - starts, sizes) + np.flatnonzero(K.SPACED[data])] = lower[K.SPACED[data]]
        count = np.diff(of)
        n = np.where(count > 0, np.maximum(count - shingle + 1, 1), 0)
        upto = np.cumsum(n)
        start_word = np.repeat(of[:-1] - (upto - n), n) + np.arange(int(upto[-1]))
        last_word = np.minimum(start_word + shingle - 1, np.repeat(of[1:], n) - 1)
        raw = memoryview(joined.tobytes())
        hashes = np.fromiter((digest(raw[s:e], seed) for s, e in zip(to[start_word].tolist(), (to[last_word] + sizes[last_word]).tolist(), strict=True)), np.uint64, len(start_word))
        some = np.flatnonzero(n)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
        # runs of at most 255 bits are summed in bytes, then these sums by document
        begin = upto[some] - n[some]
        runs = -(-n[some] // 255)
        first_run = np.cumsum(runs) - runs
        at = np.repeat(begin, runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(first_run, runs))
        ones = np.add.reduceat(np.add.reduceat(bits, at, axis=0, dtype=np.uint8).astype(np.int64), first_run, axis=0)
        packed = np.packbits(2 * ones > n[some][:, None], axis=1)
        out[np.arange(first, end)[some]] = packed.view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id_col, fp): the fingerprint's 64 bits as a long for each row; a null or wordless text has 0."""
    schema = T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of(batch.column(1), shingle, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=[id_col, "fp"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def groups_for(limit: int, segments: int = 32) -> list[list[int]]:
    """Segments by group: with limit // 2 + 1 groups, one has a distance of at most one where the whole has at most limit."""
    n = limit // 2 + 1
    return [[*range(g * segments // n, (g + 1) * segments // n)] for g in range(n)]


def _cells(fp: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(cell, index of fingerprint, whether it is one step above the fingerprint's own cell)."""
    pairs = (fp[:, None] >> (np.uint64(2) * np.arange(32, dtype=np.uint64))) & np.uint64(3)
    pops = np.bitwise_count(pairs).astype(np.int64)
    for g, segments in enumerate(groups_for(limit)):
        # base 3 digits; a group of more than 38 segments can't occur
        weight = 3 ** np.arange(len(segments), dtype=np.int64)
        own = pops[:, segments] @ weight
        tag = np.int64(g) << np.int64(58)
        yield own + tag, np.arange(len(fp)), False
        for s, w in zip(segments, weight, strict=True):
            up = np.flatnonzero(pops[:, s] < 2)
            yield own[up] + w + tag, up, True


def _links(own: np.ndarray, other: np.ndarray, limit: int, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within limit bits, between own and other (or within own, each pair once)."""
    a, b = [], []
    step = max(1, PAIRS // max(1, len(other)))
    for lo in range(0, len(own), step):
        x, y = np.nonzero(np.bitwise_count(own[lo : lo + step, None] ^ other[None, :]) <= limit)
        if within:
            keep = x + lo < y
            x, y = x[keep], y[keep]
        a.append(x + lo)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def links(prints: DataFrame, limit: int = 4) -> DataFrame:
    """(a, b): pairs of distinct fingerprints (column fp) that connect all that are linked at limit or fewer differing bits.

    A spanning forest of each cell's links; a cell of more than BLOCK rows is cut
    into blocks that meet pairwise in tasks of their own, so no task holds an
    unbounded cell and no pair of blocks is left out.
    """
    if not 0 <= limit <= 31:
        raise ValueError("limit is 0 to 31 bits")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(fp), 1 << 14):
                part = fp[lo : lo + (1 << 14)]
                cells = [*_cells(part, limit)]
                cell, at = np.concatenate([c[0] for c in cells]), np.concatenate([c[1] for c in cells])
                up = np.concatenate([np.full(len(c[0]), c[2]) for c in cells])
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(part[at].view(np.int64)), pa.array(up)], names=["cell", "fp", "up"])

    dealt = prints.select("fp").mapInArrow(deal, "cell bigint, fp bigint, up boolean")
    # counts of own and stepped rows; those of few rows, almost all, need no blocks
    large = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(~F.col("up")).alias("own")).where((F.col("own") > 0) & (F.col("n") > F.col("own")) | (F.col("own") > 1))
    large = large.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    spread = dealt.join(large, "cell").withColumn("block", block)
    spread = spread.select("cell", "fp", "up", "block", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("with"))
    spread = spread.select("cell", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "up", "fp")
    spread = spread.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, 3):
            i, j = group[1][0], group[2][0]
            block, up, fp = group[3], group[4].astype(bool), group[5].view(np.uint64)
            a, b = block == i, block == j
            found = []
            for x, y, same in [(a & ~up, a & ~up, True), (a & up, a & ~up, False)] if i == j else [(a & ~up, b & ~up, False), (a & up, b & ~up, False), (a & ~up, b & up, False)]:
                x, y = np.flatnonzero(x), np.flatnonzero(y)
                if len(x) and len(y):
                    p, q = _links(fp[x], fp[y], limit, same)
                    found.append((x[p], y[q]))
            if found:
                p, q = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                if len(p) > 1:
                    p, q = forest(p, q, len(fp))
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(fp[p].view(np.int64)), pa.array(fp[q].view(np.int64))], names=["a", "b"])

    return spread.mapInArrow(meet, "a bigint, b bigint")


def key_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of each run of rows with equal first columns, of batches that are sorted by them; no nulls."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
        n = len(columns[0])
        if not n:
            continue
        change = np.zeros(n, bool)
        for c in columns[:keys]:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist()]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield [c[lo:hi] for c in columns]
        held = [c[cuts[-1] :] for c in columns]
    if held is not None and len(held[0]):
        yield held


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, limit: int = 4, seed: int = 42) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hex digits), component_id.

    Words are runs of other than ASCII white space with A-Z in lower case;
    shingles of so many words (fewer words: all of them) are hashed by XXH64, and
    a fingerprint bit is 1 if it is set in over half of the hashes. Fingerprints
    of at most limit differing bits are linked; component_id is the smallest id
    reachable. Null and wordless texts have fingerprint 0 and are linked like
    others; rows that repeat an id keep a row each; rows without an id have their
    fingerprint's component. Other columns of docs aren't read.
    """
    bound_batches(docs.sparkSession)
    prints = cut(fingerprints(docs, id_col, text_col, shingle, seed))
    distinct = cut(prints.groupBy("fp").agg(F.min(id_col).alias("rep"), F.count("*").alias("rows")))
    found = components(links(distinct, limit)).select(F.col("node").alias("fp"), "component")
    roots = cut(distinct.join(found, "fp", "left").select("fp", "rep", "rows", F.coalesce("component", "fp").alias("component")))
    least = roots.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    roots = look_up(roots, least, "component", roots.count()).select("fp", "component_id", F.col("rows").alias("n"))
    return look_up(prints, roots, "fp", prints.count()).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
