"""Property graphs: neighbours, templates of entities, encoded edges, and links that are missing.

entities(index, id, name, entity_type, axes), edges(seq, source_id, target_id,
edge_type, label), templates(index, vec).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..functions import kernels as K
from ..functions import vectors as V
from ..sources.graphs import amplitude, axis_tokens

#: Fixed value: the share of a template that axes can take at most.
MOST_OVERLAP = 0.6
#: Vectors of each of the two blocks that one task scores against each other.
BLOCK = 512


def by_id(entities: DataFrame) -> DataFrame:
    """(id, index): of entities that repeat an id the last."""
    return entities.groupBy("id").agg(F.max("index").alias("index"))


def edges_of(edges: DataFrame, entity: str) -> DataFrame:
    return edges.where((F.col("source_id") == entity) | (F.col("target_id") == entity))


def neighbors(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, seq, neighbor): both directions, repeats kept, ends that aren't entities dropped."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.col("target_id").alias("neighbor")), F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("neighbor")))).alias("e"), "seq", "source_id", "target_id").where("source_id <> target_id or e.id is not null")
    loops = F.col("source_id") == F.col("target_id")
    ends = ends.select("e.id", "seq", "e.neighbor").where(~loops).unionByName(edges.where(loops).select(F.col("source_id").alias("id"), "seq", F.col("target_id").alias("neighbor")))
    known = by_id(entities)
    return ends.join(known.select("id"), "id", "left_semi").join(known.select(F.col("id").alias("neighbor")), "neighbor", "left_semi").select("id", "seq", "neighbor")


def resolved(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, i, j, edge_type): edges by the indexes of their ends; those with an unknown end are left out."""
    known = by_id(entities)
    return edges.join(known.select(F.col("id").alias("source_id"), F.col("index").alias("i")), "source_id").join(known.select(F.col("id").alias("target_id"), F.col("index").alias("j")), "target_id").select("seq", "i", "j", "edge_type")


def tokens(entities: DataFrame) -> DataFrame:
    """(index, pos, token, rank): axis tokens of each entity; rank counts different tokens by where they come first."""
    each = entities.select("index", F.posexplode(axis_tokens()).alias("pos", "token"))
    first = each.groupBy("token").agg(F.min(F.struct("index", "pos")).alias("at"))
    ranks = first.select("token", (F.row_number().over(Window.orderBy("at.index", "at.pos")) - 1).cast("long").alias("rank"))  # as many rows as there are different tokens
    return each.join(ranks, "token").select("index", "pos", "token", "rank")


def templates(entities: DataFrame, d: int, base: tuple[str, int], overlap: float) -> DataFrame:
    """(index, vec): a random vector by id, and by weight one for each axis token, rounded and clamped.

    Streams depend on the id, or on the token's rank, alone.
    """
    low, high = K.base_range(base)
    lists = tokens(entities).groupBy("index").agg(F.array_sort(F.collect_list(F.struct("pos", "rank"))).alias("t"))
    rows = entities.join(lists, "index", "left").select("index", "id", F.coalesce(F.transform("t", lambda x: x["rank"]), F.array().cast("array<bigint>")).alias("ranks"))

    def run(batches):
        held: dict[int, np.ndarray] = {}
        draw = lambda text: K.SplitMix(K.fnv1a(text) + 1).integers(low, high, d).astype(np.float32)
        for batch in batches:
            vecs = []
            for name, ranks in zip(batch.id, batch.ranks, strict=True):
                share = min(np.float32(len(ranks)) * np.float32(overlap), np.float32(MOST_OVERLAP))
                vec = (1 - share) * draw(name)
                for r in ranks:
                    if r not in held:
                        if len(held) > 4096:
                            held.clear()
                        held[r] = draw(f"axis:{r}")
                    vec = vec + share / len(ranks) * held[r]
                vecs.append(np.clip(K.rounded(vec), low, high).astype(np.int32).tolist())
            yield pd.DataFrame({"index": batch["index"], "vec": vecs})

    return rows.mapInPandas(run, "index bigint, vec array<int>")


def bound(pairs: DataFrame, vecs: DataFrame, base: tuple[str, int]) -> DataFrame:
    """pairs(i, j, ...) with `probe`, the bound vectors of both ends; ids are joined first, vectors last."""
    a, b = vecs.select(F.col("index").alias("i"), F.col("vec").alias("_a")), vecs.select(F.col("index").alias("j"), F.col("vec").alias("_b"))
    return pairs.join(a, "i").join(b, "j").withColumn("probe", V.bind("_a", "_b", base)).drop("_a", "_b")


def encode(entities: DataFrame, edges: DataFrame, vecs: DataFrame, base: tuple[str, int]) -> DataFrame:
    """One row `container`: the sum of all bound edges by their types' strength, rounded and clamped once."""
    low, high = K.base_range(base)
    terms = bound(resolved(entities, edges), vecs, base).select(amplitude().alias("amp"), F.posexplode("probe").alias("pos", "x"))
    places = terms.groupBy("pos").agg(V.clamp(V.half_up(F.round(F.sum(F.col("amp") * F.col("x")), 6)), low, high).cast("int").alias("v"))
    return places.agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("w")).select(F.transform("w", lambda x: x["v"]).alias("container"))


def residual(entities: DataFrame, edges: DataFrame, vecs: DataFrame, base: tuple[str, int], container: list[int], most: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """What least squares on the bound edges leave of a container, and the coefficients by seq.

    Of more edges than `most` or than places, the normal equations are summed over
    the places, and the coefficients are those of least norm.
    """
    rows = bound(resolved(entities, edges), vecs, base).select("seq", "probe")
    stored = np.asarray(container, np.float64)
    few = min(most, len(stored))
    first = rows.orderBy("seq").limit(few + 1).collect()
    if not first:
        return stored, np.zeros(0)
    if len(first) <= few:
        t = np.array([r.probe for r in first], np.float64)
        found = K.cholesky_solve(t @ t.T, t @ stored)
        return stored - found @ t, found

    def products(batches):
        total = np.zeros((len(stored), len(stored)))
        for batch in batches:
            if len(batch):
                t = np.array(batch.probe.tolist(), np.float64)
                total += t.T @ t
        yield pd.DataFrame({"g": [total.tobytes()]})

    gram = np.zeros((len(stored), len(stored)))
    for r in rows.select("probe").mapInPandas(products, "g binary").toLocalIterator():
        gram += np.frombuffer(r.g).reshape(gram.shape)
    weights = np.linalg.pinv(gram, hermitian=True) @ stored

    def readings(batches):
        for batch in batches:
            yield pd.DataFrame({"seq": batch.seq, "c": [float(np.asarray(p, np.float64) @ weights) for p in batch.probe]})

    found = rows.selectExpr("cast(seq as bigint) seq", "probe").mapInPandas(readings, "seq bigint, c double").orderBy("seq").collect()
    return stored - gram @ weights, np.array([r.c for r in found])


def nonedges(entities: DataFrame, edges: DataFrame, left: Column | None = None, right: Column | None = None) -> DataFrame:
    """(i, j) of entities without an edge either way.

    All pairs i < j; or, with conditions on left and right ends, all ordered pairs
    of different ends that meet them. Known edges go in an equi anti join on the
    ordered pair.
    """
    a = entities.where(left) if left is not None else entities
    b = entities.where(right) if right is not None else entities
    pairs = a.select(F.col("index").alias("i")).join(b.select(F.col("index").alias("j")), F.col("i") < F.col("j") if left is None and right is None else F.col("i") != F.col("j"))
    known = resolved(entities, edges).select(F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).distinct()
    return pairs.withColumn("lo", F.least("i", "j")).withColumn("hi", F.greatest("i", "j")).join(known, ["lo", "hi"], "left_anti").select("i", "j")


def ghosts(entities: DataFrame, pairs: DataFrame, vecs: DataFrame, base: tuple[str, int], signals: dict[str, list[float]], rank_by: str, top: int | None) -> DataFrame:
    """pairs with names, types and the cosine of their probe with each signal; the `top` strongest by |rank_by|, then by i and j."""
    probes = bound(pairs, vecs, base)
    for name, vector in signals.items():
        target = F.array(*[F.lit(float(x)) for x in vector]) if len(vector) <= 512 else None
        probes = probes.withColumn(name, _cosine_literal(F.col("probe"), target) if target is not None else _cosine_kernel(vector)(F.col("probe")))
    a = entities.select(F.col("index").alias("i"), F.col("name").alias("name_a"), F.col("entity_type").alias("type_a"))
    b = entities.select(F.col("index").alias("j"), F.col("name").alias("name_b"), F.col("entity_type").alias("type_b"))
    found = probes.drop("probe")
    if top is not None:
        found = found.orderBy(F.desc(F.abs(rank_by)), "i", "j").limit(top)
    return found.join(a, "i").join(b, "j").select(F.col("i").alias("entity_a"), F.col("j").alias("entity_b"), "name_a", "name_b", "type_a", "type_b", *signals)


def _block_pairs(entities: DataFrame, edges: DataFrame, vecs: DataFrame, left: Column | None, right: Column | None) -> DataFrame:
    """(bi, bj, side, index, kind, vec, other): for each pair of blocks the vectors of one (side 0) and the other (1), and the edges between them (2)."""
    marks = [c.alias(n) for c, n in ((left, "_left"), (right, "_right")) if c is not None]
    both = entities.select("index", F.col("entity_type").alias("kind"), *marks).join(vecs, "index")
    blocks = max(1, -(-entities.count() // BLOCK))
    block = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long"), F.lit(3)), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    names = ("bi", "bj", "side", "index", "kind", "vec", "other")
    none = F.lit(None).cast("long").alias("other")
    known = resolved(entities, edges).select(F.least("i", "j").alias("index"), F.greatest("i", "j").alias("other")).distinct()
    known = known.withColumns({"side": F.lit(2), "kind": F.lit(None).cast("string"), "vec": F.lit(None).cast(vecs.schema["vec"].dataType), "x": block("index"), "y": block("other")})
    if left is None:
        spread = both.withColumn("b", block("index")).withColumn("k", every)
        rows = spread.select(F.least("b", "k").alias("bi"), F.greatest("b", "k").alias("bj"), F.when(F.col("b") <= F.col("k"), 0).otherwise(1).alias("side"), "index", "kind", "vec", none)
        return rows.unionByName(known.withColumn("bi", F.least("x", "y")).withColumn("bj", F.greatest("x", "y")).select(*names))
    rows = both.where("_left").select(block("index").alias("bi"), every.alias("bj"), F.lit(0).alias("side"), "index", "kind", "vec", none)
    rows = rows.unionByName(both.where("_right").select(every.alias("bi"), block("index").alias("bj"), F.lit(1).alias("side"), "index", "kind", "vec", none))
    ways = [known.withColumn("bi", F.col(p)).withColumn("bj", F.col(q)).select(*names) for p, q in (("x", "y"), ("y", "x"))]
    return rows.unionByName(ways[0]).unionByName(ways[1])


def _scores(group: pd.DataFrame, base: tuple[str, int], targets: np.ndarray, ordered: bool):
    """(i, kind, other ids, other kinds, signals): for each vector of one block its pairs with the other that aren't edges."""
    of = {side: part.sort_values("index") for side, part in group.groupby("side")}
    a = of.get(0)
    same = not ordered and group.bi.iloc[0] == group.bj.iloc[0]
    b = a if same else of.get(1)
    if a is None or b is None:
        return
    known: dict[int, set[int]] = {}
    if 2 in of:
        for i, j in zip(of[2]["index"], of[2].other, strict=True):
            known.setdefault(int(i), set()).add(int(j))
            known.setdefault(int(j), set()).add(int(i))
    sizes = np.linalg.norm(targets, axis=0)
    ids, kinds, vectors = b["index"].to_numpy(), b.kind.to_numpy(), np.stack([np.asarray(v, np.int16) for v in b.vec])
    for i, kind, v in zip(a["index"].tolist(), a.kind, a.vec, strict=True):
        keep = ids > i if same else ids != i
        if i in known:
            keep &= ~np.isin(ids, list(known[i]))
        if keep.any():
            probe = K.bind(np.asarray(v, np.int16)[None, :], vectors[keep], base).astype(np.float64)
            yield i, kind, ids[keep], kinds[keep], probe @ targets / np.maximum(np.linalg.norm(probe, axis=1)[:, None] * sizes, 1e-10)


def all_ghosts(entities: DataFrame, edges: DataFrame, vecs: DataFrame, base: tuple[str, int], signals: dict[str, list[float]], rank_by: str, top: int | None, left: Column | None = None, right: Column | None = None, digits: int = 12) -> DataFrame:
    """As `ghosts` of all pairs of `nonedges`: vectors meet block by block, BLOCK of each at most, and a block keeps its `top` pairs.

    A vector is shuffled once for each block, not for each pair. Signals that agree
    to so many digits are tied, and tied pairs come by i and j.
    """
    targets = np.stack([np.asarray(v, np.float64) for v in signals.values()], axis=1)
    at = list(signals).index(rank_by)
    ordered = left is not None
    columns = ["entity_a", "entity_b", *signals]

    def score(group: pd.DataFrame) -> pd.DataFrame:
        held: list[np.ndarray] = []
        count = 0

        def best() -> None:
            rows = np.concatenate(held)
            held[:] = [rows[np.lexsort((rows[:, 1], rows[:, 0], -np.abs(np.round(rows[:, 2 + at], digits))))[:top]]]

        for i, _, others, _, found in _scores(group, base, targets, ordered):
            first, second = (np.full(len(others), i), others) if ordered else (np.minimum(i, others), np.maximum(i, others))
            held.append(np.column_stack([first.astype(np.float64), second.astype(np.float64), found]))
            count += len(others)
            if top is not None and count > 64 * max(top, 1024):
                best()
                count = len(held[0])
        if held and top is not None:
            best()
        rows = np.concatenate(held) if held else np.zeros((0, len(columns)))
        return pd.DataFrame({c: rows[:, k].astype(np.int64) if k < 2 else rows[:, k] for k, c in enumerate(columns)})

    schema = ", ".join(["entity_a bigint", "entity_b bigint", *(f"`{s}` double" for s in signals)])
    found = _block_pairs(entities, edges, vecs, left, right).groupBy("bi", "bj").applyInPandas(score, schema)
    if top is not None:
        found = found.orderBy(F.desc(F.abs(F.round(rank_by, digits))), "entity_a", "entity_b").limit(top)
    a = entities.select(F.col("index").alias("entity_a"), F.col("name").alias("name_a"), F.col("entity_type").alias("type_a"))
    b = entities.select(F.col("index").alias("entity_b"), F.col("name").alias("name_b"), F.col("entity_type").alias("type_b"))
    return found.join(a, "entity_a").join(b, "entity_b").select("entity_a", "entity_b", "name_a", "name_b", "type_a", "type_b", *signals)


def all_types(entities: DataFrame, edges: DataFrame, vecs: DataFrame, base: tuple[str, int], signals: dict[str, list[float]]) -> DataFrame:
    """`type_summary` of all pairs of `nonedges`; signals are named ghost_signal and direct_strength. Each pair of blocks gives sums by pair of types."""
    targets = np.stack([np.asarray(signals[s], np.float64) for s in ("ghost_signal", "direct_strength")], axis=1)

    def total(group: pd.DataFrame) -> pd.DataFrame:
        sums: dict[str, np.ndarray] = {}
        for i, kind, others, kinds, found in _scores(group, base, targets, False):
            for other in set(kinds):
                for lower in (True, False):
                    own = (kinds == other) & ((others > i) == lower)
                    if own.any():
                        name = f"{kind}<->{other}" if lower else f"{other}<->{kind}"
                        sums[name] = sums.get(name, np.zeros(3)) + np.array([own.sum(), *np.abs(found[own]).sum(axis=0)])
        return pd.DataFrame([(k, int(v[0]), v[1], v[2]) for k, v in sums.items()], columns=["type_pair", "n", "ghost", "direct"])

    found = _block_pairs(entities, edges, vecs, None, None).groupBy("bi", "bj").applyInPandas(total, "type_pair string, n bigint, ghost double, direct double")
    return found.groupBy("type_pair").agg(F.sum("n").alias("n"), (F.sum("ghost") / F.sum("n")).alias("mean_ghost"), (F.sum("direct") / F.sum("n")).alias("mean_direct")).orderBy(F.desc("mean_ghost"), "type_pair")


def _cosine_literal(probe: Column, target: Column) -> Column:
    add = lambda t, x: t + x
    product = F.aggregate(F.zip_with(probe, target, lambda x, y: x * y), F.lit(0.0), add)
    size = F.sqrt(V.norm2(probe).cast("double")) * F.sqrt(F.aggregate(target, F.lit(0.0), lambda t, y: t + y * y))
    return product / F.greatest(size, F.lit(1e-10))


def _cosine_kernel(vector: list[float]):
    target = np.asarray(vector, np.float64)
    size = float(np.linalg.norm(target))
    return C.by_row(lambda p: float(np.asarray(p, np.float64) @ target / max(float(np.linalg.norm(p)) * size, 1e-10)), "double")


def type_summary(found: DataFrame, signal: str = "ghost_signal", direct: str = "direct_strength") -> DataFrame:
    """(type_pair, n, mean_ghost, mean_direct), strongest first."""
    return found.groupBy(F.concat_ws("<->", "type_a", "type_b").alias("type_pair")).agg(F.count("*").alias("n"), F.avg(F.abs(signal)).alias("mean_ghost"), F.avg(F.abs(direct)).alias("mean_direct")).orderBy(F.desc("mean_ghost"), "type_pair")


def known_strength(entities: DataFrame, edges: DataFrame, vecs: DataFrame, base: tuple[str, int], signals: dict[str, list[float]]) -> DataFrame:
    """(edge_type, n, and mean, min, max of each signal) of known edges, and one row for all with type `*`."""
    probes = bound(resolved(entities, edges), vecs, base)
    for name, vector in signals.items():
        probes = probes.withColumn(name, _cosine_kernel(vector)(F.col("probe")))
    measures = [f(name).alias(f"{label}_{name}") for name in signals for label, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return probes.rollup("edge_type").agg(F.count("*").alias("n"), *measures).withColumn("edge_type", F.coalesce("edge_type", F.lit("*")))


def marked(found: DataFrame, signal: str = "ghost_signal", least: float = 0.02) -> DataFrame:
    """A mark + or - beside signals over the threshold, else blank."""
    return found.withColumn("mark", F.when(F.col(signal) > least, "+").when(F.col(signal) < -least, "-").otherwise(" "))
