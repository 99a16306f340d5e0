"""Weighted sums of templates: writing them out, getting coefficients back, and deciding when to flush.

templates(concept_id, axis, vec) and coefficients(entity_id, concept_id,
coefficient[, seq]); a sum over concepts commutes until it is rounded, so it is a
grouped aggregate by entity, axis and place. Rounding after each write doesn't
commute and is a sorted fold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import vectors as V


def generate_templates(spark: SparkSession, concepts: int, d: int, base: tuple[str, int], axes: int = 1, seed: int = 42) -> DataFrame:
    """(concept_id, axis, vec): uniform values of the base; each row's stream depends on seed, concept and axis alone."""
    low, high = K.base_range(base)

    def run(batches):
        for batch in batches:
            vecs = [K.SplitMix(K.fnv1a(f"{seed}:{c}:{a}")).integers(low, high, d).astype(np.int32).tolist() for c, a in zip(batch.concept_id, batch.axis, strict=True)]
            yield pd.DataFrame({"concept_id": batch.concept_id, "axis": batch.axis, "vec": vecs})

    grid = spark.range(concepts * axes).select(F.floor(F.col("id") / axes).cast("long").alias("concept_id"), (F.col("id") % axes).cast("int").alias("axis"))
    return grid.mapInPandas(run, "concept_id bigint, axis int, vec array<int>")


def materialize(coefficients: DataFrame, templates: DataFrame, base: tuple[str, int] | None = None) -> DataFrame:
    """(entity_id, axis, vec): sums of coefficient times template; rounded and clamped to the base's range if there is one."""
    terms = coefficients.join(templates, "concept_id").select("entity_id", "axis", "coefficient", F.posexplode("vec").alias("pos", "t"))
    value = F.sum(F.col("coefficient") * F.col("t"))
    if base is not None:
        low, high = K.base_range(base)
        value = V.clamp(V.half_up(F.round(value, 9)), low, high).cast("int")  # sums of single writes differ in the last bits by their order
    places = terms.groupBy("entity_id", "axis", "pos").agg(value.alias("v"))
    return places.groupBy("entity_id", "axis").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("w")).select("entity_id", "axis", F.transform("w", lambda x: x["v"]).alias("vec"))


def add_in_order(coefficients: DataFrame, templates: DataFrame, base: tuple[str, int], ground: DataFrame | None = None) -> DataFrame:
    """(entity_id, axis, vec): templates added in the order of seq, rounded and clamped after each; ground (same columns) is what they are added to."""
    low, high = K.base_range(base)
    terms = coefficients.join(templates, "concept_id").groupBy("entity_id", "axis").agg(F.array_sort(F.collect_list(F.struct("seq", "coefficient", "vec"))).alias("w"))
    if ground is not None:
        terms = terms.join(ground.select("entity_id", "axis", F.col("vec").alias("g")), ["entity_id", "axis"], "left")
        start = F.coalesce("g", F.transform(F.get("w", F.lit(0))["vec"], lambda x: x * 0))
    else:
        start = F.transform(F.get("w", F.lit(0))["vec"], lambda x: x * 0)
    step = lambda acc, x: F.zip_with(acc, x["vec"], lambda c, t: V.clamp(V.half_up(c + x["coefficient"] * t), low, high).cast("int"))
    return terms.select("entity_id", "axis", F.aggregate("w", start, step).alias("vec"))


def hebbian(holographs: DataFrame, a: Column, b: Column, rate: float, base: tuple[str, int] | None) -> DataFrame:
    """holographs with rate times the product of two template columns added; rounded and clamped if there is a base."""
    total = F.zip_with("vec", F.zip_with(a, b, lambda x, y: x * y * F.lit(rate)), lambda c, x: c + x)
    return holographs.withColumn("vec", total if base is None else V.quantize(total, *K.base_range(base)))


def gram(templates: DataFrame) -> DataFrame:
    """(axis, i, k, dot), i <= k: products of all templates, from long rows of an equi join on place, summed before the shuffle."""
    long = templates.select("axis", "concept_id", F.posexplode("vec").alias("pos", "t"))
    left, right = long.select("axis", "pos", F.col("concept_id").alias("i"), F.col("t").alias("x")), long.select("axis", "pos", F.col("concept_id").alias("k"), F.col("t").alias("y"))
    return left.join(right, ["axis", "pos"]).where("i <= k").groupBy("axis", "i", "k").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("dot"))


def cool(hot: DataFrame, coefficients: DataFrame, templates: DataFrame) -> DataFrame:
    """(entity_id, concept_id, coefficient): least squares on each axis, averaged over axes. Entities without concepts have no rows.

    Gram matrix, right side and solution of one entity are one group of as many
    rows as it has concepts and axes.
    """
    rows = coefficients.select("entity_id", "concept_id").distinct().join(templates, "concept_id").join(hot.select("entity_id", "axis", F.col("vec").alias("hot")), ["entity_id", "axis"])

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, part in group.groupby("axis"):
            part = part.sort_values("concept_id")
            t = np.stack([np.asarray(v, np.float64) for v in part.vec])
            found.append(pd.DataFrame({"concept_id": part.concept_id, "c": K.cholesky_solve(t @ t.T, t @ np.asarray(part.hot.iloc[0], np.float64))}))
        mean = pd.concat(found).groupby("concept_id", as_index=False).c.mean()
        return pd.DataFrame({"entity_id": group.entity_id.iloc[0], "concept_id": mean.concept_id, "coefficient": mean.c})

    return rows.groupBy("entity_id").applyInPandas(solve, "entity_id bigint, concept_id bigint, coefficient double")


def overexposure(warm: DataFrame, concepts: DataFrame, base: tuple[str, int]) -> DataFrame:
    """(entity_id, overexposure, action): how full each warm holograph is, and what to do. concepts: (entity_id, k).

    The greatest over axes of the share of values at the limit, of energy over what
    k random concepts have, and of missing zeros (bases with both signs).
    """
    _, high = K.base_range(base)
    size = F.size("vec").cast("double")
    energy = V.dot("vec", "vec") / F.greatest(F.greatest(F.col("k"), F.lit(1)) * size * 0.5, F.lit(1.0)) - 1
    full = F.size(F.filter("vec", lambda x: F.abs(x) >= high)) / size
    zeros = 1 - F.size(F.filter("vec", lambda x: x == 0)) / F.greatest(size / base[1], F.lit(1.0)) if base[0] == "signed" else F.lit(0.0)
    scored = warm.join(concepts, "entity_id").select("entity_id", F.greatest(full, energy, zeros, F.lit(0.0)).alias("s"))
    return scored.groupBy("entity_id").agg(F.max("s").alias("overexposure")).withColumn("action", flush_action(F.col("overexposure")))


def flush_action(score: Column) -> Column:
    return F.when(score < 0.5, "None").when(score < 0.8, "SoftFlush").when(score < 1.0, "HardFlush").otherwise("Emergency")


def cold_size(coefficients: DataFrame) -> DataFrame:
    """(entity_id, k, bytes): concepts, and eight bytes for each."""
    return coefficients.groupBy("entity_id").agg(F.count("*").alias("k"), (8 * F.count("*")).alias("bytes"))
