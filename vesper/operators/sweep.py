"""Parameter sweeps of coefficient recovery: a grid of settings, one kernel run each, means over repetitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from .recognise import base_name

#: The axes of the full sweep.
DIMS = (1024, 2048, 4096, 8192, 16384, 32768, 65536)
BASES = (("binary", 2), ("unsigned", 3), ("unsigned", 5), ("unsigned", 7), ("signed", 3), ("signed", 5), ("signed", 7), ("signed", 9))
AXES = (1, 2, 3)
BUNDLES = (1, 3, 5, 8, 13, 21, 34, 55, 89)
DEPTHS = (1, 2, 3, 4)

RESULT = "d int, base string, signed boolean, axes int, k int, bind_depth int, rep int, mean_error double, bell_coefficient double, gram_condition double, bits_per_concept double, storage_bytes bigint"
SINGLE = "d int, base string, k int, mean_error double, max_error double, gram_condition double, noise_floor double, cancellation double, bits_per_concept double"


def _superpose(templates: np.ndarray, weights: np.ndarray, base: tuple[str, int]) -> np.ndarray:
    return K.quantized(weights.astype(np.float32) @ templates.astype(np.float32), base)


def _recover(templates: np.ndarray, stored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = templates.astype(np.float64)
    gram = t @ t.T
    return K.cholesky_solve(gram, t @ stored.astype(np.float64)), gram


def measure(d: int, base: tuple[str, int], k: int, seed: int) -> dict:
    """Recovery on one axis: errors, condition, residual, zeros, and storage."""
    stream = K.SplitMix(seed)
    templates = np.stack([stream.integers(*K.base_range(base), d) for _ in range(k)])
    weights = stream.uniform(k) * 2 - 1
    stored = _superpose(templates, weights, base)
    found, gram = _recover(templates, stored)
    error = np.abs(weights - found)
    rest = stored - found @ templates.astype(np.float64)
    return {"d": d, "base": base_name(base), "k": k, "mean_error": float(error.mean()), "max_error": float(error.max()), "gram_condition": K.condition_number(gram), "noise_floor": float(np.sqrt((rest * rest).mean())), "cancellation": float((stored == 0).mean()) if base[0] == "signed" else 0.0, "bits_per_concept": K.base_bits(base, d) / k}


def bell(stream: K.SplitMix, d: int, base: tuple[str, int], states: np.ndarray) -> float:
    """A CHSH-like coefficient of two axis states under four random settings."""
    m = np.stack([stream.integers(*K.base_range(base), d) for _ in range(4)]).astype(np.float64)
    a, b = states.astype(np.float64)
    size = max(float(np.linalg.norm(a) * np.linalg.norm(b)), 1e-10) * d
    e = lambda i, j: float(a @ m[i]) * float(b @ m[2 + j]) / size
    return abs(e(0, 0) - e(0, 1) + e(1, 0) + e(1, 1))


def measure_axes(d: int, base: tuple[str, int], axes: int, k: int, depth: int, seed: int) -> dict:
    """Recovery on several axes, templates bound to each axis's role vectors one after the other."""
    stream = K.SplitMix(seed)
    draw = lambda n: np.stack([stream.integers(*K.base_range(base), d) for _ in range(n)])
    roles = [draw(depth) for _ in range(axes)]
    templates, weights = draw(k), stream.uniform(k) * 2 - 1
    errors, conditions, bounds = [], [], []
    for axis in range(axes):
        bound = templates
        for role in roles[axis]:
            bound = K.bind(bound, role[None, :], base)
        bounds.append(bound)
        found, gram = _recover(bound, _superpose(bound, weights, base))
        errors.append(float(np.abs(weights - found).mean()))
        conditions.append(K.condition_number(gram))
    chsh = 0.0
    if axes >= 2:
        states = np.stack([K.rounded(weights.astype(np.float32)[:, None] * b.astype(np.float32)).sum(axis=0) for b in bounds[:2]])
        chsh = bell(stream, d, base, states)
    bits = K.base_bits(base, d)
    return {"d": d, "base": base_name(base), "signed": base[0] == "signed", "axes": axes, "k": k, "bind_depth": depth, "mean_error": float(np.mean(errors)), "bell_coefficient": chsh, "gram_condition": float(np.max(conditions)), "bits_per_concept": bits * axes / k, "storage_bytes": -(-bits // 8) * axes}


def grid(spark: SparkSession, dims=DIMS, bases=BASES, axes=AXES, bundles=BUNDLES, depths=DEPTHS, repetitions: int = 1) -> DataFrame:
    """(d, kind, size, axes, k, bind_depth, rep): all settings of at most as many roles as axes and a tenth of d concepts."""
    whole = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("size")) for k, n in bases])).alias("b")).select("b.*")
    for name, values in (("d", dims), ("axes", axes), ("k", bundles), ("bind_depth", depths), ("rep", range(repetitions))):
        whole = whole.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return whole.where("bind_depth <= axes and k <= d / 10").select("d", "kind", "size", "axes", "k", "bind_depth", "rep")


def run(settings: DataFrame, seed: int = 42, partitions: int = 64) -> DataFrame:
    """A row of RESULT for each setting; its random stream depends on seed and setting alone."""

    def kernel(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                own = K.fnv1a(f"{seed}:{r.d}:{r.kind}:{r.size}:{r.axes}:{r.k}:{r.bind_depth}:{r.rep}")
                rows.append(measure_axes(r.d, (r.kind, r.size), r.axes, r.k, r.bind_depth, own) | {"rep": r.rep})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return settings.repartition(partitions, "d", "kind", "size", "axes", "k", "bind_depth", "rep").mapInPandas(kernel, RESULT)


def report(results: DataFrame) -> DataFrame:
    """Means over repetitions; settings of an error under 0.01 first, then by bits a concept."""
    keys = ["d", "base", "signed", "axes", "k", "bind_depth"]
    means = results.groupBy(*keys).agg(F.avg("mean_error").alias("mean_error"), F.avg("bell_coefficient").alias("bell_coefficient"), F.first("bits_per_concept").alias("bits_per_concept"), F.first("storage_bytes").alias("storage_bytes"))
    return means.orderBy(F.when(F.col("mean_error") < 0.01, 0).otherwise(1), "bits_per_concept", *keys)
