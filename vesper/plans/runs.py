"""Whole experiments: the graph's missing links over several bases, the ontology's readback, and the recogniser's report."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import ghosts, graph, recognise
from ..sources import graphs

#: The signal that counts as a ghost, and among how many it is looked for.
GHOST, AMONG = 0.03, 20


def encoded(entities: DataFrame, edges: DataFrame, d: int, base: tuple[str, int], overlap: float = 0.05) -> tuple[DataFrame, list[float], np.ndarray, np.ndarray]:
    """Templates, the container of all edges, what least squares leave of it, and the edges' coefficients."""
    vecs = graph.templates(entities, d, base, overlap).cache()
    container = [float(x) for x in graph.encode(entities, edges, vecs, base).first().container]
    return vecs, container, *graph.residual(entities, edges, vecs, base, container)


def base_summary(spark: SparkSession, path: str, d: int = 1024, bases: tuple[tuple[str, int], ...] = (("signed", 5), ("signed", 7), ("signed", 9)), overlap: float = 0.05) -> DataFrame:
    """(base, edges, ghosts, max_ghost, residual_energy, best): for each base how many of the strongest missing links are ghosts. The best has strictly most; else signed(7)."""
    entities, edges = (f.cache() for f in graphs.read(spark, path))
    rows = []
    for base in bases:
        vecs, container, rest, found = encoded(entities, edges, d, base, overlap)
        top = graph.all_ghosts(entities, edges, vecs, base, {"direct_strength": container, "ghost_signal": rest.tolist()}, "ghost_signal", AMONG).collect()
        signals = [abs(r.ghost_signal) for r in top]
        rows.append((recognise.base_name(base), len(found), sum(s > GHOST for s in signals), max(signals, default=0.0), float((rest * rest).mean())))
    most = max((r[2] for r in rows), default=0)
    first = [r[0] for r in rows if r[2] == most]
    best = first[0] if len(first) == 1 else "signed(7)"
    return spark.createDataFrame([(*r, r[0] == best) for r in rows], "base string, edges int, ghosts int, max_ghost double, residual_energy double, best boolean")


def dual_scenarios(entities: DataFrame, edges: DataFrame, vecs: DataFrame, base: tuple[str, int], signals: dict[str, list[float]], name: str, top: int = 30) -> dict[str, DataFrame]:
    """Missing links of one entity by name, of people among each other, of systems to nations, and of civic to other systems; strongest first by the first signal."""
    kind = lambda k: F.col("entity_type") == k
    nation = F.col("axes.stakeholder_type") == "Nation"
    ends = {"one": (F.col("name") == name, F.lit(True)), "people": (kind("Person"), kind("Person")), "deployments": (kind("System"), nation), "convergence": (kind("Civic"), kind("System"))}
    rank = next(iter(signals))
    return {k: graph.all_ghosts(entities, edges, vecs, base, signals, rank, top, a, b) for k, (a, b) in ends.items()}


def ontology_discovery(spark: SparkSession, d: int = 4096, threshold: float = 0.02) -> dict[str, DataFrame]:
    """Readback of all scenarios with verdicts, the matrix of domains, ghosts by dimension, correlation by tau distance."""
    return {
        "readback": ghosts.verdicts(ghosts.readback(spark, (d,)), threshold),
        "matrix": ghosts.matrix(spark, d),
        "dimensions": ghosts.counts(ghosts.readback(spark, (256, 512, 1024, 2048, 4096, 8192, 16384)), threshold),
        "topology": ghosts.tau_topology(ghosts.template_table(spark, d)),
    }


def recognition_report(spark: SparkSession, planes: tuple[int, ...] = (1024, 4096)) -> DataFrame:
    """Means over the sweep and its best configuration, for each number of hyperplanes."""
    parts = [recognise.best_configuration(recognise.sweep(spark, planes=n)).withColumn("planes", F.lit(n)) for n in planes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def timings(d: int = 1024, planes: int = 4096, classes: int = 20) -> dict[str, float]:
    """Seconds of the recogniser's kernels on the driver: making hyperplanes, projecting one and a hundred vectors, one readout."""
    out: dict[str, float] = {}
    K.hyperplanes.cache_clear()

    def timed(name: str, f):
        began = time.perf_counter()
        got = f()
        out[name] = time.perf_counter() - began
        return got

    made = timed("hyperplanes", lambda: K.hyperplanes(d, planes, 42))
    stream = K.SplitMix(7)
    rows = np.stack([stream.integers(-3, 3, d) for _ in range(max(100, classes))])
    timed("project_one", lambda: K.sign_bits(rows[:1], made))
    prints = timed("project_hundred", lambda: K.sign_bits(rows[:100], made))
    timed("hamming", lambda: int(np.bitwise_count(prints[0] ^ prints[1]).sum()))
    timed("readout", lambda: K.gram_schmidt(rows[0].astype(np.float32), rows[:classes]))
    return out
