"""Readback of an ontology of 52 concepts from one container: what was stored, and what shows up beside it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K

BASE = ("signed", 7)
#: All concepts, each as id, tau, name and domain.
CONCEPTS = (
    ("mode.standby", 0x87, "Standby", "mode"),
    ("mode.active", 0x83, "Active", "mode"),
    ("mode.learn", 0x81, "Learning", "mode"),
    ("mode.deploy", 0x88, "Deploy", "mode"),
    ("nav.waypoint", 0x66, "Waypoint", "nav"),
    ("nav.heading", 0x61, "Heading", "nav"),
    ("nav.altitude", 0x62, "Altitude", "nav"),
    ("nav.velocity", 0x63, "Velocity", "nav"),
    ("nav.bearing", 0x64, "Bearing", "nav"),
    ("nav.terrain", 0x65, "Terrain", "nav"),
    ("plan.mission", 0x70, "Mission", "plan"),
    ("plan.objective", 0x71, "Objective", "plan"),
    ("plan.priority", 0x72, "Priority", "plan"),
    ("plan.deadline", 0x73, "Deadline", "plan"),
    ("plan.resource", 0x74, "Resource", "plan"),
    ("plan.constraint", 0x75, "Constraint", "plan"),
    ("sens.lidar", 0xE0, "Lidar", "sens"),
    ("sens.radar", 0xE8, "Radar", "sens"),
    ("sens.camera", 0xE1, "Camera", "sens"),
    ("sens.imu", 0xE2, "IMU", "sens"),
    ("sens.gps", 0xE3, "GPS", "sens"),
    ("sens.sonar", 0xE4, "Sonar", "sens"),
    ("sens.thermal", 0xE5, "Thermal", "sens"),
    ("sens.magnetic", 0xE7, "Magnetic", "sens"),
    ("ctrl.throttle", 0x50, "Throttle", "ctrl"),
    ("ctrl.steering", 0x51, "Steering", "ctrl"),
    ("ctrl.brake", 0x52, "Brake", "ctrl"),
    ("ctrl.pitch", 0x53, "Pitch", "ctrl"),
    ("ctrl.roll", 0x54, "Roll", "ctrl"),
    ("ctrl.yaw", 0x55, "Yaw", "ctrl"),
    ("ctrl.gain", 0x56, "Gain", "ctrl"),
    ("ctrl.damping", 0x57, "Damping", "ctrl"),
    ("motor.torque", 0x40, "Torque", "motor"),
    ("motor.rpm", 0x41, "RPM", "motor"),
    ("motor.current", 0x42, "Current", "motor"),
    ("motor.pwm", 0x43, "PWM", "motor"),
    ("motor.position", 0x44, "Position", "motor"),
    ("motor.force", 0x45, "Force", "motor"),
    ("motor.encoder", 0x46, "Encoder", "motor"),
    ("motor.servo", 0x47, "Servo", "motor"),
    ("proc.fft", 0x92, "FFT", "proc"),
    ("proc.filter", 0x93, "Filter", "proc"),
    ("proc.kalman", 0x94, "Kalman", "proc"),
    ("proc.fusion", 0x95, "Fusion", "proc"),
    ("proc.detect", 0x96, "Detection", "proc"),
    ("proc.classify", 0x97, "Classify", "proc"),
    ("comm.radio", 0xA0, "Radio", "comm"),
    ("comm.protocol", 0xA1, "Protocol", "comm"),
    ("comm.telemetry", 0xA2, "Telemetry", "comm"),
    ("comm.mesh", 0xA3, "Mesh", "comm"),
    ("comm.encrypt", 0xA4, "Encrypt", "comm"),
    ("comm.sync", 0xA5, "Sync", "comm"),
)
#: Weights of domain and tau in a template, bins of tau, the seed's factor.
DOMAIN_WEIGHT, TAU_WEIGHT, TAU_BINS, TAU_SEED = 0.35, 0.35, 8, 0xDEADBEEF
#: Stored concepts and amplitudes by scenario.
SCENARIOS = {
    "sens_only": (tuple(range(16, 24)), (1.0,) * 8),
    "navigation": ((1, 33, 19, 6, 38), (0.9, 1.0, 0.8, 0.9, 0.7)),
    "conflict": ((2, 18, 15, 20, 40, 42), (1.0, 0.8, 0.9, 0.7, 1.0, 0.8)),
    "adaptation": ((32, 27, 43, 44, 13), (1.0, 0.9, 0.8, 0.7, 0.6)),
    "full_load": (tuple(range(52)), (1.0,) * 52),
}
#: Pairs whose correlation is shown by name.
NAMED_PAIRS = ((32, 24), (33, 25), (24, 5), (10, 1), (40, 46), (16, 32), (17, 40), (33, 6))

#: Domains in the order of their first concepts, with the places of their concepts.
DOMAINS = {domain: tuple(i for i, c in enumerate(CONCEPTS) if c[3] == domain) for domain in dict.fromkeys(c[3] for c in CONCEPTS)}

READBACK = "scenario string, d int, index int, id string, name string, domain string, tau int, was_stored boolean, original_amplitude double, readback double"


def tau_basis(tau: int, d: int) -> np.ndarray:
    """Values between those of tau's bin and the next, which wraps around."""
    low, high = K.base_range(BASE)
    wide = 256 / TAU_BINS
    lo = int(tau // wide)
    part = (tau - lo * wide) / wide
    a, b = (K.SplitMix(TAU_SEED * (k % TAU_BINS + 1)).integers(low, high, d) for k in (lo, lo + 1))
    return np.clip(K.rounded(a * (1 - part) + b * part), low, high)


def templates(d: int, domain_weight: float = DOMAIN_WEIGHT, tau_weight: float = TAU_WEIGHT) -> np.ndarray:
    """(52, d): domain, tau and concept by weight; streams by FNV-1a of the names."""
    low, high = K.base_range(BASE)
    draw = lambda name: K.SplitMix(K.fnv1a(name)).integers(low, high, d).astype(np.float32)
    rows = [np.float32(domain_weight) * draw(domain) + np.float32(tau_weight) * tau_basis(tau, d).astype(np.float32) + np.float32(1 - domain_weight - tau_weight) * draw(name) for name, tau, _, domain in CONCEPTS]
    return np.clip(K.rounded(np.stack(rows)), low, high).astype(np.int8)


def stored(vecs: np.ndarray, indices: tuple[int, ...], amplitudes: tuple[float, ...]) -> np.ndarray:
    """A container with the concepts written in order, rounded and clamped after each."""
    out = np.zeros(vecs.shape[1], np.float32)
    for i, a in zip(indices, amplitudes, strict=True):
        out = np.clip(K.rounded(out + np.float32(a) * vecs[i].astype(np.float32)), -3, 3)
    return out


def read_all(vecs: np.ndarray, container: np.ndarray) -> np.ndarray:
    t = vecs.astype(np.float64)
    size = (t * t).sum(axis=1)
    return np.where(size > 1e-10, t @ container.astype(np.float64) / np.maximum(size, 1e-10), 0.0)


def readback(spark: SparkSession, dims: tuple[int, ...] = (4096,), scenarios: dict = SCENARIOS) -> DataFrame:
    """READBACK rows of all concepts for each scenario and dimension; one task each."""
    import pandas as pd

    settings = spark.createDataFrame([(s, d) for s in scenarios for d in dims], "scenario string, d int").repartition(len(scenarios) * len(dims), "scenario", "d")

    def run(batches):
        for batch in batches:
            for s, d in zip(batch.scenario, batch.d, strict=True):
                indices, amplitudes = scenarios[s]
                vecs = templates(d)
                found = read_all(vecs, stored(vecs, indices, amplitudes))
                own = dict(zip(indices, amplitudes, strict=True))
                yield pd.DataFrame([(s, d, i, name, label, domain, tau, i in own, own.get(i, 0.0), float(found[i])) for i, (name, tau, label, domain) in enumerate(CONCEPTS)], columns=[c.split()[0] for c in READBACK.split(", ")])

    return settings.mapInPandas(run, READBACK)


def verdicts(rows: DataFrame, threshold: float = 0.02) -> DataFrame:
    """rows with is_ghost and a verdict: ghosts by sign, stored concepts by what came back of their amplitude."""
    ghost = ~F.col("was_stored") & (F.abs("readback") > threshold)
    ratio = F.col("readback") / F.col("original_amplitude")
    verdict = F.when(ghost & (F.col("readback") > 0), "GHOST+").when(ghost, "GHOST-").when(~F.col("was_stored"), "").when(ratio > 1.1, "ampl").when(ratio < 0.5, "supp").otherwise("recov")
    return rows.withColumn("is_ghost", ghost).withColumn("verdict", verdict).orderBy("scenario", "d", F.desc("is_ghost"), F.desc(F.abs("readback")), "index")


def counts(rows: DataFrame, threshold: float = 0.02) -> DataFrame:
    """(d, scenario, ghosts, max_ghost)."""
    free = ~F.col("was_stored")
    return rows.groupBy("d", "scenario").agg(F.count_if(free & (F.abs("readback") > threshold)).alias("ghosts"), F.coalesce(F.max(F.when(free, F.abs("readback"))), F.lit(0.0)).alias("max_ghost"))


def matrix(spark: SparkSession, d: int = 4096) -> DataFrame:
    """A row for each stored domain with the mean readback of each other domain; 0 on the diagonal."""
    found = readback(spark, (d,), {k: (v, (1.0,) * len(v)) for k, v in DOMAINS.items()})
    value = F.when(F.col("scenario") == F.col("domain"), 0.0).otherwise(F.col("readback"))
    return found.withColumn("v", value).groupBy(F.col("scenario").alias("stored")).pivot("domain", list(DOMAINS)).agg(F.avg("v"))


def concepts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(CONCEPTS)], "index int, id string, tau int, name string, domain string")


def tau_topology(vecs: DataFrame) -> DataFrame:
    """(bucket, avg_corr, max_corr, n, label) of all pairs of vecs(index, tau, vec) by tau distance in eights, 15 at most."""
    from ..functions.vectors import pearson

    a = vecs.select(F.col("index").alias("i"), F.col("tau").alias("ta"), F.col("vec").alias("va"))
    b = vecs.select(F.col("index").alias("j"), F.col("tau").alias("tb"), F.col("vec").alias("vb"))
    pairs = a.join(F.broadcast(b), F.col("i") < F.col("j"))  # 52 concepts
    bucket = F.least(F.floor(F.abs(F.col("ta") - F.col("tb")) / TAU_BINS), F.lit(15)).cast("int")
    found = pairs.groupBy(bucket.alias("bucket")).agg(F.avg(pearson("va", "vb")).alias("avg_corr"), F.max(pearson("va", "vb")).alias("max_corr"), F.count("*").alias("n"))
    return found.withColumn("label", F.when(F.col("avg_corr") > 0.3, "strong link").when(F.col("avg_corr") > 0.1, "weak link").when(F.col("avg_corr") > 0.02, "faint").otherwise("orthogonal"))


def template_table(spark: SparkSession, d: int) -> DataFrame:
    """(index, tau, vec) of all concepts."""
    vecs = templates(d)
    return spark.createDataFrame([(i, tau, vecs[i].astype(int).tolist()) for i, (_, tau, _, _) in enumerate(CONCEPTS)], "index int, tau int, vec array<int>")
