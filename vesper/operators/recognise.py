"""Recognition of class templates: hyperplane fingerprints, sequential projection, and both in two stages."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import kernels as K

#: Scores and residuals that make a query novel, and the shortlist of the two-stage method.
NOVEL_SCORE, NOVEL_RESIDUAL, SHORTLIST = 0.15, 0.85, 8
#: Elements of all templates together that are sent to all tasks at most (4 bytes each).
MOST_ELEMENTS = 64 << 20

RESULT = "query_id bigint, best_class int, best_class_id bigint, best_score float, scores array<float>, is_novel boolean, residual_energy float, method string"


def learn(classes: DataFrame, examples: DataFrame) -> DataFrame:
    """(class_idx, class_id, template): the mean of template and examples, rounded and clamped to bytes.

    classes(class_idx, class_id, template), examples(class_idx, vec). Means don't
    depend on the order of examples.
    """
    rows = classes.select("class_idx", F.posexplode("template").alias("pos", "x")).unionByName(examples.select("class_idx", F.posexplode("vec").alias("pos", "x")))
    mean = F.avg("x")
    places = rows.groupBy("class_idx", "pos").agg(F.greatest(F.lit(-128), F.least(F.lit(127), F.signum(mean) * F.floor(F.abs(mean) + 0.5))).cast("int").alias("v"))
    learnt = places.groupBy("class_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("w")).select("class_idx", F.transform("w", lambda x: x["v"]).alias("template"))
    return classes.select("class_idx", "class_id").join(learnt, "class_idx")


def fingerprints(vectors: DataFrame, vector: str, d: int, planes: int = 4096, seed: int = 42 ^ 0xCAFE, name: str = "fp") -> DataFrame:
    return vectors.withColumn(name, C.lsh(F.col(vector).cast("array<float>"), d, planes, seed))


def save_planes(spark: SparkSession, path: str, name: str, d: int, planes: int, seed: int = 42 ^ 0xCAFE) -> None:
    """Stores hyperplanes under a name, in a folder of their own; those that had the name are replaced."""
    matrix = K.hyperplanes(d, planes, seed)
    rows = spark.createDataFrame(pd.DataFrame({"plane": np.arange(planes, dtype=np.int32), "plane_values": [row.tobytes() for row in matrix]}), "plane int, plane_values binary")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/name={name}")


def load_planes(spark: SparkSession, path: str, name: str, d: int, planes: int) -> np.ndarray | None:
    """Hyperplanes stored under a name; None if there are none, or none of that number and length."""
    if planes % 8 or planes <= 0:
        raise ValueError("planes are a positive multiple of 8")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/name={name}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    rows = spark.read.parquet(folder.toString()).orderBy("plane").limit(planes + 1).collect()
    if len(rows) != planes or any(len(r.plane_values) != 4 * d for r in rows):
        return None
    return np.frombuffer(b"".join(r.plane_values for r in rows), np.float32).reshape(planes, d)


@dataclass
class Model:
    ids: list[int]
    templates: np.ndarray
    prints: np.ndarray
    planes: int
    seed: int
    #: stored hyperplanes, if they aren't to be drawn anew
    held: np.ndarray | None = None

    def hyperplanes(self, d: int) -> np.ndarray:
        return K.hyperplanes(d, self.planes, self.seed) if self.held is None else self.held

    def recognise(self, query: np.ndarray, method: str) -> tuple:
        k = len(self.ids)
        similar = None
        if method != "projection":
            own = K.sign_bits(query[None, :], self.hyperplanes(query.shape[0]))
            similar = (1 - np.bitwise_count(own ^ self.prints).sum(axis=1) / np.float32(self.planes)).astype(np.float32)
        if method == "hamming":
            scores = (similar - np.float32(0.5)) * np.float32(2)
            best = int(scores.argmax())
            residual = K.gram_schmidt(query, self.templates)[1]
            return best, float(scores[best]), scores, bool(scores[best] < NOVEL_SCORE or residual > NOVEL_RESIDUAL), residual, "HammingBrute"
        two = method == "two_stage" and k > SHORTLIST
        order = np.argsort(-similar, kind="stable")[:SHORTLIST].tolist() if two else list(range(k))
        scores, residual = K.gram_schmidt(query, self.templates, order)
        best = max(order, key=lambda i: (abs(scores[i]), -order.index(i)))
        return best, float(scores[best]), scores, bool(abs(scores[best]) < NOVEL_SCORE or residual > NOVEL_RESIDUAL), residual, "TwoStage" if two else "ProjectionReadout"


def model(classes: DataFrame, planes: int = 4096, seed: int = 42 ^ 0xCAFE, held: np.ndarray | None = None) -> Model:
    """The classes on the driver, in the order of class_idx; their number is checked before. held: stored hyperplanes to use."""
    size = classes.agg(F.sum(F.size("template")).alias("n")).first().n or 0
    if not 0 < size <= MOST_ELEMENTS:
        raise ValueError(f"templates of 1 to {MOST_ELEMENTS} elements can be recognised at once; there are {size}")
    rows = classes.select("class_idx", "class_id", "template").orderBy("class_idx").collect()
    templates = np.array([r.template for r in rows], np.int16)
    drawn = K.hyperplanes(templates.shape[1], planes, seed) if held is None else held
    return Model([r.class_id for r in rows], templates, K.sign_bits(templates, drawn), planes if held is None else len(held), seed, held)


def recognise(queries: DataFrame, known: Model, method: str = "two_stage") -> DataFrame:
    """A row of RESULT for each of queries(query_id, vec): method "hamming", "projection" or "two_stage"."""
    if method not in ("hamming", "projection", "two_stage"):
        raise ValueError("method is hamming, projection or two_stage")
    held = queries.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            out = []
            for q, v in zip(batch.query_id, batch.vec, strict=True):
                best, score, scores, novel, residual, name = held.value.recognise(np.asarray(v, np.float32), method)
                out.append((q, best, held.value.ids[best], score, scores.tolist(), novel, residual, name))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    return queries.select("query_id", "vec").mapInPandas(run, RESULT)


EXPERIMENT = "d int, base string, channels int, num_classes int, examples_per_class int, noise_level double, hamming_accuracy double, projection_accuracy double, two_stage_accuracy double, hamming_mean_score double, projection_mean_score double, novelty_detection_rate double, mean_residual_energy double"


def experiment(d: int, base: tuple[str, int], classes: int, examples: int, noise: float, seed: int, planes: int, tests: int = 5, novel: int = 20) -> dict:
    """Accuracy of the three methods on noisy templates, and how many random vectors are found novel."""
    stream = K.SplitMix(seed)
    low, high = K.base_range(base)
    templates = np.stack([stream.integers(low, high, d) for _ in range(classes)]).astype(np.int16)
    perturbed = lambda t: np.clip(K.rounded(t + noise * stream.gaussian(d)), -128, 127).astype(np.int16)
    sums = templates.astype(np.float64)
    for _ in range(examples):
        sums += np.stack([perturbed(t) for t in templates])
    learnt = np.clip(K.rounded(sums / (1 + examples)), -128, 127).astype(np.int16)
    known = Model(list(range(classes)), learnt, K.sign_bits(learnt, K.hyperplanes(d, planes, 42 ^ 0xCAFE)), planes, 42 ^ 0xCAFE)
    right = {m: 0 for m in ("hamming", "projection", "two_stage")}
    scores = {m: 0.0 for m in right}
    left = 0.0
    for c in range(classes):
        for _ in range(tests):
            query = perturbed(templates[c]).astype(np.float32)
            for m in right:
                best, score, _, _, residual, _ = known.recognise(query, m)
                right[m] += best == c
                scores[m] += abs(score) if m == "projection" else score
                left += residual if m == "projection" else 0.0
    found = sum(known.recognise(stream.integers(low, high, d).astype(np.float32), "projection")[3] for _ in range(novel))
    n = classes * tests
    return {"d": d, "base": base_name(base), "channels": min(max(2 * classes, 16), d // 4), "num_classes": classes, "examples_per_class": examples, "noise_level": noise, "hamming_accuracy": right["hamming"] / n, "projection_accuracy": right["projection"] / n, "two_stage_accuracy": right["two_stage"] / n, "hamming_mean_score": scores["hamming"] / n, "projection_mean_score": scores["projection"] / n, "novelty_detection_rate": found / novel, "mean_residual_energy": left / n}


def base_name(base: tuple[str, int]) -> str:
    return "binary" if base[0] == "binary" else f"{base[0]}({base[1]})"


def sweep(spark, dims=(512, 1024, 2048), bases=(("signed", 5), ("signed", 7)), class_counts=(4, 8, 16, 32), noises=(0.3, 0.5, 1.0), planes: int = 4096) -> DataFrame:
    """One experiment for each combination, each a row of EXPERIMENT in a task of its own."""
    grid = [(d, *b, c, n) for d in dims for b in bases for c in class_counts for n in noises]
    rows = spark.createDataFrame(grid, "d int, kind string, size int, classes int, noise double").repartition(len(grid), "d", "kind", "size", "classes", "noise")

    def run(batches):
        for batch in batches:
            for r in batch.itertuples():
                yield pd.DataFrame([experiment(r.d, (r.kind, r.size), r.classes, 3, r.noise, 42 + r.d + r.classes, planes)])

    return rows.mapInPandas(run, EXPERIMENT)


def best_configuration(results: DataFrame) -> DataFrame:
    """Means over all experiments, and the configuration of greatest projection accuracy."""
    return results.agg(F.avg("hamming_accuracy").alias("hamming_accuracy"), F.avg("projection_accuracy").alias("projection_accuracy"), F.avg("two_stage_accuracy").alias("two_stage_accuracy"), F.avg("novelty_detection_rate").alias("novelty_detection_rate"), F.max_by(F.struct("d", "base", "num_classes", "noise_level"), F.struct("projection_accuracy", -F.col("d"), -F.col("num_classes"))).alias("best"))
