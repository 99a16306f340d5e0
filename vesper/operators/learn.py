"""Co-occurrence, axes by principal components, and moving concepts along them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K

#: Items whose matrix the driver decomposes at most.
MOST_ITEMS = 2048
#: Items and observations of each that make axes worth taking, and the move that counts as one.
READY_ITEMS, READY_TOTAL, MOVED = 8, 5, 1.0


def totals(observations: DataFrame, window: str = "window_id", item: str = "item") -> DataFrame:
    """(item, total): windows that hold each item."""
    return observations.select(window, item).distinct().groupBy(item).agg(F.count("*").cast("double").alias("total"))


def cooccurrence(observations: DataFrame, window: str = "window_id", item: str = "item") -> DataFrame:
    """(i, j, n), i < j: windows that hold both.

    The pairs of one window are counted, as they are the result; windows are sets
    of few items. Counting is partial before the shuffle.
    """
    sets = observations.select(window, item).distinct()
    a, b = sets.select(window, F.col(item).alias("i")), sets.select(window, F.col(item).alias("j"))
    return a.join(b, window).where("i < j").groupBy("i", "j").agg(F.count("*").cast("double").alias("n"))


def normalized(pairs: DataFrame, item_totals: DataFrame, item: str = "item") -> DataFrame:
    """(i, j, norm): n over the root of both totals, 0 where that is none."""
    left = item_totals.select(F.col(item).alias("i"), F.col("total").alias("ti"))
    right = item_totals.select(F.col(item).alias("j"), F.col("total").alias("tj"))
    base = F.sqrt(F.col("ti") * F.col("tj"))
    return pairs.join(left, "i").join(right, "j").select("i", "j", F.when(base > 0, F.col("n") / base).otherwise(0.0).alias("norm"))


def ready(item_totals: DataFrame) -> DataFrame:
    """One row: whether enough items have been seen often enough."""
    return item_totals.agg((F.count_if(F.col("total") >= READY_TOTAL) >= READY_ITEMS).alias("ready"))


@dataclass
class Axes:
    """Three axes over k items, their eigenvalues, and the items' places in the 8 x 8 x 32 grid."""

    axes: np.ndarray
    eigenvalues: np.ndarray
    coords: np.ndarray


def power_iteration(matrix: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Leading eigenvector from the uniform start, and its value."""
    k = len(matrix)
    v = np.full(k, 1 / np.sqrt(max(k, 1)))
    for _ in range(rounds):
        w = matrix @ v
        size = np.sqrt((w * w).sum())
        if size < 1e-10:
            break
        v = w / size
    return v, float(v @ (matrix @ v))


def to_grid(coords: np.ndarray) -> np.ndarray:
    """Each axis stretched to 0..7, 0..7, 0..31; a constant one lies in the middle."""
    out = np.empty(coords.shape, np.float32)
    for d, top in enumerate((7.0, 7.0, 31.0)):
        low, high = coords[:, d].min(), coords[:, d].max()
        out[:, d] = top / 2 if high - low < 1e-10 else (coords[:, d] - low) / (high - low) * top
    return out


def crystallize_matrix(norm: np.ndarray) -> Axes:
    """Three leading components, one taken away before the next; in double precision, so that rounding doesn't add up over the rounds."""
    norm = norm.astype(np.float64)
    left, axes, values = norm.copy(), [], []
    for _ in range(3):
        v, value = power_iteration(left)
        axes.append(v)
        values.append(value)
        left = left - value * np.outer(v, v)
    stacked = np.stack(axes)
    coords = norm @ stacked.T
    return Axes(stacked.astype(np.float32), np.array(values, np.float32), to_grid(coords) if len(coords) else coords.astype(np.float32))


def matrix_of(pairs: DataFrame, k: int) -> np.ndarray:
    """The symmetric matrix of (i, j, norm) rows of items 0..k-1."""
    if k > MOST_ITEMS:
        raise ValueError(f"axes are taken from {MOST_ITEMS} items at most")
    out = np.zeros((k, k))
    rows = pairs.select("i", "j", "norm").toArrow()
    i, j, norm = (rows.column(c).to_numpy() for c in range(3))
    out[i, j] = out[j, i] = norm
    return out


def crystallize(pairs: DataFrame, item_totals: DataFrame, k: int) -> Axes:
    return crystallize_matrix(matrix_of(normalized(pairs, item_totals), k))


def crystallize_from_superposition(container: np.ndarray) -> Axes:
    """Axes of the sixteen carriers from the products of a container demodulated by each."""
    signals = container.astype(np.float32)[None, :] * K.carriers()[0].astype(np.float32)
    cross = signals @ signals.T
    size = np.maximum(np.diag(cross), 1.0)
    return crystallize_matrix(np.maximum(cross, 0.0) / np.sqrt(size[:, None] * size[None, :]))


def assign_frequencies(coords: np.ndarray, sigma: float = 2.0) -> list[int]:
    """For each place in turn the lowest of sixteen frequencies that none within 2 sigma has; 0 if all are taken."""
    out: list[int] = []
    for i, c in enumerate(coords):
        near = ((coords[:i] - c) ** 2).sum(axis=1) < (2 * sigma) ** 2
        used = {f for f, n in zip(out, near, strict=True) if n}
        out.append(next((f for f in range(16) if f not in used), 0))
    return out


def cell(coord: np.ndarray) -> tuple[int, int, int]:
    x, y, z = K.rounded(np.asarray(coord, np.float32))
    return int(np.clip(x, 0, 7)), int(np.clip(y, 0, 7)), int(np.clip(z, 0, 31))


def migrate(container: np.ndarray, axes: Axes, sigma: float) -> tuple[np.ndarray, list[int]]:
    """A container whose carriers, up to sixteen, are wavelets at their items' places; carriers under 0.01 are left out."""
    phase, amplitude = K.carrier_decode(container[None, :])
    freqs = assign_frequencies(axes.coords)
    out = np.zeros_like(container)
    for i in range(min(16, len(axes.coords))):
        if amplitude[0, i] >= 0.01:
            out = K.gabor_write(out, sigma, *cell(axes.coords[i]), K.FREQUENCIES[freqs[i]], float(phase[0, i]), float(amplitude[0, i]))
    return out, freqs


def update_axes(old: Axes, norm: np.ndarray, rate: float) -> tuple[Axes, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Axes turned towards those of a new matrix by `rate`, and (item, old place, new place) of all that move by over MOVED."""
    new = crystallize_matrix(norm).axes
    sign = np.where((old.axes * new).sum(axis=1) < 0, -1, 1)[:, None]
    turned = old.axes + np.float32(rate) * (new * sign - old.axes)
    size = np.sqrt((turned * turned).sum(axis=1, keepdims=True))
    turned = np.where(size > 1e-10, turned / np.maximum(size, 1e-10), turned)
    coords = to_grid(norm.astype(np.float32) @ turned.T)
    far = np.sqrt(((coords - old.coords) ** 2).sum(axis=1)) > MOVED
    return Axes(turned, old.eigenvalues, coords), [(int(i), old.coords[i], coords[i]) for i in np.flatnonzero(far)]


def apply_moves(container: np.ndarray, moves: list[tuple[int, np.ndarray, np.ndarray]], freqs: list[int], sigma: float) -> np.ndarray:
    """Moved items read, taken out and written at their new places, in order."""
    for i, old, new in moves:
        freq = K.FREQUENCIES[freqs[i]]
        phase, amplitude = K.gabor_read_one(container, sigma, *cell(old), freq)
        container = K.gabor_write(container, sigma, *cell(old), freq, phase, -amplitude)
        container = K.gabor_write(container, sigma, *cell(new), freq, phase, amplitude)
    return container
