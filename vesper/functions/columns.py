"""Kernels as column functions: Arrow batches in, Arrow batches out.

Containers are BINARY columns. A null among the arguments gives null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kernels as K

PEAK = "array<struct<x:int,y:int,z:int,f:int,amp:float,phase:float>>"
READING = "struct<phase:float,amplitude:float>"
CONCEPT = "array<struct<x:int,y:int,z:int,freq:float>>"


def i8(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int8)


def u8(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


def by_batch(function: Callable, returns: str) -> Callable[..., Column]:
    """A column function over batches; made when it is first used, as types are read by the session."""
    made: list[Callable] = []

    def call(*columns: Column) -> Column:
        if not made:
            made.append(F.pandas_udf(function, returns))
        return made[0](*columns)

    return call


def by_row(function: Callable, returns: str) -> Callable[..., Column]:
    """A column function that calls `function` with each row's values; structs come as dicts."""

    def rows(columns: tuple) -> zip:
        return zip(*[c.to_dict("records") if isinstance(c, pd.DataFrame) else c for c in columns], strict=True)

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else function(*row) for row in rows(columns)], dtype=object)

    def run_struct(*columns: pd.Series) -> pd.DataFrame:
        names = [f.split(":")[0] for f in returns[7:-1].split(",")]
        return pd.DataFrame([dict.fromkeys(names) if any(x is None for x in row) else function(*row) for row in rows(columns)], columns=names)

    function_of = run_struct if returns.startswith("struct<") else run
    function_of.__annotations__ = {"columns": pd.Series, "return": pd.DataFrame if returns.startswith("struct<") else pd.Series}
    return by_batch(function_of, returns)


def _tuples(rows, *names) -> list[tuple]:
    return [tuple(r[n] for n in names) for r in rows]


# conversions between lenses

to_ints = by_row(lambda b: u8(b).astype(np.int32).tolist(), "array<int>")
to_signed = by_row(lambda b: i8(b).astype(np.int32).tolist(), "array<int>")
from_ints = by_row(lambda v: (np.asarray(v, np.int64) % 256).astype(np.uint8).tobytes(), "binary")
to_words = by_row(lambda b: np.frombuffer(b, "<i8").tolist(), "array<bigint>")



def _apply(values: pd.Series, places: pd.Series, masks: pd.Series) -> pd.Series:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate([np.zeros(0, np.int64), *values]).astype(np.int64)
    at = np.concatenate([np.zeros(0, np.int64), *places]).astype(np.int64) + np.repeat(ends[:-1], [len(p) for p in places])
    flat[at] ^= np.concatenate([np.zeros(0, np.int64), *masks]).astype(np.int64)
    return pd.Series([flat[i:j].tolist() for i, j in zip(ends[:-1], ends[1:], strict=True)], dtype=object)


_apply_compact = by_batch(_apply, "array<int>")


def apply_compact(vector: Column, changes: Column) -> Column:
    """An element vector with a compact delta (places differ) applied."""
    return F.when(vector.isNotNull() & changes.isNotNull(), _apply_compact(F.coalesce(vector, F.array().cast("array<int>")), F.coalesce(F.transform(changes, lambda c: c["pos"].cast("int")), F.array().cast("array<int>")), F.coalesce(F.transform(changes, lambda c: c["xor"].cast("int")), F.array().cast("array<int>"))))


def _stacked(containers: pd.Series) -> np.ndarray:
    return np.stack([i8(c) for c in containers])


def by_setting(kernel: Callable, *settings: pd.Series):
    """(rows, kernel's result) for each different combination of settings in a batch; rows without a null among them."""
    groups: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*settings, strict=True)):
        if not any(pd.isna(k) for k in key):
            groups.setdefault(key, []).append(i)
    for key, rows in groups.items():
        yield rows, kernel(rows, *key)


# carriers

def _encode(containers: pd.Series, freq: pd.Series, phase: pd.Series, amplitude: pd.Series) -> pd.Series:
    out = np.full(len(containers), None, object)
    some = containers.notna().to_numpy()
    for rows, samples in by_setting(lambda rows, f, p, a: K.carrier_samples(int(f), p, a), freq, phase, amplitude):
        rows = [r for r in rows if some[r]]
        if rows:
            for r, row in zip(rows, K.add_i8(_stacked(containers.iloc[rows]), samples[None, :]), strict=True):
                out[r] = row.tobytes()
    return pd.Series(out, dtype=object)


carrier_encode = by_batch(_encode, "binary")
focus_carrier_encode = by_row(lambda c, mx, my, mz, f, phase, amp: K.carrier_encode(i8(c), f, phase, amp, K.focus_mask(mx, my, mz)).tobytes(), "binary")
carrier_bundle = by_row(lambda rows: K.bundle_i8(np.stack([i8(r) for r in rows])).tobytes(), "binary")




def _decode(containers: pd.Series, freq: pd.Series) -> pd.DataFrame:
    phase, amplitude = K.carrier_decode(np.stack([i8(c) for c in containers])) if len(containers) else (np.zeros((0, 16)), np.zeros((0, 16)))
    at = np.arange(len(containers)), freq.to_numpy().astype(int)
    return pd.DataFrame({"phase": phase[at], "amplitude": amplitude[at]})


def _spectrum(containers: pd.Series) -> pd.Series:
    return pd.Series([row.tolist() for row in K.carrier_decode(np.stack([i8(c) for c in containers]))[1]] if len(containers) else [], dtype=object)


carrier_decode = by_batch(_decode, READING)
carrier_spectrum = by_batch(_spectrum, "array<float>")

# wavelets

gabor_write = by_row(lambda c, sigma, x, y, z, freq, phase, amp: K.gabor_write(i8(c), sigma, x, y, z, freq, phase, amp).tobytes(), "binary")
def _read(containers: pd.Series, sigma: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series, freq: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame({"phase": np.full(len(containers), np.nan), "amplitude": np.full(len(containers), np.nan)}).astype(object)
    some = containers.notna().to_numpy()
    for rows, reading in by_setting(lambda rows, s, *at: K.gabor_read(_stacked(containers.iloc[[r for r in rows if some[r]]]), s, *map(int, at[:3]), at[3]) if some[rows].any() else None, sigma, x, y, z, freq):
        rows = [r for r in rows if some[r]]
        if rows:
            out.iloc[rows, 0], out.iloc[rows, 1] = reading
    return out.where(out.notna(), None)


gabor_read = by_batch(_read, READING)
wavelet_template = by_row(lambda sigma, x, y, z: [{"idx": i, "amp": a} for i, a in K.wavelet_template(sigma, x, y, z)], "array<struct<idx:int,amp:int>>")
find_peaks = by_row(lambda c, sigma, threshold: [dict(zip(("x", "y", "z", "f", "amp", "phase"), p, strict=True)) for p in K.peaks(*K.spectrum(i8(c), sigma), threshold)], PEAK)
resynthesize = by_row(lambda found, sigma: K.resynthesize(_tuples(found, "x", "y", "z", "f", "amp", "phase"), sigma).tobytes(), "binary")
residual_energy = by_row(lambda c, known, sigma: K.residual_energy(i8(c), _tuples(known, "x", "y", "z", "freq"), sigma), "double")
clean_if_needed = by_row(lambda c, known, sigma, noise, clean: K.clean_if_needed(i8(c), _tuples(known, "x", "y", "z", "freq"), sigma, noise, clean)[0].tobytes(), "binary")
adapt_sigma = by_row(lambda c, sigma, x, y, z, freq, current, rate, target: K.adapt_sigma(i8(c), sigma, x, y, z, freq, current, rate, target), "double")
def _archetypes(containers: pd.Series, sigma: pd.Series, threshold: pd.Series) -> pd.Series:
    out = np.full(len(containers), None, object)
    some = containers.notna().to_numpy()
    for rows, found in by_setting(lambda rows, s, t: K.archetypes_of(_stacked(containers.iloc[[r for r in rows if some[r]]]), s, t) if some[rows].any() else [], sigma, threshold):
        for r, each in zip([r for r in rows if some[r]], found, strict=True):
            out[r] = [dict(zip(("x", "y", "f", "amp", "phase"), p, strict=True)) for p in each]
    return pd.Series(out, dtype=object)


archetypes = by_batch(_archetypes, "array<struct<x:int,y:int,f:int,amp:float,phase:float>>")
crystallize = by_row(lambda c, found, broad, crystal: K.crystallize(i8(c), _tuples(found, "x", "y", "f", "amp", "phase"), broad, crystal).tobytes(), "binary")
hebbian_update = by_row(lambda o, a, b, sigma, rate: K.add_i8(i8(o), K.hebbian(tuple(a), tuple(b), sigma, rate)).tobytes(), "binary")
flat_spectrum = by_row(lambda c, sigma, at: [[{"amplitude": a, "phase": p} for a, p in row] for row in K.flat_spectrum(i8(c), sigma, _tuples(at, "x", "y", "z"))], "array<array<struct<amplitude:float,phase:float>>>")
batch_flush = by_row(lambda c, writes: K.batch_flush(i8(c), _tuples(writes, "sigma", "x", "y", "z", "freq", "amplitude", "phase")).tobytes(), "binary")

#: All writes of a container in the order of the list, each added saturating.
write_all = by_row(lambda c, writes: _write_all(i8(c), writes).tobytes(), "binary")


def _write_all(container: np.ndarray, writes) -> np.ndarray:
    for w in writes:
        container = K.gabor_write(container, w["sigma"], w["x"], w["y"], w["z"], w["freq"], w["phase"], w["amplitude"])
    return container


#: Phase and amplitude of all 2048 places at the sixteen frequencies, place by place.
spectral_map = by_row(lambda c, sigma: dict(zip(("phase", "amplitude"), (a.ravel().tolist() for a in K.spectrum(i8(c), sigma)), strict=True)), "struct<phase:array<float>,amplitude:array<float>>")
#: Subtracts a concept's wavelet, as read at full strength `rate`.
anti_hebbian_update = by_row(lambda o, sigma, x, y, z, freq, phase, rate: K.gabor_write(i8(o), sigma, x, y, z, freq, phase, -rate).tobytes(), "binary")
#: Commits an overlay saturating, then cleans the container if it needs it.
flush_and_clean = by_row(lambda c, o, known, sigma, noise: K.clean_if_needed(K.add_i8(i8(c), i8(o)), _tuples(known, "x", "y", "z", "freq"), sigma, noise, 2.0)[0].tobytes(), "binary")
orthogonal_project = by_row(lambda c, templates: K.orthogonal_project(i8(c), np.stack([i8(t) for t in templates]) if len(templates) else np.zeros((0, K.SIZE), np.int8)).tobytes(), "binary")


def perturb(vector: Column, key: Column, noise: float, seed: int = 0) -> Column:
    """Integer vectors with Gaussian noise of that size added, rounded and clamped to bytes; the stream depends on seed and key."""

    def add(v, k) -> list[int]:
        x = np.asarray(v, np.float64)
        return np.clip(K.rounded(x + noise * K.SplitMix(K.fnv1a(f"{seed}:{k}")).gaussian(len(x))), -128, 127).astype(np.int32).tolist()

    return by_row(add, "array<int>")(vector, key)


# points in five dimensions


def project_5d(point: Column, seed: int) -> Column:
    return by_row(lambda p: K.project_5d(np.asarray([p], np.float64), seed)[0].tobytes(), "binary")(point)


def recover_5d(record: Column, seed: int) -> Column:
    return by_row(lambda r: K.recover_5d(u8(r)[None, :], seed)[0].tolist(), "array<double>")(record)


def concept_focus(concept: Column, density: str) -> Column:
    return by_row(lambda c: dict(zip(("mx", "my", "mz"), K.concept_focus(int(c), density), strict=True)), "struct<mx:int,my:int,mz:bigint>")(concept)


def fnv1a(text: Column) -> Column:
    """FNV-1a, as the signed long of the same bits."""
    return by_row(lambda t: K.fnv1a(t) - (1 << 64) if K.fnv1a(t) >> 63 else K.fnv1a(t), "bigint")(text)


# hyperplane fingerprints


def lsh(vector: Column, d: int, planes: int, seed: int) -> Column:
    """Packed sign bits of array vectors of d elements; rows of other lengths give null."""

    def project(vectors: pd.Series) -> pd.Series:
        ok = [v is not None and len(v) == d for v in vectors]
        out = np.full(len(vectors), None, object)
        if any(ok):
            bits = K.sign_bits(np.stack([np.asarray(v, np.float32) for v, good in zip(vectors, ok, strict=True) if good]), K.hyperplanes(d, planes, seed))
            out[np.flatnonzero(ok)] = [row.tobytes() for row in bits]
        return pd.Series(out, dtype=object)

    if planes % 8 or planes <= 0:
        raise ValueError("planes are a positive multiple of 8")
    return by_batch(project, "binary")(vector)


def _hamming(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else int(np.bitwise_count(u8(x) ^ u8(y)).sum()) for x, y in zip(a, b, strict=True)], dtype=object)


#: Differing bits of two binary columns of equal lengths.
hamming_bytes = by_batch(_hamming, "bigint")
