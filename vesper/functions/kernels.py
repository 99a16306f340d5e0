"""Array kernels in numpy for 2048-byte containers, templates and random streams.

Waveform kernels work in single precision where the published semantics do, and
round halves away from zero. Each takes and returns whole arrays; the Arrow
functions of `columns.py` apply them to batches.
"""

from __future__ import annotations

import math
from functools import cache, lru_cache

import numpy as np

SIZE = 2048
#: Carrier frequencies, and a carrier's amplitude.
FREQUENCIES = (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1024)
AMPLITUDE = 7.0
#: Envelope under which a wavelet's sample is left out.
LEAST_ENVELOPE = 0.004
TAU32 = np.float32(2 * math.pi)


def rounded(x: np.ndarray) -> np.ndarray:
    """Nearest integers, halves away from zero."""
    return np.sign(x) * np.floor(np.abs(x) + np.asarray(0.5, x.dtype))


def to_i8(x: np.ndarray) -> np.ndarray:
    return np.clip(rounded(x), -128, 127).astype(np.int8)


def add_i8(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Saturating sum."""
    return np.clip(a.astype(np.int16) + b, -128, 127).astype(np.int8)


def turn(phase: np.ndarray) -> np.ndarray:
    """Angles in single precision, from 0 to a full turn."""
    return np.mod(np.asarray(phase, np.float32), TAU32)


# ---- random streams


class SplitMix:
    """SplitMix64 by counter: the n-th value depends on seed and n alone."""

    GAMMA = 0x9E3779B97F4A7C15

    def __init__(self, seed: int):
        self.state = seed % (1 << 64)

    def take(self, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            z = np.uint64(self.state) + np.uint64(self.GAMMA) * np.arange(1, n + 1, dtype=np.uint64)
            self.state = (self.state + self.GAMMA * n) % (1 << 64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return z ^ (z >> np.uint64(31))

    def integers(self, low: int, high: int, n: int) -> np.ndarray:
        """Uniform integers, both ends included."""
        return (low + (self.take(n) % np.uint64(high - low + 1)).astype(np.int64)).astype(np.int8)

    def uniform(self, n: int) -> np.ndarray:
        return (self.take(n) >> np.uint64(11)).astype(np.float64) / float(1 << 53)

    def gaussian(self, n: int) -> np.ndarray:
        """Box-Muller; two draws for each value."""
        u = self.uniform(2 * n)
        return np.sqrt(-2 * np.log(1 - u[0::2])) * np.cos(2 * math.pi * u[1::2])


def fnv1a(text: str) -> int:
    value = 0xCBF29CE484222325
    for b in text.encode():
        value = (value ^ b) * 0x100000001B3 % (1 << 64)
    return value


# ---- bases of templates


def base_range(base: tuple[str, int]) -> tuple[int, int]:
    kind, size = base
    return (0, 1) if kind == "binary" else (0, size - 1) if kind == "unsigned" else (-(size // 2), size // 2)


def base_bits(base: tuple[str, int], d: int) -> int:
    """Storage of a vector: bits to hold one of the base's values, times d."""
    return max(1, math.ceil(math.log2(2 if base[0] == "binary" else base[1]))) * d


def bind(a: np.ndarray, b: np.ndarray, base: tuple[str, int]) -> np.ndarray:
    kind, size = base
    if kind == "binary":
        return a ^ b
    total = a.astype(np.int16) + b
    return (total % size if kind == "unsigned" else np.clip(total, -(size // 2), size // 2)).astype(np.int8)


def quantized(x: np.ndarray, base: tuple[str, int]) -> np.ndarray:
    return np.clip(rounded(x), *base_range(base)).astype(np.int8)


# ---- phase vectors in five dimensions


@cache
def basis_5d(seed: int) -> np.ndarray:
    return SplitMix(seed).take(5 * SIZE // 8).astype("<u8").view(np.uint8).reshape(5, SIZE)


def project_5d(points: np.ndarray, seed: int) -> np.ndarray:
    """Rows of five coordinates to phase vectors; what rounds to 256 is 255."""
    total = np.zeros((len(points), SIZE))
    for d, row in enumerate(basis_5d(seed)):  # in the order of dimensions, as sums round
        total += points[:, d, None] * row[None, :].astype(np.float64)
    return np.minimum(rounded(np.mod(total, 256.0)), 255).astype(np.uint8)


def recover_5d(records: np.ndarray, seed: int) -> np.ndarray:
    """Mean angle to each basis vector, as parts of a turn."""
    out = np.empty((len(records), 5))
    for d, row in enumerate(basis_5d(seed)):
        angle = (records - row[None, :]).astype(np.float64) * (2 * math.pi / 256)
        out[:, d] = np.mod(np.arctan2(np.sin(angle).sum(1), np.cos(angle).sum(1)), 2 * math.pi) / (2 * math.pi)
    return out


# ---- focus


#: Bits of the x, y and z masks by density.
DENSITIES = {"sparse": (1, 1, 4), "medium": (2, 2, 8), "broad": (4, 4, 16)}


def concept_focus(concept: int, density: str) -> tuple[int, int, int]:
    """Masks of a concept: for x, y and z in turn, distinct bits drawn without replacement."""
    stream = SplitMix(concept)
    masks = []
    for total, count in zip((8, 8, 32), DENSITIES[density], strict=True):
        left, mask = list(range(total)), 0
        for i, draw in enumerate(stream.take(count).tolist()):
            j = i + draw % (total - i)
            left[i], left[j] = left[j], left[i]
            mask |= 1 << left[i]
        masks.append(mask)
    return masks[0], masks[1], masks[2]


def focus_mask(mx: int, my: int, mz: int) -> np.ndarray:
    bits = lambda m, n: (m >> np.arange(n)) & 1
    return (bits(mx, 8)[:, None, None] & bits(my, 8)[None, :, None] & bits(mz, 32)[None, None, :]).astype(bool).ravel()


# ---- carriers


@cache
def carriers() -> np.ndarray:
    """(2, 16, 2048) cosine and sine carriers by the Chebyshev recurrence."""
    out = np.empty((2, 16, SIZE), np.int8)
    for f, freq in enumerate(FREQUENCIES):
        omega = 2 * math.pi * freq / SIZE
        for k, (before, now) in enumerate(((math.cos(-omega), 1.0), (math.sin(-omega), 0.0))):
            wave = np.empty(SIZE)
            for j in range(SIZE):
                wave[j] = now
                before, now = now, 2 * math.cos(omega) * now - before
            out[k, f] = np.clip(rounded(wave * AMPLITUDE), -128, 127)
    return out


def carrier_samples(freq: int, phase: float, amplitude: float) -> np.ndarray:
    cos, sin = carriers()[:, freq].astype(np.float32)
    p = float(np.float32(phase))
    return to_i8((np.float32(math.cos(p)) * cos - np.float32(math.sin(p)) * sin) * (np.float32(amplitude) / np.float32(AMPLITUDE)))


def carrier_encode(container: np.ndarray, freq: int, phase: float, amplitude: float, mask: np.ndarray | None = None) -> np.ndarray:
    """Adds a carrier, saturating; inside the mask only, if there is one."""
    samples = carrier_samples(freq, phase, amplitude)
    return add_i8(container, samples if mask is None else np.where(mask, samples, 0))


def carrier_decode(containers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phase, amplitude) of each row at each of the sixteen frequencies."""
    cos, sin = carriers().astype(np.float64)
    x = containers.astype(np.float64)
    c, s = x @ cos.T / SIZE, x @ sin.T / SIZE
    return turn(np.arctan2(-s, c)), np.sqrt(c * c + s * s).astype(np.float32)


def bundle_i8(rows: np.ndarray) -> np.ndarray:
    """Saturating sum in order."""
    out = np.zeros(rows.shape[1], np.int8)
    for row in rows:
        out = add_i8(out, row)
    return out


# ---- wavelets in the 8 x 8 x 32 volume


@cache
def envelope(sigma: float) -> np.ndarray:
    """Gaussian of squared distances 0 to 1059, in 255ths."""
    s = np.float32(2.0) * np.float32(sigma) * np.float32(sigma)
    share = np.exp((-np.arange(1060, dtype=np.float32) / s).astype(np.float64)).astype(np.float32)
    return np.minimum(rounded(share * np.float32(255)), 255).astype(np.uint8)


def radius2(sigma: float) -> int:
    return math.ceil(np.float32(3.0) * (np.float32(2.0) * np.float32(sigma) * np.float32(sigma)))


@cache
def volume(x0: int, y0: int, z0: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and sums of offsets of all places from a centre."""
    dx, dy, dz = np.arange(8) - x0, np.arange(8) - y0, np.arange(32) - z0
    square = dx[:, None, None] ** 2 + dy[None, :, None] ** 2 + dz[None, None, :] ** 2
    return square.ravel(), (dx[:, None, None] + dy[None, :, None] + dz[None, None, :]).ravel()


def places(sigma: float, x0: int, y0: int, z0: int, cut: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index, envelope and offset sum of the places that a wavelet touches. cut: within its effective radius only."""
    square, along = volume(x0, y0, z0)
    env = envelope(sigma)[square].astype(np.float32) / np.float32(255)
    ok = env >= np.float32(LEAST_ENVELOPE)
    if cut:
        ok &= square <= radius2(sigma)
    at = np.flatnonzero(ok)
    return at, env[at], along[at]


def wavelet_template(sigma: float, x0: int, y0: int, z0: int) -> list[tuple[int, int]]:
    """(index, amplitude) of all places within the radius, amplitude 1 to 255."""
    square, _ = volume(x0, y0, z0)
    env = envelope(sigma)[square]
    at = np.flatnonzero((square <= radius2(sigma)) & (env >= 1))
    return list(zip(at.tolist(), env[at].tolist(), strict=True))


def wave(along: np.ndarray, freq: float, phase: float = 0.0) -> np.ndarray:
    """Carrier phase along the diagonal."""
    return TAU32 * (np.float32(freq) * along.astype(np.float32) / np.float32(32)) + np.float32(phase)


def cosine(angle: np.ndarray) -> np.ndarray:
    """The nearest single-precision values, whatever the library makes of single-precision angles."""
    return np.cos(angle.astype(np.float64)).astype(np.float32)


def gabor_write(container: np.ndarray, sigma: float, x0: int, y0: int, z0: int, freq: float, phase: float, amplitude: float) -> np.ndarray:
    at, env, along = places(sigma, x0, y0, z0)
    out = container.copy()
    out[at] = add_i8(out[at], to_i8(np.float32(amplitude) * env * cosine(wave(along, freq, phase))))
    return out


@lru_cache(maxsize=1024)
def reader(sigma: float, x0: int, y0: int, z0: int, freq: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Index, a column of weights for each of cosine and sine, and the sum of squared envelopes."""
    at, env, along = places(sigma, x0, y0, z0)
    e = envelope(sigma)[volume(x0, y0, z0)[0][at]].astype(np.float64) / 255
    angle = wave(along, freq).astype(np.float64)
    return at, np.stack([e * np.cos(angle), e * np.sin(angle)], axis=1), float((e * e).sum())


def gabor_read(containers: np.ndarray, sigma: float, x0: int, y0: int, z0: int, freq: float) -> tuple[np.ndarray, np.ndarray]:
    """(phase, amplitude) of each row; (0, 0) where the wavelet has no weight."""
    at, weights, total = reader(sigma, x0, y0, z0, freq)
    if total < 1e-10:
        return np.zeros(len(containers), np.float32), np.zeros(len(containers), np.float32)
    sums = containers[:, at].astype(np.float64) @ weights
    c, s = sums[:, 0], sums[:, 1]
    return turn(np.arctan2(-s, c)), (np.sqrt(c * c + s * s) * 2 / total).astype(np.float32)


def gabor_read_one(container: np.ndarray, sigma: float, x0: int, y0: int, z0: int, freq: float) -> tuple[float, float]:
    phase, amplitude = gabor_read(container[None, :], sigma, x0, y0, z0, freq)
    return float(phase[0]), float(amplitude[0])


@cache
def _spectrum_weights(sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """All 2048 places times 16 frequencies: weights by index (2048 x 65536 would not fit; kept by place)."""
    cos = np.zeros((SIZE, SIZE), np.float32)  # envelope by place and index
    for p in range(SIZE):
        at, env, _ = places(sigma, p >> 8, (p >> 5) & 7, p & 31)
        cos[p, at] = env
    return cos, (cos.astype(np.float64) ** 2).sum(axis=1)


def spectrum(container: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """(phase, amplitude), each (2048, 16): every place read at every frequency.

    The carrier of an offset is that of the place turned back by the centre's, so
    sums over a centre's surroundings are one product with the envelopes.
    """
    env, total = _spectrum_weights(sigma)
    along = (np.arange(8)[:, None, None] + np.arange(8)[None, :, None] + np.arange(32)[None, None, :]).ravel().astype(np.float64)
    phase, amplitude = np.empty((SIZE, 16), np.float32), np.empty((SIZE, 16), np.float32)
    for f, freq in enumerate(FREQUENCIES):
        angle = 2 * math.pi * (freq % 32) * along / 32
        both = env.astype(np.float64) @ (container.astype(np.float64)[:, None] * np.stack([np.cos(angle), np.sin(angle)], axis=1))
        c = both[:, 0] * np.cos(angle) + both[:, 1] * np.sin(angle)
        s = both[:, 1] * np.cos(angle) - both[:, 0] * np.sin(angle)
        phase[:, f], amplitude[:, f] = turn(np.arctan2(-s, c)), np.sqrt(c * c + s * s) * 2 / np.maximum(total, 1e-10)
    return phase, amplitude


def neighbourhood_max(cube: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    """Maximum over each place and its neighbours along these axes."""
    for axis in axes:
        pad = [(1, 1) if a == axis else (0, 0) for a in range(cube.ndim)]
        wide = np.pad(cube, pad, constant_values=-np.inf)
        n = cube.shape[axis]
        cube = np.maximum.reduce([np.take(wide, range(k, k + n), axis) for k in range(3)])
    return cube


def peaks(phase: np.ndarray, amplitude: np.ndarray, threshold: float) -> list[tuple[int, int, int, int, float, float]]:
    """(x, y, z, frequency index, amplitude, phase) of local maxima of at least the threshold, in that order."""
    cube = amplitude.reshape(8, 8, 32, 16)
    found = np.argwhere((cube >= threshold) & (cube >= neighbourhood_max(cube, (0, 1, 2))))
    return [(int(x), int(y), int(z), int(f), float(cube[x, y, z, f]), float(phase.reshape(8, 8, 32, 16)[x, y, z, f])) for x, y, z, f in found]


def resynthesize(found: list[tuple[int, int, int, int, float, float]], sigma: float) -> np.ndarray:
    out = np.zeros(SIZE, np.int8)
    for x, y, z, f, amplitude, phase in found:
        out = gabor_write(out, sigma, x, y, z, FREQUENCIES[f], phase, amplitude)
    return out


def residual_energy(container: np.ndarray, known: list[tuple[int, int, int, float]], sigma: float) -> float:
    """Sum of squares after subtracting each known concept in turn, as read."""
    rest = container
    for x, y, z, freq in known:
        phase, amplitude = gabor_read_one(rest, sigma, x, y, z, freq)
        rest = gabor_write(rest, sigma, x, y, z, freq, phase, -amplitude)
    return float((rest.astype(np.float64) ** 2).sum())


def clean_if_needed(container: np.ndarray, known: list[tuple[int, int, int, float]], sigma: float, noise: float, clean_sigma: float) -> tuple[np.ndarray, bool]:
    if residual_energy(container, known, sigma) / SIZE <= noise:
        return container, False
    return resynthesize(peaks(*spectrum(container, 4.0), np.float32(math.sqrt(noise) * 0.5)), clean_sigma), True


def hebbian(a: tuple[int, int, int, float], b: tuple[int, int, int, float], sigma: float, rate: float) -> np.ndarray:
    """Interference of two concepts as samples to add."""
    out = np.zeros(SIZE, np.int8)
    signal = []
    for x, y, z, freq in (a, b):
        at, env, along = places(sigma, x, y, z, cut=False)
        whole = np.zeros(SIZE, np.float32)
        whole[at] = env * cosine(wave(along, freq))
        touched = np.zeros(SIZE, bool)
        touched[at] = True
        signal.append((whole, touched))
    both = signal[0][1] & signal[1][1]
    out[both] = to_i8(np.float32(rate) * (signal[0][0][both] * signal[1][0][both]) * np.float32(127))
    return out


def adapt_sigma(container: np.ndarray, sigma: float, x0: int, y0: int, z0: int, freq: float, current: float, rate: float, target: float) -> float:
    _, amplitude = gabor_read_one(container, sigma, x0, y0, z0, freq)
    _, noise = gabor_read_one(container, sigma, (x0 + 4) % 8, y0, (z0 + 16) % 32, freq)
    snr = np.float32(amplitude) / np.float32(noise) if noise > 1e-6 else np.float32(amplitude) * np.float32(100)
    return float(np.clip(np.float32(current) * (np.float32(1) - np.float32(rate) * (snr - np.float32(target))), 0.5, 4.0))


def archetypes_of(containers: np.ndarray, sigma: float, threshold: float, z: int = 16) -> list[list[tuple[int, int, int, float, float]]]:
    """By row: (x, y, frequency index, amplitude, phase) of local maxima over the threshold in the plane z."""
    phase, amplitude = np.empty((len(containers), 8, 8, 16), np.float32), np.empty((len(containers), 8, 8, 16), np.float32)
    for x in range(8):
        for y in range(8):
            for f, freq in enumerate(FREQUENCIES):
                phase[:, x, y, f], amplitude[:, x, y, f] = gabor_read(containers, sigma, x, y, z, freq)
    top = (amplitude > threshold) & (amplitude >= neighbourhood_max(amplitude, (1, 2)))
    return [[(int(x), int(y), int(f), float(a[x, y, f]), float(p[x, y, f])) for x, y, f in np.argwhere(t)] for t, a, p in zip(top, amplitude, phase, strict=True)]


def archetypes(container: np.ndarray, sigma: float, threshold: float, z: int = 16) -> list[tuple[int, int, int, float, float]]:
    return archetypes_of(container[None, :], sigma, threshold, z)[0]


def crystallize(container: np.ndarray, found: list[tuple[int, int, int, float, float]], broad: float, crystal: float) -> np.ndarray:
    """Archetypes taken out with the broad width, then put in with the narrow one."""
    for sigma, sign in ((broad, -1), (crystal, 1)):
        for x, y, f, amplitude, phase in found:
            container = gabor_write(container, sigma, x, y, 16, FREQUENCIES[f], phase, sign * amplitude)
    return container


def flat_spectrum(container: np.ndarray, sigma: float, at: list[tuple[int, int, int]]) -> list[list[tuple[float, float]]]:
    """(amplitude, phase) by position and frequency: envelope-weighted samples against the flat carriers."""
    cos, sin = carriers().astype(np.float32)
    out = []
    for x, y, z in at:
        weighted = container.astype(np.float32) * (envelope(sigma)[volume(x, y, z)[0]].astype(np.float32) / np.float32(255))
        c, s = cos @ weighted, sin @ weighted
        out.append([(float(a), float(p)) for a, p in zip(np.sqrt(c * c + s * s), turn(np.arctan2(-s, c)), strict=True)])
    return out


def batch_flush(container: np.ndarray, writes: list[tuple[float, int, int, int, float, float, float]]) -> np.ndarray:
    """All writes (sigma, x, y, z, frequency, amplitude, phase) summed, rounded once, then added saturating."""
    total = np.zeros(SIZE, np.float32)
    for sigma, x, y, z, freq, amplitude, phase in writes:
        at, env, along = places(sigma, x, y, z, cut=False)
        total[at] += np.float32(amplitude) * (env * cosine(wave(along, freq, phase)))
    return add_i8(container, to_i8(total))


# ---- linear algebra


def cholesky_solve(gram: np.ndarray, rhs: np.ndarray, least: float = 1e-12, floor: float = 1e-6) -> np.ndarray:
    """Solution of a symmetric system; pivots not over `least` count as `floor`."""
    low = cholesky(gram, least, floor)
    k = len(rhs)
    y = np.zeros(k)
    for i in range(k):
        y[i] = (rhs[i] - low[i, :i] @ y[:i]) / low[i, i]
    x = np.zeros(k)
    for i in range(k - 1, -1, -1):
        x[i] = (y[i] - low[i + 1 :, i] @ x[i + 1 :]) / low[i, i]
    return x


def cholesky(gram: np.ndarray, least: float = 1e-12, floor: float = 1e-6) -> np.ndarray:
    k = len(gram)
    low = np.zeros((k, k))
    for i in range(k):
        for j in range(i):
            low[i, j] = (gram[i, j] - low[i, :j] @ low[j, :j]) / low[j, j]
        pivot = gram[i, i] - low[i, :i] @ low[i, :i]
        low[i, i] = math.sqrt(pivot) if pivot > least else floor
    return low


def condition_number(gram: np.ndarray) -> float:
    if not len(gram):
        return 1.0
    diagonal = np.diag(cholesky(gram))
    return float(np.finfo(np.float64).max) if diagonal.min() < 1e-12 else float((diagonal.max() / diagonal.min()) ** 2)


def orthogonal_project(container: np.ndarray, templates: np.ndarray) -> np.ndarray:
    """Projection on the span of templates, each term rounded and the running sum clamped."""
    if not len(templates):
        return container
    t = templates.astype(np.float64)
    weights = cholesky_solve(t @ t.T, t @ container.astype(np.float64), 0.0, 1e-10)
    out = np.zeros(container.shape)
    for w, row in zip(weights, t, strict=True):
        out = np.clip(out + rounded(w * row), -128, 127)
    return out.astype(np.int8)


def gram_schmidt(query: np.ndarray, templates: np.ndarray, order: list[int] | None = None) -> tuple[np.ndarray, float]:
    """Scores by template, each taken from what the earlier ones left, and the share of energy left over."""
    rest = query.astype(np.float32)
    size = lambda x: float(np.dot(x.astype(np.float64), x.astype(np.float64)))
    energy = size(rest)
    scores = np.zeros(len(templates), np.float32)
    for i in order if order is not None else range(len(templates)):
        t = templates[i].astype(np.float64)
        norm = float(t @ t)
        if norm >= 1e-10:
            scores[i] = np.float32((rest.astype(np.float64) @ t) / norm)
            rest = rest - scores[i] * t.astype(np.float32)
    return scores, size(rest) / energy if energy > 1e-10 else 1.0


@cache
def hyperplanes(d: int, planes: int, seed: int) -> np.ndarray:
    rows = SplitMix(seed).gaussian(planes * d).reshape(planes, d).astype(np.float32)
    sizes = np.sqrt(np.einsum("ij,ij->i", rows, rows, dtype=np.float64))
    return (rows / np.maximum(sizes, 1e-10)[:, None]).astype(np.float32)


def sign_bits(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Packed bits by row, first plane highest: 1 where the product isn't negative."""
    bits = [x.astype(np.float64) @ planes[lo : lo + 4096].astype(np.float64).T >= 0 for lo in range(0, len(planes), 4096)]
    return np.packbits(np.concatenate(bits, axis=1), axis=1)
