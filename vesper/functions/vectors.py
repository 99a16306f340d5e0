"""Native expressions over vectors: array columns of integers or words in, columns out.

Element vectors are array<int> (bytes as 0..255, waveforms as -128..127), word
vectors array<bigint> (64 bits to a word). Everything here stays in the JVM and
has a DuckDB twin in the query catalogue. A null vector gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda t, x: t + x)


def half_up(x: Column) -> Column:
    """Nearest integer, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


# phase algebra: bytes are angles, 256 to a turn


def phase_bind(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: F.pmod(x + y, F.lit(256)))


def phase_unbind(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: F.pmod(x - y, F.lit(256)))


def phase_inverse(a) -> Column:
    return F.transform(_c(a), lambda x: F.pmod(-x, F.lit(256)))


def histogram16(a) -> Column:
    """Counts of the sixteen high nibbles."""
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: F.size(F.filter(_c(a), lambda x: F.floor(x / 16) == b)))


def sort_phase(a) -> Column:
    """struct<sorted, perm>: ascending, equal values in their order; perm has where each came from."""
    pairs = F.array_sort(F.transform(_c(a), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.struct(F.transform(pairs, lambda p: p["x"]).alias("sorted"), F.transform(pairs, lambda p: p["i"]).alias("perm"))


def unsort_phase(ordered, perm) -> Column:
    """Undoes sort_phase; null without a permutation."""
    pairs = F.array_sort(F.zip_with(_c(perm), _c(ordered), lambda i, x: F.struct(i.alias("i"), x.alias("x"))))
    return F.transform(pairs, lambda p: p["x"])


# binary and waveform algebra


def xor(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.bitwiseXOR(y))


def masked(a, mask) -> Column:
    return F.zip_with(_c(a), _c(mask), lambda x, y: x.bitwiseAND(y))


def wrapping_sub_i8(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: F.pmod(x - y + 128, F.lit(256)) - 128)


def saturating_add_i8(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: F.greatest(F.lit(-128), F.least(F.lit(127), x + y)))


def is_clean(a) -> Column:
    return F.forall(_c(a), lambda x: x == 0)


def popcount(a) -> Column:
    return _total(F.transform(_c(a), lambda x: F.bit_count(x).cast("long")))


# distances


def hamming(a, b) -> Column:
    """Differing bits of two word vectors."""
    return popcount(xor(a, b))


def l1(a, b) -> Column:
    """Sum of absolute differences: Wasserstein-1 of sorted vectors, L1 of waveforms."""
    return _total(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y).cast("long")))


def circular(a, b) -> Column:
    def around(x, y):
        d = F.abs(x - y)
        return F.least(d, 256 - d).cast("long")

    return _total(F.zip_with(_c(a), _c(b), around))


def dot(a, b) -> Column:
    return _total(F.zip_with(_c(a), _c(b), lambda x, y: (x * y).cast("long")))


def norm2(a) -> Column:
    return dot(a, a)


def cosine(a, b, floor: float | None = 1e-10) -> Column:
    """Cosine of integer vectors; the product of norms is floored. floor None: 0 where a norm is under 1e-10."""
    product = F.sqrt(norm2(a).cast("double")) * F.sqrt(norm2(b).cast("double"))
    if floor is None:
        return F.when((norm2(a) == 0) | (norm2(b) == 0), F.lit(0.0)).otherwise(dot(a, b) / product)
    return dot(a, b) / F.greatest(product, F.lit(floor))


def pearson(a, b) -> Column:
    """Correlation of integer vectors, 0 where a variance is none."""
    n = F.size(_c(a)).cast("double")
    total = lambda v: _total(F.transform(_c(v), lambda x: x.cast("long"))).cast("double")
    cov = dot(a, b) - total(a) * total(b) / n
    variances = (norm2(a) - total(a) * total(a) / n) * (norm2(b) - total(b) * total(b) / n)
    return F.when(variances > 1e-20, cov / F.sqrt(variances)).otherwise(F.lit(0.0))


def l1_float(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda t, x: t + x)


# quantising


def quantize(a, low: int, high: int) -> Column:
    return F.transform(_c(a), lambda x: clamp(half_up(x), low, high).cast("int"))


def bind(a, b, base: tuple[str, int]) -> Column:
    """By base: ("binary", 2) exclusive or, ("unsigned", b) sum modulo b, ("signed", b) sum clamped to its range."""
    kind, size = base
    if kind == "binary":
        return xor(a, b)
    if kind == "unsigned":
        return F.zip_with(_c(a), _c(b), lambda x, y: F.pmod(x + y, F.lit(size)))
    half = size // 2
    return F.zip_with(_c(a), _c(b), lambda x, y: F.greatest(F.lit(-half), F.least(F.lit(half), x + y)))


def bundle_row(vectors: Column, base: tuple[str, int]) -> Column:
    """Of an array of vectors: majority by position (ties 1) for binary, clamped sum for signed, sum modulo b for unsigned."""
    kind, size = base
    first = F.transform(F.get(vectors, F.lit(0)), lambda x: x * 0)
    sums = F.aggregate(vectors, first, lambda t, v: F.zip_with(t, v, lambda x, y: x + y))
    if kind == "binary":
        return F.transform(sums, lambda x: F.when(2 * x >= F.size(vectors), 1).otherwise(0))
    if kind == "unsigned":
        return F.transform(sums, lambda x: F.pmod(x, F.lit(size)))
    half = size // 2
    return F.transform(sums, lambda x: F.greatest(F.lit(-half), F.least(F.lit(half), x)))


def downsample(a, size: int, low: int, high: int) -> Column:
    """Means of groups of len div size elements (one at least), rounded and clamped; a rest is dropped, missing groups are 0."""
    group = F.greatest(F.floor(F.size(_c(a)) / size).cast("int"), F.lit(1))

    def mean(i):
        part = F.slice(_c(a), i * group + 1, group)
        total = F.aggregate(part, F.lit(0.0), lambda t, x: t + x)
        return F.when(F.size(part) > 0, clamp(half_up(total / F.size(part)), low, high)).otherwise(0).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), mean)


def upsample(a, size: int) -> Column:
    """Linear interpolation to so many elements."""
    n = F.size(_c(a))

    def at(j):
        place = j * n / F.lit(float(size))
        low = F.least(F.floor(place).cast("int"), n - 1)
        part = place - F.floor(place)
        return F.get(_c(a), low) * (1 - part) + F.get(_c(a), F.least(low + 1, n - 1)) * part

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at)).otherwise(F.array_repeat(F.lit(0.0), size))


def sampled_l1(a, b, parts: int) -> Column:
    """L1 over every parts-th element, as many as a parts-th of the length (one step at least)."""
    count = F.greatest(F.floor(F.size(_c(a)) / parts), F.lit(1)).cast("int")
    step = F.floor(F.size(_c(a)) / count).cast("int")
    return _total(F.transform(F.sequence(F.lit(0), count - 1), lambda j: F.abs(F.get(_c(a), j * step) - F.get(_c(b), j * step)).cast("long")))


# focus addresses: masks over 8 x 8 x 32 bytes


def bit(n: Column) -> Column:
    """The n-th bit as a long."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def pack_focus(mx, my, mz) -> Column:
    return _c(mx).cast("long").bitwiseOR(F.shiftleft(_c(my).cast("long"), 8)).bitwiseOR(F.shiftleft(_c(mz).cast("long"), 16))


def unpack_focus(packed) -> Column:
    p = _c(packed)
    return F.struct(p.bitwiseAND(F.lit(255)).cast("int").alias("mx"), F.shiftright(p, 8).bitwiseAND(F.lit(255)).cast("int").alias("my"), F.shiftright(p, 16).bitwiseAND(F.lit(0xFFFFFFFF)).alias("mz"))


def focus_mask(mx, my, mz) -> Column:
    """2048 elements: 255 inside the region, 0 outside. Byte index = x * 256 + y * 32 + z."""

    def inside(i):
        has = lambda m, n: _c(m).cast("long").bitwiseAND(bit(n)) != 0
        return F.when(has(mx, F.floor(i / 256)) & has(my, F.floor(i / 32) % 8) & has(mz, i % 32), 255).otherwise(0)

    return F.transform(F.sequence(F.lit(0), F.lit(2047)), inside)


def region_bytes(mx, my, mz) -> Column:
    return (F.bit_count(_c(mx).cast("long")) * F.bit_count(_c(my).cast("long")) * F.bit_count(_c(mz).cast("long"))).cast("long")


def focus_xor(a, mask, value) -> Column:
    return xor(a, masked(value, mask))


def focus_add(a, mask, value, sign: int = 1) -> Column:
    return F.transform(F.arrays_zip(_c(a).alias("a"), _c(mask).alias("m"), _c(value).alias("v")), lambda t: F.pmod(t["a"] + F.when(t["m"] != 0, sign * t["v"]).otherwise(0), F.lit(256)))


def compact_delta(delta) -> Column:
    """array<struct<pos, xor>> of the bytes that differ; its wire size is 8 + 3 bytes for each."""
    return F.filter(F.transform(_c(delta), lambda x, i: F.struct(i.alias("pos"), x.alias("xor"))), lambda s: s["xor"] != 0)
