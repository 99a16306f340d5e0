import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vesper.functions import columns as C
from vesper.functions import kernels as K
from vesper.functions import vectors as V
from vesper.operators import holograph

BYTES = st.lists(st.integers(0, 255), min_size=8, max_size=8)


def one(spark, schema, row, **columns):
    return spark.createDataFrame([row], schema).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_known_values(spark):
    r = one(spark, "a array<int>, b array<int>", ([0, 10, 20, 30], [5, 15, 25, 35]), w=V.l1("a", "b"))
    assert r.w == 20
    r = one(spark, "a array<int>, b array<int>", ([254, 0], [2, 128]), c=V.circular("a", "b"))
    assert r.c == 4 + 128
    r = one(spark, "a array<int>", ([200, 50, 100, 0, 255, 128],), s=V.sort_phase("a"))
    assert r.s.sorted == [0, 50, 100, 128, 200, 255] and r.s.perm == [3, 1, 2, 5, 0, 4]
    r = one(spark, "a array<int>", (list(range(256)) * 8,), h=V.histogram16("a"))
    assert r.h == [128] * 16
    r = one(spark, "a array<bigint>, b array<bigint>", ([-1] * 8, [0] * 8), h=V.hamming("a", "b"))
    assert r.h == 512
    assert one(spark, "a array<double>", ([1.0, 1.0, -1.0, -1.0, 2.0, 2.0, 0.0, 0.0],), d=V.downsample("a", 4, -3, 3)).d == [1, -1, 2, 0]
    r = one(spark, "a array<int>, b array<int>", ([1, 0, 1], [1, 1, 0]), x=V.bind("a", "b", ("binary", 2)))
    assert r.x == [0, 1, 1]
    r = one(spark, "a array<int>, b array<int>", ([2, -2, 1], [1, -2, 1]), x=V.bind("a", "b", ("signed", 5)), m=V.bundle_row(F.array("a", "b"), ("signed", 5)))
    assert r.x == [2, -2, 2] and r.m == [2, -2, 2]


def test_laws_over_random_rows(spark):
    rng = random.Random(4)
    rows = [[[rng.randrange(256) for _ in range(32)] for _ in range(3)] for _ in range(50)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a array<int>, b array<int>, c array<int>")
    s = V.sort_phase("a")
    got = frame.select("a", V.phase_unbind(V.phase_bind("a", "b"), "b").alias("back"), V.phase_bind("a", V.phase_inverse("a")).alias("zero"), V.unsort_phase(s["sorted"], s["perm"]).alias("unsorted"), V.xor(V.xor("a", "b"), "b").alias("x"), (V.circular("a", "c") <= V.circular("a", "b") + V.circular("b", "c")).alias("t"), V.pearson("a", "b").alias("p"), V.cosine("a", "b").alias("cos"), V.wrapping_sub_i8(F.transform("a", lambda x: x - 128), F.transform("b", lambda x: x - 128)).alias("sub")).collect()
    for r, (a, b, _) in zip(got, rows, strict=True):
        assert r.back == r.unsorted == r.x == a and set(r.zero) == {0} and r.t
        assert r.p == pytest.approx(np.corrcoef(a, b)[0, 1])
        assert r.cos == pytest.approx(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
        assert r.sub == [(x - y + 128) % 256 - 128 for x, y in zip(a, b, strict=True)]


def test_nulls(spark):
    r = one(spark, "a array<int>, b array<int>", (None, [1]), w=V.l1("a", "b"), p=V.phase_bind("a", "b"), s=V.unsort_phase("b", "a"), d=C.to_ints(F.lit(None).cast("binary")))
    assert r.w is None and r.p is None and r.s is None and r.d is None


@settings(max_examples=60, deadline=None)
@given(BYTES, BYTES)
def test_kernel_bind_matches_the_definition(a, b):
    x, y = np.array(a, np.int16) % 5 - 2, np.array(b, np.int16) % 5 - 2
    assert K.bind(x.astype(np.int8), y.astype(np.int8), ("signed", 5)).tolist() == np.clip(x + y, -2, 2).tolist()


def test_random_stream_by_counter():
    whole = K.SplitMix(42).take(10)
    parts = K.SplitMix(42)
    assert np.concatenate([parts.take(3), parts.take(7)]).tolist() == whole.tolist()
    # published first outputs of the generator from seed 0
    assert [hex(v) for v in K.SplitMix(0).take(2).tolist()] == ["0xe220a8397b1dcdaf", "0x6e789e6aa1b965f4"]
    g = K.SplitMix(1).gaussian(20_000)
    assert abs(g.mean()) < 0.03 and abs(g.var() - 1) < 0.05
    v = K.SplitMix(2).integers(-3, 3, 5000)
    assert set(v.tolist()) == set(range(-3, 4))


def test_focus_masks(spark):
    r = one(spark, "mx int, my int, mz bigint", (0x0F, 0xF0, 0x0000FFFF), m=V.focus_mask("mx", "my", "mz"), n=V.region_bytes("mx", "my", "mz"), p=V.unpack_focus(V.pack_focus("mx", "my", "mz")))
    assert [x == 255 for x in r.m] == K.focus_mask(0x0F, 0xF0, 0xFFFF).tolist() and r.n == 4 * 4 * 16
    assert (r.p.mx, r.p.my, r.p.mz) == (0x0F, 0xF0, 0xFFFF)
    assert np.flatnonzero(K.focus_mask(0x80, 0x80, 0x80000000)).tolist() == [2047]
    r = one(spark, "x int", (1,), p=V.unpack_focus(V.pack_focus(F.lit(0xA5), F.lit(0x3C), F.lit(0xDEADBEEF))))
    assert (r.p.mx, r.p.my, r.p.mz) == (0xA5, 0x3C, 0xDEADBEEF)
    for density, bits in K.DENSITIES.items():
        assert tuple(m.bit_count() for m in K.concept_focus(7, density)) == bits


def test_carriers():
    empty = np.zeros(K.SIZE, np.int8)
    for f in range(15):
        phase, amplitude = K.carrier_decode(K.carrier_encode(empty, f, 1.3, 7.0)[None, :])
        assert abs(float(phase[0, f]) - 1.3) < 0.15 and 20 < amplitude[0, f] < 28
    container = empty
    wanted = [0.39 * i + 0.1 for i in range(15)]
    for f, p in enumerate(wanted):
        container = K.carrier_encode(container, f, p, 7.0)
    phase, _ = K.carrier_decode(container[None, :])
    for f, p in enumerate(wanted):
        d = abs(float(phase[0, f]) - p) % (2 * np.pi)
        assert min(d, 2 * np.pi - d) < 0.5
    mask = K.focus_mask(1, 1, 1)
    assert (K.carrier_encode(empty, 3, 0.0, 7.0, mask)[~mask] == 0).all()
    assert K.add_i8(np.array([120], np.int8), np.array([20], np.int8))[0] == 127
    assert K.bundle_i8(np.array([[100], [100], [-100]], np.int8))[0] == 27  # in order, saturating


def test_wavelets():
    empty = np.zeros(K.SIZE, np.int8)
    for p in (0.0, 0.5, 1.0, 2.0, np.pi, 4.0, 5.5, 6.0):
        phase, amplitude = K.gabor_read_one(K.gabor_write(empty, 2.0, 4, 4, 16, 3.0, p, 40.0), 2.0, 4, 4, 16, 3.0)
        d = abs(phase - p) % (2 * np.pi)
        assert min(d, 2 * np.pi - d) < 0.15 and amplitude > 20
    assert K.gabor_read_one(empty, 2.0, 1, 1, 1, 3.0) == (0.0, 0.0)
    c = K.gabor_write(empty, 1.5, 3, 4, 10, 5, 0.7, 60.0)
    phase, amplitude = K.spectrum(c, 1.5)
    for f, freq in enumerate(K.FREQUENCIES):
        for x, y, z in ((3, 4, 10), (0, 0, 0), (7, 7, 31), (3, 5, 11)):
            p, a = K.gabor_read_one(c, 1.5, x, y, z, freq)
            assert amplitude[x * 256 + y * 32 + z, f] == pytest.approx(a, rel=1e-3, abs=1e-3)
    found = K.peaks(phase, amplitude, 30.0)
    assert any(p[:3] == (3, 4, 10) and K.FREQUENCIES[p[3]] == 5 for p in found)
    assert K.residual_energy(c, [(3, 4, 10, 5.0)], 1.5) < 0.2 * float((c.astype(float) ** 2).sum())
    assert 0.5 <= K.adapt_sigma(c, 1.5, 3, 4, 10, 5.0, 1.5, 0.1, 2.0) <= 4.0
    one = K.batch_flush(empty, [(1.5, 3, 4, 10, 5.0, 60.0, 0.7)])
    assert np.abs(one.astype(int) - c).max() <= 3  # a batch has no radius
    assert len(K.wavelet_template(1.0, 4, 4, 16)) > 20


def test_permutations():
    x, y, d = holograph.rotation("x", 3), holograph.rotation("y", 2), holograph.diagonal()
    identity = list(range(holograph.SIZE))
    assert sorted(d) == identity and holograph.compose(d, holograph.inverse(d)) == identity
    assert holograph.compose(x, y) == holograph.compose(y, x)
    assert holograph.compose(holograph.rotation("z", 20), holograph.rotation("z", 12)) == identity


def test_linear_algebra():
    assert K.cholesky_solve(np.array([[4.0, 2], [2, 3]]), np.array([8.0, 8])).tolist() == pytest.approx([1, 2])
    assert K.condition_number(np.eye(3)) == pytest.approx(1.0)
    rng = np.random.default_rng(0)
    t = rng.integers(-3, 4, (5, 256)).astype(np.int8)
    c = np.clip(2 * t[0] - t[3], -128, 127).astype(np.int8)
    assert np.abs(K.orthogonal_project(c, t).astype(int) - c).max() <= 2
    scores, left = K.gram_schmidt(t[2].astype(np.float32), t[2:3])
    assert scores[0] == pytest.approx(1.0) and left == pytest.approx(0.0, abs=1e-6)


def test_points_in_five_dimensions():
    points = np.array([[0.1, 0.2, 0.3, 0.4, 0.5], [1.0, 0, 0, 0, 0]])
    records = K.project_5d(points, 42)
    assert records.shape == (2, 2048) and (records[1] == K.basis_5d(42)[0]).all()
    assert K.recover_5d(records, 42)[1, 0] == pytest.approx(0.0, abs=1e-6)
