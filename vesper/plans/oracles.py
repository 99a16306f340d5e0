"""DuckDB SQL of queries whose operators run array kernels: streams, carriers, wavelets, templates, recogniser.

Single precision is FLOAT where the kernels have it, and sums in an order are list
reductions, so that results agree to the last rounding.
"""

from __future__ import annotations

from ..functions import kernels as K
from ..operators import ghosts, recognise
from ..operators.recognise import NOVEL_RESIDUAL, NOVEL_SCORE, SHORTLIST

_M = "18446744073709551616::UHUGEINT"
TAU = "CAST(2 * pi() AS FLOAT)"


def stream(name: str, rows: str, seed: str, n: str) -> str:
    """CTEs that add z, the n-th value (from 1) of the SplitMix64 stream of a seed, to rows."""
    return f"""{name}_a AS (SELECT *, (CAST({seed} AS UHUGEINT) + 11400714819323198485::UHUGEINT * CAST({n} AS UHUGEINT)) % {_M} AS z FROM {rows}),
{name}_b AS (SELECT * REPLACE ((xor(z, z >> 30) * 13787848793156543929::UHUGEINT) % {_M} AS z) FROM {name}_a),
{name}_c AS (SELECT * REPLACE ((xor(z, z >> 27) * 10723151780598845931::UHUGEINT) % {_M} AS z) FROM {name}_b),
{name} AS (SELECT * REPLACE (xor(z, z >> 31) AS z) FROM {name}_c)"""


def fnv(text: str) -> str:
    return f"list_reduce(list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % {_M}, 14695981039346656037::UHUGEINT)"


def away(x: str) -> str:
    """Rounded, halves away from zero, in x's own precision."""
    return f"(CASE WHEN {x} < 0 THEN -floor(abs({x}) + 0.5::FLOAT) ELSE floor(abs({x}) + 0.5::FLOAT) END)"


def i8(x: str) -> str:
    return f"CAST(greatest(-128, least(127, {away(x)})) AS BIGINT)"


def single(x: str) -> str:
    return f"CAST({x} AS FLOAT)"


def digest(value: str, order: str) -> str:
    return f"md5(unhex(string_agg(printf('%02x', CAST(({value} + 256) % 256 AS INTEGER)), '' ORDER BY {order})))"


# ---- hyperplanes and the recogniser

PLANES = 512


def planes(d: int, number: int = PLANES, seed: int = 42 ^ 0xCAFE) -> str:
    """hp(plane, pos, g): hyperplanes of unit length."""
    return (
        stream("hz", f"(SELECT unnest(range(0, {2 * d * number})) AS ix)", str(seed), "ix + 1")
        + f""",
hu AS (SELECT ix // 2 AS i, max(CAST(z >> 11 AS DOUBLE) / 9007199254740992.0) FILTER (ix % 2 = 0) AS u, max(CAST(z >> 11 AS DOUBLE) / 9007199254740992.0) FILTER (ix % 2 = 1) AS v FROM hz GROUP BY 1),
hg AS (SELECT i // {d} AS plane, i % {d} AS pos, CAST({single("sqrt(-2 * ln(1 - u)) * cos(2 * pi() * v)")} AS DOUBLE) AS g FROM hu),
hp AS (SELECT plane, pos, CAST({single("g / greatest(sqrt(sum(g * g) OVER (PARTITION BY plane)), 1e-10)")} AS DOUBLE) AS g FROM hg)"""
    )


def lsh() -> str:
    return f"""WITH {planes(64)}, x AS (SELECT vec_id, unnest(range(0, 64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
b AS (SELECT vec_id, plane, CASE WHEN sum(x * g) >= 0 THEN 1 ELSE 0 END AS bit FROM x JOIN hp USING (pos) GROUP BY 1, 2),
y AS (SELECT vec_id, plane // 8 AS k, CAST(sum(bit << CAST(7 - plane % 8 AS INTEGER)) AS INTEGER) AS byte FROM b GROUP BY 1, 2)
SELECT vec_id, string_agg(printf('%02X', byte), '' ORDER BY k) AS fp FROM y GROUP BY vec_id"""


def classes(vectors: str) -> str:
    """k(label, i, t): class templates; i from 1."""
    return f"{vectors}, k AS (SELECT label, i, CAST(sum(x - 64) // count(*) AS BIGINT) - 64 AS t FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(ph) AS x FROM v) GROUP BY label, i)"


def learnt(vectors: str) -> str:
    mean = "(any_value(k.t) + sum(x.x)) / (1 + count(*))"
    return f"""WITH {classes(vectors)}, x AS (SELECT label, unnest(range(1, 65)) AS i, unnest(list_transform(ph, lambda x: x - 128)) AS x FROM v),
w AS (SELECT x.label, x.i, CAST(greatest(-128, least(127, round({mean}))) AS BIGINT) AS t FROM x JOIN k ON k.label = x.label AND k.i = x.i GROUP BY x.label, x.i)
SELECT label AS class_idx, CAST(label + 100 AS BIGINT) AS class_id, string_agg(CAST(t AS VARCHAR), ',' ORDER BY i) AS template FROM w GROUP BY label"""


def recogniser(vectors: str, method: str) -> str:
    """Scores of each class taken in turn from what earlier ones left, in the method's order of classes."""
    by_print = "dense_rank() OVER (ORDER BY label)" if method != "two_stage" else "row_number() OVER (PARTITION BY q ORDER BY near DESC, label)"
    last = f"least((SELECT count(*) FROM kt), {SHORTLIST})" if method == "two_stage" else "(SELECT count(*) FROM kt)"
    picked = "arg_max(s.label, (s.score, -s.label))" if method == "hamming" else "arg_max(s.label, (abs(s.score), -s.step))"
    score = "max(s.score)" if method == "hamming" else "arg_max(s.score, (abs(s.score), -s.step))"
    name = {"hamming": "'HammingBrute'", "projection": "'ProjectionReadout'", "two_stage": f"CASE WHEN (SELECT count(*) FROM kt) > {SHORTLIST} THEN 'TwoStage' ELSE 'ProjectionReadout' END"}[method]
    value = "CAST(near - 0.5::FLOAT AS FLOAT) * 2::FLOAT" if method == "hamming" else "score"
    return f"""WITH RECURSIVE {classes(vectors)}, {planes(64)},
kt AS (SELECT label, list(CAST(t AS DOUBLE) ORDER BY i) AS t FROM k GROUP BY label),
qx AS (SELECT vec_id AS q, list_transform(ph, lambda x: {single("x - 128")}) AS x FROM v),
every AS (SELECT q AS id, true AS asked, x FROM qx UNION ALL SELECT label, false, list_transform(t, lambda y: {single("y")}) FROM kt),
bits AS (SELECT id, asked, plane, sum(CAST(x AS DOUBLE) * g) >= 0 AS bit FROM (SELECT id, asked, unnest(range(0, 64)) AS pos, unnest(x) AS x FROM every) JOIN hp USING (pos) GROUP BY 1, 2, 3),
likeness AS (SELECT a.id AS q, b.id AS label, {single(f"1 - count(*) FILTER (a.bit <> b.bit) / {single(str(PLANES))}")} AS near FROM bits a JOIN bits b ON a.asked AND NOT b.asked AND a.plane = b.plane GROUP BY 1, 2),
turns AS (SELECT q, label, near, {by_print} AS step FROM likeness),
walk AS (
  SELECT q, CAST(0 AS BIGINT) AS step, -1 AS label, 0::FLOAT AS near, 0::FLOAT AS score, x AS rest FROM qx
  UNION ALL
  SELECT w.q, w.step + 1, c.label, c.near, c.score, list_transform(range(1, 65), lambda i: w.rest[i] - c.score * {single("c.t[i]")}) FROM walk w
  JOIN (SELECT t.q, t.step, t.label, t.near, kt.t, 0 AS one FROM turns t JOIN kt USING (label)) n ON n.q = w.q AND n.step = w.step + 1,
  LATERAL (SELECT n.label, n.near, n.t, {single("CASE WHEN list_dot_product(n.t, n.t) >= 1e-10 THEN list_dot_product(CAST(w.rest AS DOUBLE[]), n.t) / list_dot_product(n.t, n.t) ELSE 0 END")} AS score) c
  WHERE w.step < {last}
),
ended AS (SELECT q, list_dot_product(CAST(rest AS DOUBLE[]), CAST(rest AS DOUBLE[])) AS left_over FROM walk WHERE step = {last}),
s AS (SELECT q, label, step, {value} AS score FROM walk WHERE step > 0),
best AS (SELECT s.q, CAST({picked} AS INTEGER) AS label, CAST({score} AS DOUBLE) AS score FROM s GROUP BY s.q)
SELECT q AS query_id, label AS best_class, CAST(label + 100 AS BIGINT) AS best_class_id, round(score, 4) AS best_score, {"score" if method == "hamming" else "abs(score)"} < {NOVEL_SCORE} OR left_over / list_dot_product(CAST(x AS DOUBLE[]), CAST(x AS DOUBLE[])) > {NOVEL_RESIDUAL} AS is_novel,
  round(left_over / list_dot_product(CAST(x AS DOUBLE[]), CAST(x AS DOUBLE[])), 4) AS residual_energy, {name} AS method FROM best JOIN ended USING (q) JOIN qx USING (q)"""


# ---- carriers

_WAVE = "CAST(greatest(-128, least(127, round(7 * {f}(2 * pi() * freq * j / 2048)))) AS BIGINT)"
CARRIERS = f"""fr AS (SELECT * FROM (VALUES {", ".join(f"({i}, {f})" for i, f in enumerate(K.FREQUENCIES))}) t(f, freq)),
cb AS (SELECT f, j, {_WAVE.format(f="cos")} AS c, {_WAVE.format(f="sin")} AS s FROM fr, (SELECT unnest(range(0, 2048)) AS j))"""


def sample(phase: str, amplitude: str) -> str:
    """Samples of a carrier (c, s) at a phase and amplitude, rounded."""
    cos, sin = single(f"cos(CAST({phase} AS DOUBLE))"), single(f"sin(CAST({phase} AS DOUBLE))")
    return i8(f"(({cos} * {single('c')} - {sin} * {single('s')}) * ({single(amplitude)} / 7::FLOAT))")


def turned(c: str, s: str) -> str:
    angle = single(f"atan2(-({s}), {c})")
    return f"CASE WHEN {angle} < 0 THEN {single(f'{angle} + {TAU}')} ELSE {angle} END"


CONTAINERS = f"""{CARRIERS}, ep AS (SELECT vec_id, unnest(range(0, 16)) AS f, unnest(list_transform(embedding[1:16], lambda x: {single("CAST(x AS DOUBLE) * 3.0")})) AS p FROM embeddings),
cc AS (SELECT vec_id, j, CAST(sum({sample("p", "3.0")}) AS BIGINT) AS x FROM ep JOIN cb USING (f) GROUP BY vec_id, j)"""

CARRIER_SPECTRUM = f"""WITH {CONTAINERS}, m AS (SELECT vec_id, f, sum(x * c) / 2048.0 AS c, sum(x * s) / 2048.0 AS s FROM cc JOIN cb USING (j) GROUP BY vec_id, f)
SELECT vec_id AS container_id, CAST(f AS INTEGER) AS f, round(CAST({single("sqrt(c * c + s * s)")} AS DOUBLE), 3) AS amplitude FROM m"""

CARRIER_ROUNDTRIP = f"""WITH {CARRIERS}, x AS (SELECT f, j, {sample("1.5::FLOAT", "7.0")} AS x, c, s FROM cb), m AS (SELECT f, sum(x * c) / 2048.0 AS c, sum(x * s) / 2048.0 AS s FROM x GROUP BY f)
SELECT vec_id AS container_id, round(CAST({turned("c", "s")} AS DOUBLE), 3) AS phase, round(CAST({single("sqrt(c * c + s * s)")} AS DOUBLE), 3) AS amplitude FROM embeddings JOIN m ON f = vec_id % 16"""

CARRIER_BUNDLES = f"""WITH {CONTAINERS}, b AS (SELECT vec_id % 20 AS container_id, j, list_reduce(list(x ORDER BY vec_id), lambda a, x: greatest(-128, least(127, a + x))) AS x FROM cc GROUP BY 1, 2)
SELECT container_id, {digest("x", "j")} AS digest FROM b GROUP BY container_id"""

# ---- wavelets in the 8 x 8 x 32 volume


def env(sigma: float) -> str:
    """Envelope of a squared distance d, in 255ths."""
    spread = f"(2::FLOAT * {sigma}::FLOAT * {sigma}::FLOAT)"
    scaled = f"({single(f'exp(CAST(-{single("d")} / {spread} AS DOUBLE))')} * 255::FLOAT)"
    return f"least(255, floor({scaled} + 0.5::FLOAT))"


PLACES = "vx AS (SELECT j, j // 256 AS px, j // 32 % 8 AS py, j % 32 AS pz FROM (SELECT unnest(range(0, 2048)) AS j))"


def touched(name: str, rows: str, sigma: float, cut: bool = True) -> str:
    """rows (x, y, z) beside the places j that a wavelet there touches: e255, e (single precision) and along."""
    near = f"AND d <= {K.radius2(sigma)}" if cut else ""
    return f"""{name} AS (SELECT * FROM (SELECT *, {single("e255")} / 255::FLOAT AS e FROM (SELECT *, {env(sigma)} AS e255 FROM (SELECT r.*, j, (px - x) * (px - x) + (py - y) * (py - y) + (pz - z) * (pz - z) AS d, (px - x) + (py - y) + (pz - z) AS along FROM {rows} r, vx)))
WHERE e >= {K.LEAST_ENVELOPE}::FLOAT {near})"""


def cosine(freq: str, phase: str | None) -> str:
    """Cosine of the carrier phase, in single precision."""
    angle = f"({TAU} * ({single(freq)} * {single('along')} / 32::FLOAT) + {single(phase or '0')})"
    return single(f"cos(CAST({angle} AS DOUBLE))")


_FREQ = f"[{', '.join(map(str, K.FREQUENCIES[:7]))}]"
_AT = "CAST(floor((embedding[{k}] + 1::FLOAT) * 97::FLOAT) AS BIGINT) % {n}"
WRITES = f"{PLACES}, wr0 AS (SELECT vec_id % 25 AS container_id, vec_id AS seq, {_AT.format(k=1, n=8)} AS x, {_AT.format(k=2, n=8)} AS y, {_AT.format(k=3, n=32)} AS z, {_FREQ}[vec_id % 7 + 1] AS freq, embedding[4] AS phase FROM embeddings)"
WAVES = f"""{WRITES}, {touched("wt", "wr0", 1.5)}, ws AS (SELECT *, {i8(f"(20::FLOAT * e * {cosine('freq', 'phase')})")} AS sample FROM wt),
wc AS (SELECT container_id, j, list_reduce(list(sample ORDER BY seq), lambda a, x: greatest(-128, least(127, a + x))) AS x FROM ws GROUP BY 1, 2)"""

WAVELET_READBACK = f"""WITH {WAVES}, m AS (SELECT seq, sum(wc.x * (e255 / 255.0::DOUBLE) * cos(a)) AS c, sum(wc.x * (e255 / 255.0::DOUBLE) * sin(a)) AS s, sum((e255 / 255.0::DOUBLE) * (e255 / 255.0::DOUBLE)) AS total
FROM (SELECT *, CAST({TAU} * ({single("freq")} * {single("along")} / 32::FLOAT) AS DOUBLE) AS a FROM wt) t JOIN wc USING (container_id, j) GROUP BY seq)
SELECT seq, round(CAST({turned("c", "s")} AS DOUBLE), 2) AS phase, round(CAST({single("sqrt(c * c + s * s) * 2 / total")} AS DOUBLE), 2) AS amplitude FROM m"""

_MODS = sorted({f % 32 for f in K.FREQUENCIES})
WAVELET_PEAKS = f"""WITH {WAVES}, {CARRIERS}, centre AS (SELECT px AS x, py AS y, pz AS z, j AS place FROM vx), {touched("ct", "centre", 1.5)},
ph AS (SELECT j, m, 2 * pi() * m * (px + py + pz) / 32 AS angle FROM vx, (SELECT unnest({_MODS}) AS m)),
xw AS (SELECT container_id, j, m, x * cos(angle) AS xc, x * sin(angle) AS xs FROM wc JOIN ph USING (j) WHERE x <> 0),
pw AS (SELECT place, sum(CAST(e AS DOUBLE) * CAST(e AS DOUBLE)) AS total FROM ct GROUP BY place),
both_ AS (SELECT container_id, place, m, sum(CAST(e AS DOUBLE) * xc) AS c, sum(CAST(e AS DOUBLE) * xs) AS s FROM ct JOIN xw USING (j) GROUP BY 1, 2, 3),
am AS (SELECT container_id, px AS x, py AS y, pz AS z, both_.m AS m, {single("sqrt((c * cos(angle) + s * sin(angle)) ^ 2 + (s * cos(angle) - c * sin(angle)) ^ 2) * 2 / greatest(total, 1e-10)")} AS amp FROM both_ JOIN pw USING (place) JOIN ph ON ph.j = place AND ph.m = both_.m JOIN vx ON vx.j = place),
high AS (SELECT * FROM am WHERE amp >= 15),
top AS (SELECT h.* FROM high h WHERE NOT EXISTS (SELECT 1 FROM high o WHERE o.container_id = h.container_id AND o.m = h.m AND o.x BETWEEN h.x - 1 AND h.x + 1 AND o.y BETWEEN h.y - 1 AND h.y + 1 AND o.z BETWEEN h.z - 1 AND h.z + 1 AND o.amp > h.amp))
SELECT container_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, CAST(f AS INTEGER) AS f, round(CAST(amp AS DOUBLE), 2) AS amp FROM top JOIN fr ON fr.freq % 32 = top.m"""

HEBBIAN = f"""WITH {WAVES}, two AS (SELECT * FROM (VALUES (0, 4, 4, 16), (1, 5, 4, 15)) t(i, x, y, z)), {touched("tt", "two", 2.0, False)},
sg AS (SELECT i, j, e * {cosine("3", None)} AS w FROM tt), hb AS (SELECT j, {i8("(0.5::FLOAT * (a.w * b.w) * 127::FLOAT)")} AS add FROM sg a JOIN sg b USING (j) WHERE a.i = 0 AND b.i = 1),
ids AS (SELECT DISTINCT container_id FROM wr0), o AS (SELECT container_id, vx.j, greatest(-128, least(127, coalesce(wc.x, 0) + coalesce(hb.add, 0))) AS x FROM ids CROSS JOIN vx LEFT JOIN wc USING (container_id, j) LEFT JOIN hb USING (j))
SELECT container_id, {digest("x", "j")} AS digest FROM o GROUP BY container_id"""

BATCH = f"""WITH {WRITES}, {touched("wt", "wr0", 1.5, False)}, t AS (SELECT container_id, j, list_reduce(list(20::FLOAT * (e * {cosine("freq", "phase")}) ORDER BY seq), lambda a, x: a + x, 0::FLOAT) AS total FROM wt GROUP BY 1, 2),
ids AS (SELECT DISTINCT container_id FROM wr0), o AS (SELECT container_id, vx.j, CASE WHEN total IS NULL THEN 0 ELSE {i8("total")} END AS x FROM ids CROSS JOIN vx LEFT JOIN t USING (container_id, j))
SELECT container_id, {digest("x", "j")} AS digest FROM o GROUP BY container_id"""

# ---- points and focus addresses

_TERMS = " + ".join(f"CAST(embedding[{d + 1}] AS DOUBLE) * b[{d + 1}]" for d in range(5))
POINTS = f"""WITH {stream("bz", "(SELECT unnest(range(0, 1280)) AS ix)", "42", "ix + 1")},
bb AS (SELECT (ix * 8 + k) // 2048 AS d, (ix * 8 + k) % 2048 AS j, CAST((z >> CAST(8 * k AS UHUGEINT)) % 256 AS BIGINT) AS b FROM bz, (SELECT unnest(range(0, 8)) AS k)),
bl AS (SELECT j, list(b ORDER BY d) AS b FROM bb GROUP BY j),
t AS (SELECT vec_id, j, b, {_TERMS} AS total FROM embeddings, bl),
r AS (SELECT vec_id, j, b, CAST(least(255, floor((total - 256 * floor(total / 256)) + 0.5)) AS BIGINT) AS x FROM t),
g AS (SELECT vec_id, {", ".join(f"sum(cos(((x - b[{d + 1}] + 256) % 256) * (2 * pi() / 256))) AS c{d}, sum(sin(((x - b[{d + 1}] + 256) % 256) * (2 * pi() / 256))) AS s{d}" for d in range(5))}, {digest("x", "j")} AS digest FROM r GROUP BY vec_id)
SELECT vec_id, digest, {", ".join(f"round(((atan2(s{d}, c{d}) + 2 * pi()) - 2 * pi() * floor((atan2(s{d}, c{d}) + 2 * pi()) / (2 * pi()))) / (2 * pi()), 4) AS p{d}" for d in range(5))} FROM g"""


def focus_addresses() -> str:
    """A drawn bit is swapped to the front, mask after mask of one stream."""
    masks = []
    for name, (x, y, z) in K.DENSITIES.items():
        before = 0
        for mask, total, count in (("mx", 8, x), ("my", 8, y), ("mz", 32, z)):
            masks.append(f"('{name}_{mask}', {total}, {count}, {before})")
            before += count
    return f"""WITH RECURSIVE masks AS (SELECT * FROM (VALUES {", ".join(masks)}) t(mask, total, n, before)),
{stream("fz", "(SELECT s_suppkey AS id, mask, total, n, i FROM supplier, masks, LATERAL (SELECT unnest(range(0, n)) AS i)) JOIN masks USING (mask, total, n)", "id", "before + i + 1")},
dr AS (SELECT id, mask, total, n, i, i + CAST(z % CAST(total - i AS UHUGEINT) AS BIGINT) AS j FROM fz),
sw AS (
  SELECT DISTINCT id, mask, CAST(0 AS BIGINT) AS i, range(0, total) AS held FROM dr
  UNION ALL
  SELECT sw.id, sw.mask, sw.i + 1, list_transform(range(0, total), lambda k: CASE WHEN k = dr.i THEN held[dr.j + 1] WHEN k = dr.j THEN held[dr.i + 1] ELSE held[k + 1] END) FROM sw JOIN dr ON dr.id = sw.id AND dr.mask = sw.mask AND dr.i = sw.i
),
done AS (SELECT id, sw.mask, CAST(list_sum(list_transform(held[1:n], lambda b: 1::BIGINT << b)) AS BIGINT) AS bits FROM sw JOIN masks ON masks.mask = sw.mask AND masks.n = sw.i)
SELECT id AS concept_id, {", ".join(f"CAST(max(bits) FILTER (mask = '{d}_{m}') AS {'BIGINT' if m == 'mz' else 'INTEGER'}) AS {d}_{m}" for d in K.DENSITIES for m in ("mx", "my", "mz"))} FROM done GROUP BY id"""


# ---- ontology


def _text(value: object) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def concepts(d: int) -> str:
    """ct(index, pos, t): templates of all concepts."""
    rows = ", ".join(f"({i}, {_text(name)}, {tau}, {_text(label)}, {_text(domain)})" for i, (name, tau, label, domain) in enumerate(ghosts.CONCEPTS))
    domain, tau = ghosts.DOMAIN_WEIGHT, ghosts.TAU_WEIGHT
    wide = 256 / ghosts.TAU_BINS
    drawn = "CAST(z % 7::UHUGEINT AS BIGINT) - 3"
    return f"""co AS (SELECT * FROM (VALUES {rows}) t(index, id, tau, name, domain)),
names AS (SELECT id AS key, {fnv("id")} AS seed FROM co UNION SELECT domain, {fnv("domain")} FROM co UNION SELECT 'bin ' || b, CAST({ghosts.TAU_SEED}::HUGEINT * (b + 1) AS UHUGEINT) FROM (SELECT unnest(range(0, {ghosts.TAU_BINS})) AS b)),
{stream("nz", f"(SELECT key, seed, pos FROM names, (SELECT unnest(range(0, {d})) AS pos))", "seed", "pos + 1")},
dn AS (SELECT key, pos, {drawn} AS x FROM nz),
tb AS (SELECT index, a.pos, {single(f"greatest(-3, least(3, round(a.x * (1 - part) + b.x * part)))")} AS x FROM (SELECT index, CAST(floor(tau / {wide}) AS BIGINT) AS lo, (tau - floor(tau / {wide}) * {wide}) / {wide} AS part FROM co) c
  JOIN dn a ON a.key = 'bin ' || c.lo % {ghosts.TAU_BINS} JOIN dn b ON b.key = 'bin ' || (c.lo + 1) % {ghosts.TAU_BINS} AND b.pos = a.pos),
mixed AS (SELECT co.index, tb.pos, {domain}::FLOAT * {single("d.x")} + {tau}::FLOAT * tb.x + {single(str(1 - domain - tau))} * {single("o.x")} AS y FROM co JOIN tb ON tb.index = co.index JOIN dn d ON d.key = co.domain AND d.pos = tb.pos JOIN dn o ON o.key = co.id AND o.pos = tb.pos),
ct AS (SELECT index, pos, CAST(greatest(-3, least(3, {away("y")})) AS BIGINT) AS t FROM mixed)"""


def read_back(scenarios: dict, dims: tuple[int, ...]) -> str:
    """rb(scenario, d, index, amplitude, readback): each scenario's concepts written in order, and all read."""
    rows = ", ".join(f"({_text(name)}, {k}, {i}, {a})" for name, (indices, amplitudes) in scenarios.items() for k, (i, a) in enumerate(zip(indices, amplitudes, strict=True)))
    step = f"greatest(-3::FLOAT, least(3::FLOAT, {away('(a + x)')}))"
    return f"""sc AS (SELECT * FROM (VALUES {rows}) t(scenario, step, index, amplitude)),
st AS (SELECT scenario, pos, list_reduce(list({single("amplitude")} * {single("t")} ORDER BY step), lambda a, x: {step}, 0::FLOAT) AS x FROM sc JOIN ct USING (index) GROUP BY 1, 2),
sums AS (SELECT scenario, d, index, sum(t * CAST(x AS DOUBLE)) AS dot, sum(t * t) AS size FROM st JOIN ct USING (pos) JOIN (SELECT unnest([{", ".join(map(str, dims))}]) AS d) ON pos < d GROUP BY 1, 2, 3),
rb AS (SELECT s.scenario, CAST(s.d AS INTEGER) AS d, CAST(s.index AS INTEGER) AS index, sc.amplitude, CASE WHEN size > 1e-10 THEN dot / size ELSE 0 END AS readback FROM sums s LEFT JOIN sc ON sc.scenario = s.scenario AND sc.index = s.index)"""


CONCEPT_READBACK = f"""WITH {concepts(4096)}, {read_back(ghosts.SCENARIOS, (4096,))}, r AS (SELECT *, amplitude IS NOT NULL AS was_stored, coalesce(CAST(amplitude AS DOUBLE), 0.0) AS original_amplitude, amplitude IS NULL AND abs(readback) > 0.02 AS is_ghost FROM rb)
SELECT scenario, r.index, id, domain, CAST(tau AS INTEGER) AS tau, was_stored, original_amplitude, round(readback, 6) AS readback, is_ghost, CASE WHEN is_ghost AND readback > 0 THEN 'GHOST+' WHEN is_ghost THEN 'GHOST-' WHEN NOT was_stored THEN '' WHEN readback / original_amplitude > 1.1 THEN 'ampl' WHEN readback / original_amplitude < 0.5 THEN 'supp' ELSE 'recov' END AS verdict FROM r JOIN co USING (index)"""

GHOST_MATRIX = f"""WITH {concepts(4096)}, {read_back({d: (own, (1.0,) * len(own)) for d, own in ghosts.DOMAINS.items()}, (4096,))}
SELECT scenario AS stored, {", ".join(f"round(avg(CASE WHEN scenario = domain THEN 0.0 ELSE readback END) FILTER (domain = {_text(d)}), 6) AS {d}" for d in ghosts.DOMAINS)} FROM rb JOIN co USING (index) GROUP BY scenario"""

_DIMS = (256, 512, 1024, 2048, 4096, 8192, 16384)
GHOST_DIMENSIONALITY = f"""WITH {concepts(max(_DIMS))}, {read_back(ghosts.SCENARIOS, _DIMS)}
SELECT d, scenario, count(*) FILTER (amplitude IS NULL AND abs(readback) > 0.02) AS ghosts, round(coalesce(max(abs(readback)) FILTER (amplitude IS NULL), 0.0), 6) AS max_ghost FROM rb GROUP BY d, scenario"""

TAU_TOPOLOGY = f"""WITH {concepts(4096)}, c AS (SELECT a.index AS i, b.index AS j, corr(a.t, b.t) AS r FROM ct a JOIN ct b ON a.pos = b.pos AND a.index < b.index GROUP BY 1, 2),
b AS (SELECT least(abs(x.tau - y.tau) // {ghosts.TAU_BINS}, 15) AS bucket, r FROM c JOIN co x ON x.index = i JOIN co y ON y.index = j)
SELECT CAST(bucket AS INTEGER) AS bucket, round(avg(r), 6) AS avg_corr, round(max(r), 6) AS max_corr, count(*) AS n, CASE WHEN avg(r) > 0.3 THEN 'strong link' WHEN avg(r) > 0.1 THEN 'weak link' WHEN avg(r) > 0.02 THEN 'faint' ELSE 'orthogonal' END AS label FROM b GROUP BY bucket"""


def entity_templates(axes: str, d: int = 64, overlap: float = 0.05, most: float = 0.6) -> str:
    """By entity: its own values less the tokens' share, then each token's in order; a stream's values by the text's hash and 1."""
    drawn = "CAST(CAST(z % 7::UHUGEINT AS BIGINT) - 3 AS FLOAT)"
    return f"""WITH {axes}, own AS (SELECT index, len(t) AS n, least({single("len(t)")} * {overlap}::FLOAT, {most}::FLOAT) AS share FROM a),
keys AS (SELECT 'p' || index AS key FROM own UNION SELECT 'axis:' || rank FROM r), seeds AS (SELECT key, ({fnv("key")} + 1::UHUGEINT) % {_M} AS seed FROM keys),
{stream("ez", f"(SELECT key, seed, pos FROM seeds, (SELECT unnest(range(0, {d})) AS pos))", "seed", "pos + 1")},
dn AS (SELECT key, pos, {drawn} AS x FROM ez),
terms AS (SELECT x.index, dn.pos, list((share / {single("n")}) * dn.x ORDER BY x.pos) AS terms FROM x JOIN own ON own.index = x.index JOIN r ON r.token = x.token JOIN dn ON dn.key = 'axis:' || r.rank GROUP BY x.index, dn.pos),
y AS (SELECT own.index, dn.pos, list_reduce(terms, lambda a, x: a + x, (1::FLOAT - share) * dn.x) AS y FROM own JOIN dn ON dn.key = 'p' || own.index JOIN terms ON terms.index = own.index AND terms.pos = dn.pos)
SELECT index, string_agg(CAST(CAST(greatest(-3, least(3, {away("y")})) AS INTEGER) AS VARCHAR), ',' ORDER BY pos) AS vec FROM y GROUP BY index"""


# ---- axes and archetypes


def principal_axes(items: int, sigma: float = 2.0, rounds: int = 200) -> str:
    """Power iteration, one component taken away before the next; frequencies dealt in order of items."""
    size = f"sqrt(list_sum(list_transform(mv, lambda x: x * x)))"
    grid = ", ".join(f"CASE WHEN max(c{d}) OVER () - min(c{d}) OVER () < 1e-10 THEN {top} / 2 ELSE (c{d} - min(c{d}) OVER ()) / (max(c{d}) OVER () - min(c{d}) OVER ()) * {top} END AS c{d}" for d, top in enumerate((7.0, 7.0, 31.0)))
    return f"""WITH RECURSIVE o AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d %H') AS w, CAST(user_id % {items} AS INTEGER) AS item FROM events), t AS (SELECT item, CAST(count(*) AS DOUBLE) AS total FROM o GROUP BY item),
n AS (SELECT a.item AS i, b.item AS j, count(*) / sqrt(any_value(x.total) * any_value(y.total)) AS norm FROM o a JOIN o b USING (w) JOIN t x ON x.item = a.item JOIN t y ON y.item = b.item WHERE a.item <> b.item GROUP BY 1, 2),
g AS (SELECT i, list(coalesce(norm, 0.0::DOUBLE) ORDER BY j) AS line FROM (SELECT i, j FROM range({items}) a(i), range({items}) b(j)) LEFT JOIN n USING (i, j) GROUP BY i), m0 AS (SELECT list(line ORDER BY i) AS m FROM g),
walk AS (
  SELECT 0 AS axis, 0 AS step, list_transform(range({items}), lambda i: 1 / sqrt({float(items)}::DOUBLE)) AS v, m FROM m0
  UNION ALL
  SELECT CASE WHEN step = {rounds} THEN axis + 1 ELSE axis END, CASE WHEN step = {rounds} THEN 0 ELSE step + 1 END,
    CASE WHEN step = {rounds} THEN list_transform(range({items}), lambda i: 1 / sqrt({float(items)}::DOUBLE)) WHEN {size} < 1e-10 THEN v ELSE list_transform(mv, lambda x: x / {size}) END,
    CASE WHEN step = {rounds} THEN list_transform(range({items}), lambda i: list_transform(range({items}), lambda j: m[i + 1][j + 1] - list_dot_product(v, mv) * v[i + 1] * v[j + 1])) ELSE m END
  FROM (SELECT *, list_transform(m, lambda line: list_dot_product(line, v)) AS mv FROM walk) WHERE axis < 2 OR step < {rounds}
),
ax AS (SELECT axis, v FROM walk WHERE step = {rounds}),
co AS (SELECT i, max(list_dot_product(line, v)) FILTER (axis = 0) AS c0, max(list_dot_product(line, v)) FILTER (axis = 1) AS c1, max(list_dot_product(line, v)) FILTER (axis = 2) AS c2 FROM g, ax GROUP BY i),
gr AS (SELECT i, {single("c0")} AS c0, {single("c1")} AS c1, {single("c2")} AS c2 FROM (SELECT i, {grid} FROM co)),
near AS (SELECT a.i, list(b.i ORDER BY b.i) AS others FROM gr a JOIN gr b ON b.i < a.i AND (a.c0 - b.c0) ^ 2 + (a.c1 - b.c1) ^ 2 + (a.c2 - b.c2) ^ 2 < {(2 * sigma) ** 2} GROUP BY a.i),
dealt AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS f
  UNION ALL
  SELECT n + 1, list_append(f, coalesce(list_min(list_filter(range(16), lambda k: NOT list_contains(list_transform(coalesce(others, CAST([] AS BIGINT[])), lambda o: f[o + 1]), k))), 0)) FROM dealt LEFT JOIN near ON near.i = n WHERE n < {items}
)
SELECT CAST(i AS INTEGER) AS item, round(CAST(c0 AS DOUBLE), 3) AS x, round(CAST(c1 AS DOUBLE), 3) AS y, round(CAST(c2 AS DOUBLE), 3) AS z, CAST((SELECT f FROM dealt WHERE n = {items})[i + 1] AS INTEGER) AS freq FROM gr"""


def _writes(name: str, rows: str, sigma: float, sign: str) -> str:
    return f"""{touched(f"{name}_t", rows, sigma)}, {name} AS (SELECT container_id, j, turn, {i8(f"({single(f'{sign} amp')} * e * {cosine('freq', 'phase')})")} AS sample FROM {name}_t)"""


ARCHETYPES = f"""WITH {WAVES}, {CARRIERS}, plane AS (SELECT px AS x, py AS y, pz AS z, j AS place FROM vx WHERE pz = 16), {touched("pt", "plane", 1.5)},
ra AS (SELECT place, x, y, f, freq, j, e255 / 255.0::DOUBLE AS w, CAST({TAU} * ({single("freq")} * {single("along")} / 32::FLOAT) AS DOUBLE) AS a FROM pt, fr),
rw AS (SELECT place, f, sum(w * w) AS total FROM ra GROUP BY 1, 2), ids AS (SELECT DISTINCT container_id FROM wr0),
rs AS (SELECT container_id, place, any_value(r.x) AS x, any_value(y) AS y, f, any_value(freq) AS freq, sum(wc.x * w * cos(a)) AS c, sum(wc.x * w * sin(a)) AS s FROM ra r JOIN wc USING (j) GROUP BY container_id, place, f),
am AS (SELECT container_id, rs.x, rs.y, rs.f, freq, {turned("c", "s")} AS phase, {single("sqrt(c * c + s * s) * 2 / total")} AS amp FROM rs JOIN rw ON rw.place = rs.place AND rw.f = rs.f),
found AS (SELECT h.*, 16 AS z, row_number() OVER (PARTITION BY container_id ORDER BY x, y, f) AS turn FROM am h WHERE amp > 8 AND NOT EXISTS (SELECT 1 FROM am o WHERE o.container_id = h.container_id AND o.f = h.f AND o.x BETWEEN h.x - 1 AND h.x + 1 AND o.y BETWEEN h.y - 1 AND h.y + 1 AND o.amp > h.amp)),
{_writes("out_", "found", 2.0, "-1 *")}, {_writes("in_", "found", 1.0, "1 *")},
sm AS (SELECT container_id, j, list(sample ORDER BY side, turn) AS samples FROM (SELECT *, 0 AS side FROM out_ UNION ALL SELECT *, 1 FROM in_) GROUP BY 1, 2),
cr AS (SELECT container_id, vx.j, list_reduce(coalesce(samples, CAST([] AS BIGINT[])), lambda a, x: greatest(-128, least(127, a + x)), coalesce(wc.x, 0)) AS x FROM ids CROSS JOIN vx LEFT JOIN wc USING (container_id, j) LEFT JOIN sm USING (container_id, j))
SELECT container_id, CAST((SELECT count(*) FROM found WHERE found.container_id = cr.container_id) AS INTEGER) AS n, {digest("x", "j")} AS crystal FROM cr GROUP BY container_id"""


# ---- sums of templates


def surgical_cool(templates: str, coefficients: str) -> str:
    """The templates are independent, so that least squares gives back what was summed."""
    return f"WITH {templates}, {coefficients} SELECT entity_id, CAST(concept_id AS BIGINT) AS concept_id, round(coefficient, 4) AS coefficient FROM cf"


def warm_writes(templates: str, coefficients: str) -> str:
    return f"""WITH {templates}, {coefficients}, w AS (SELECT entity_id, i, CAST(list_reduce(list(coefficient * t ORDER BY concept_id), lambda a, x: greatest(-3.0::DOUBLE, least(3.0::DOUBLE, round(a + x))), 0.0::DOUBLE) AS BIGINT) AS x FROM cf JOIN tm USING (concept_id) GROUP BY entity_id, i)
SELECT entity_id, string_agg(CAST(x AS VARCHAR), ',' ORDER BY i) AS vec FROM w GROUP BY entity_id"""


def counters(index: str, ham, thresholds: tuple[int, int, int, int]) -> str:
    """By query: clusters, and rows that each channel fetches of those that the channels before left."""
    channels = ("meta", "cam", "btree", "embed")
    near = ", ".join(f"{c}_near AS (SELECT q.row_id AS query_id, k.cluster_id FROM r q, {c}_c k WHERE q.row_id % 50 = 0 AND greatest({ham('k.centre', f'q.{c}')} - k.radius, 0) <= {t})" for c, t in zip(channels, thresholds, strict=True))
    steps, alive = [], "(SELECT row_id AS query_id FROM r WHERE row_id % 50 = 0) q CROSS JOIN (SELECT row_id FROM r) x"
    for c, t in zip(channels, thresholds, strict=True):
        steps.append(f"{c}_got AS (SELECT a.query_id, a.row_id FROM (SELECT query_id, row_id FROM {alive}) a JOIN {c}_m m ON m.row_id = a.row_id JOIN {c}_near n ON n.query_id = a.query_id AND n.cluster_id = m.cluster_id)")
        steps.append(f"{c}_left AS (SELECT g.query_id, g.row_id FROM {c}_got g JOIN r x ON x.row_id = g.row_id JOIN r y ON y.row_id = g.query_id WHERE {ham(f'x.{c}', f'y.{c}')} <= {t})")
        alive = f"{c}_left"
    count = lambda c: f"(SELECT count(*) FROM {c}_got g WHERE g.query_id = q.row_id)"
    return f"""WITH {index}, {near}, {", ".join(steps)}
SELECT q.row_id AS query_id, (SELECT count(*) FROM meta_c) AS fragments_total, (SELECT count(*) FROM meta_c) - (SELECT count(*) FROM meta_near n WHERE n.query_id = q.row_id) AS fragments_pruned, {count("meta")} AS meta_scanned, {count("cam")} AS cam_fetched, {count("btree")} AS btree_fetched, {count("embed")} AS embed_fetched FROM r q WHERE q.row_id % 50 = 0"""


# ---- streams, noise, regions and spectra

STREAMS = f"""WITH h AS (SELECT s_suppkey AS id, {fnv("s_name")} AS seed FROM supplier), {stream("sz", "(SELECT id, seed, n FROM h, (SELECT unnest(range(1, 20)) AS n))", "seed", "n")}
SELECT id, CAST(any_value(seed) AS VARCHAR) AS hash, string_agg(CAST(z AS VARCHAR), ',' ORDER BY n) FILTER (n <= 3) AS stream, string_agg(CAST(CAST(z % 7::UHUGEINT AS BIGINT) - 3 AS VARCHAR), ',' ORDER BY n) FILTER (n > 3) AS drawn FROM sz GROUP BY id"""

GENERATED = f"""WITH k AS (SELECT c AS concept_id, a AS axis, {fnv("('42:' || c || ':' || a)")} AS seed FROM (SELECT unnest(range(0, 20)) AS c), (SELECT unnest(range(0, 2)) AS a)),
{stream("gz", "(SELECT concept_id, axis, seed, pos FROM k, (SELECT unnest(range(0, 48)) AS pos))", "seed", "pos + 1")}
SELECT concept_id, CAST(axis AS INTEGER) AS axis, string_agg(CAST(CAST(z % 7::UHUGEINT AS BIGINT) - 3 AS VARCHAR), ',' ORDER BY pos) AS vec FROM gz GROUP BY concept_id, axis"""


def perturbed(vectors: str) -> str:
    uniform = "max(CAST(z >> 11 AS DOUBLE) / 9007199254740992.0) FILTER (ix % 2 = {k})"
    return f"""WITH {vectors}, h AS (SELECT vec_id, ph, {fnv("('0:' || vec_id)")} AS seed FROM v), {stream("nz", "(SELECT vec_id, seed, ix FROM h, (SELECT unnest(range(0, 128)) AS ix))", "seed", "ix + 1")},
u AS (SELECT vec_id, ix // 2 AS pos, {uniform.format(k=0)} AS u1, {uniform.format(k=1)} AS u2 FROM nz GROUP BY 1, 2),
y AS (SELECT vec_id, pos, (ph[pos + 1] - 128) + 2.0 * (sqrt(-2 * ln(1 - u1)) * cos(2 * pi() * u2)) AS y FROM u JOIN v USING (vec_id))
SELECT vec_id, string_agg(CAST(CAST(greatest(-128, least(127, round(y))) AS BIGINT) AS VARCHAR), ',' ORDER BY pos) AS vec FROM y GROUP BY vec_id"""


def focus_carriers(regions: str) -> str:
    return f"""WITH {regions}, {CARRIERS}, x AS (SELECT r.id, r.j, CASE WHEN m THEN {sample("0.7::FLOAT", "5.0")} ELSE 0 END AS x FROM (SELECT id, j, m FROM f) r JOIN cb ON cb.j = r.j AND cb.f = r.id % 16)
SELECT id, {digest("x", "j")} AS digest FROM x GROUP BY id"""


SPECTRAL_DISTANCES = f"""WITH {CONTAINERS}, m AS (SELECT vec_id, f, sum(x * c) / 2048.0 AS c, sum(x * s) / 2048.0 AS s FROM cc JOIN cb USING (j) GROUP BY vec_id, f), a AS (SELECT vec_id, f, {single("sqrt(c * c + s * s)")} AS a FROM m)
SELECT x.vec_id AS container_id, round(sum(CAST(abs(x.a - y.a) AS DOUBLE)), 3) AS distance FROM a x JOIN a y ON y.vec_id = x.vec_id + 1 AND y.f = x.f GROUP BY x.vec_id"""


def hebbian_templates(templates: str, coefficients: str) -> str:
    return f"""WITH {templates}, {coefficients}, w AS (SELECT entity_id, i, greatest(-3, least(3, round(sum(coefficient * t)))) AS x FROM cf JOIN tm USING (concept_id) GROUP BY entity_id, i)
SELECT entity_id, w.i - 1 AS pos, CAST(greatest(-3, least(3, round(x + a.t * b.t * 0.375::DOUBLE))) AS BIGINT) AS value FROM w JOIN tm a ON a.i = w.i AND a.concept_id = 0 JOIN tm b ON b.i = w.i AND b.concept_id = 1"""
