import random

import xxhash

from vesper.llm import components, simhash

from .conftest import ODD, spaced


def brute(text):
    w = spaced(text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, limit=4):
    """Smallest id reachable, by id, of (id, fingerprint) pairs."""
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, f in prints:
        for j, g in prints:
            if (f ^ g).bit_count() <= limit:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in prints}


def test_against_brute_force(documents):
    got = {r.doc_id: r for r in simhash.near_duplicates(documents).collect()}
    prints = [(r.doc_id, brute(r.text)) for r in documents.collect()]
    assert {i: f"{f:016x}" for i, f in prints} == {i: r.fingerprint for i, r in got.items()}
    assert groups(prints) == {i: r.component_id for i, r in got.items()}


def test_links_lose_nothing_in_large_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(3)
    prints = []
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(6):
            prints.append(f)
            f ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 3, 4, 5])))
    prints += [rng.getrandbits(64) & 0xFF for _ in range(60)]  # many in one cell
    prints = sorted(set(prints))
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {r.node: r.component for r in components.components(simhash.links(frame, 4)).collect()}
    expected = groups(list(zip(prints, prints, strict=True)))
    ours = {}
    for f, s in zip(prints, signed, strict=True):
        ours.setdefault(found.get(s, s), set()).add(f)
    theirs = {}
    for f, c in expected.items():
        theirs.setdefault(c, set()).add(f)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "0" * 16
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1
    assert by[6].component_id == by[7].component_id == 6
    assert simhash.near_duplicates(none).collect() == []


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 3), (9, 3), (9, 10), (3, 2)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 10: 1, 4: 4, 5: 4, 7: 7}
    chain = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {r.component for r in components.components(chain).collect()} == {0}
