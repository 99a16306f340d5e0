import math

import numpy as np

from vesper.llm import embeddings


def brute(rows, least=0.95):
    ok = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            x /= np.abs(x).max()
            ok[k] = x / np.linalg.norm(x)
    links = {k: set() for k in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= least:
                links[a].add(b)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        least_id = min(rows[s][0] for s in seen)
        out.append((i, len(links[k]), least_id, i == least_id))
    return sorted(out)


def vectors(seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(30):
        x = rng.standard_normal(8)
        for _ in range(int(rng.integers(1, 8))):
            rows.append((x + rng.standard_normal(8) * 0.05).astype(np.float32).tolist())
        if c % 5 == 0:
            rows += [x.astype(np.float32).tolist()] * 4 + [(x * 7).astype(np.float32).tolist()]
    rows += [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [math.nan] * 8, [math.inf] + [0.0] * 7, [1.0, 2.0], [2.0, 4.0], [2.0, 1.0], [3.0], [4.0], [-4.0], [1e30] * 8, [1e-30] * 8, [-0.0] * 7 + [1.0], [0.0] * 7 + [1.0]]
    return [(int(i), v) for i, v in zip(rng.permutation(len(rows)) * 3, rows, strict=True)]


def test_against_brute_force(spark, monkeypatch):
    rows = vectors()
    for kind in ("float", "double"):
        frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 as node", "2 as v", "3 as kept")
        assert sorted(map(tuple, embeddings.near_duplicates(frame).collect())) == brute(rows)
    monkeypatch.setattr(embeddings, "BLOCK", 4)
    assert sorted(map(tuple, embeddings.near_duplicates(frame).collect())) == brute(rows)


def test_recall_on_many_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = frame.collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    expected = (x @ x.T >= 0.95).sum(1) - 1
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(frame).collect()}
    found = np.array([got[r.vec_id] for r in rows])
    assert (found <= expected).all() and found.sum() >= 0.97 * expected.sum()


def test_cells_come_in_the_order_of_the_sequence():
    rng = np.random.default_rng(3)
    x = embeddings.units(rng.standard_normal((500, 12)))
    index = embeddings.fit(x, 500 * 8, 0.9, 0.99)
    rows, cells, home = index.cells(x)
    a, b = index.costs(x)
    for r in range(0, 500, 7):
        total = (a[r][:, None] + b[r][None, :]).ravel()
        got = cells[rows == r]
        assert home[rows == r].tolist() == [True] + [False] * (len(got) - 1)
        assert (np.diff(total[got]) >= 0).all()
        assert set(got) == set(np.flatnonzero(total <= a[r].min() + b[r].min() + index.reach))


def test_every_length_has_an_index(spark):
    rng = np.random.default_rng(4)
    rows = []
    for size, n in ((6, 300), (8, 200), (5, 3)):
        x = rng.standard_normal((n // 2 + 1, size))
        rows += [v.tolist() for v in x] + [(v + rng.standard_normal(size) * 0.01).tolist() for v in x]
    rows = list(enumerate(rows))
    got = sorted(map(tuple, embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=0.9999).collect()))
    assert got == brute(rows)


def test_empty_tables_and_rows_without_ids(spark):
    frame = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embeddings.near_duplicates(frame).collect()), key=str) == [(4, 2, 4, True), (4, 2, 4, True), (None, 2, 4, False)]
    assert embeddings.near_duplicates(frame.where("false")).collect() == []
    nothing = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert list(map(tuple, embeddings.near_duplicates(nothing).collect())) == [(1, 0, 1, True)]
