from collections import defaultdict

import duckdb
import pytest

from vesper.llm import mixing

from .conftest import ODD, spaced


def level(sizes, weights, most):
    """Targets by sharing the excess again and again."""
    total, left = sum(sizes.values()), dict(sizes)
    out, room = {}, total
    while left:
        unit = room / sum(weights[s] for s in left)
        over = [s for s in left if weights[s] * unit > most * sizes[s]]
        if not over:
            return out | {s: weights[s] * unit for s in left}
        for s in over:
            out[s] = most * sizes[s]
            room -= out[s]
            del left[s]
    return out


def test_targets_copies_and_reruns(documents):
    rows = mixing.report(documents).collect()
    docs = {r.doc_id: r for r in documents.collect()}
    sizes = defaultdict(int)
    for r in rows:
        assert r.size == len(spaced(docs[r.doc_id].text))
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        sizes[docs[r.doc_id].source] += r.size
    names = sorted(sizes)
    expected = level(sizes, {s: i % 3 + 1 for i, s in enumerate(names)}, 3)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        s = docs[r.doc_id].source
        assert r.target == pytest.approx(expected[s]) and r.source_size == sizes[s]
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in names:
        assert abs(taken[s] - expected[s]) <= 2 * largest[s]
    assert sorted(mixing.report(documents.repartition(7)).collect()) == sorted(rows)
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert sorted(con.sql(mixing.ORACLE_SQL).fetchall()) == sorted(map(tuple, rows))


def test_excess_goes_on(spark):
    docs = [(i, "w " * n, s) for i, (n, s) in enumerate([(1, "a"), (10, "b"), (500, "c"), (300, None), (2, "d"), (0, "e")])]
    got = {r.doc_id: r.target for r in mixing.report(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    order = ["a", "b", "c", "d", "e", None]
    expected = level({"a": 1, "b": 10, "c": 500, "d": 2, "e": 0, None: 300}, {s: i % 3 + 1 for i, s in enumerate(order)}, 3)
    assert {s: got[i] for i, s in enumerate(["a", "b", "c", None, "d", "e"])} == pytest.approx(expected)


def test_ranges_of_equal_sizes(spark, monkeypatch):
    frame = spark.range(4000).selectExpr("id as doc_id", "'one two' as text", "if(id % 3 = 0, 'a', 'b') as source")
    whole = sorted(mixing.report(frame).collect())
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    assert sorted(mixing.report(frame).collect()) == whole


def taken_by_source(rows, source):
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r.size)
    return taken, target, largest


def test_wide_string_and_repeated_ids(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    wide = [(low, "a b c", "x"), (high, "a b", "x"), (0, "c", "y")] + [(high - 7 * i, "w " * (i % 9), "y") for i in range(300)]
    frame = spark.createDataFrame(wide, "doc_id long, text string, source string")
    rows = mixing.report(frame).collect()
    assert len(rows) == len(wide)
    # 500 repeated rows and ten others; each row has a draw of its own
    repeated = [(1, "one two three four five six seven eight nine ten", "a")] * 500 + [(i, "w " * i, "a") for i in range(2, 12)] + [(100 + i, "w " * 40, "b") for i in range(40)]
    source = {i: s for i, _, s in repeated}
    frame = spark.createDataFrame(repeated, "doc_id long, text string, source string")
    for docs in (frame, frame.withColumn("doc_id", frame.doc_id.cast("string"))):
        rows = mixing.report(docs).collect()
        taken, target, largest = taken_by_source(rows, {k if docs is frame else str(k): v for k, v in source.items()})
        assert len(rows) == len(repeated) and all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in target)
        words = defaultdict(int)
        for r in mixing.mix(docs).collect():
            words[source[int(r.doc_id)]] += len(spaced(r.text))
        assert words == taken


def test_rows_that_share_an_id_and_differ(spark):
    docs = [(1, t, "a", {"k": i}) for i, t in enumerate(["x y", "y x", "x y", "x y", None])]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, extra map<string,int>")
    mixed = mixing.mix(frame)
    assert mixed.columns == [*frame.columns, "copy"]
    assert sum(len(spaced(r.text)) for r in mixed.collect()) == sum(r.taken for r in mixing.report(frame).collect())


def test_odd_rows(odd, none):
    rows = mixing.report(odd).collect()
    assert len(rows) == len(ODD)
    mixed = mixing.mix(odd)
    assert set(mixed.columns) == set(odd.columns)
    taken = {}
    for r in rows:
        taken[r.doc_id] = r.taken if r.size else taken.get(r.doc_id)
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.doc_id] += len(spaced(r.text))
    assert all(words[i] == n * (2 if i == 6 else 1) for i, n in taken.items() if n)
    assert mixing.report(none).collect() == [] and mixing.mix(none).collect() == []
