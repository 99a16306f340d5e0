import hashlib
import re

from vesper.llm import decontaminate as D

from .conftest import ODD, lower


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute(docs, items, window=13):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(str(x) for x in found if x is not None)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_short_items_overlaps_and_odd_texts(spark, odd, none, monkeypatch):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    items = [(1, base), (2, base.upper()), (11, "alpha beta"), (12, "beta"), (3, None), (4, ""), (5, "!!"), (6, "beta gamma alpha beta"), (7, "one two " * 9), (None, "alpha"), (8, base.replace("fifteen", "sixteen") + " seventeen"), (1, base)]
    docs = [(1, "x " + base + " y"), (2, "alpha BETA gamma alpha beta beta"), (3, "one two " * 20), (4, base[:-8]), (5, None), (6, ""), (7, "filler " * 400 + base), (8, "filler " * 200 + base.replace(" ", "\n-- ")), (9, "alphabeta"), (10, "éa alpha beta"), (2, "beta")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items)
    assert max(r[3] for r in expected) == 4  # of which one is all items without an id
    assert sorted(map(tuple, D.report(frame, bench).collect()), key=str) == expected
    monkeypatch.setattr(D, "AUTOMATON_WORDS", 10)
    assert sorted(map(tuple, D.report(frame, bench).collect()), key=str) == expected
    monkeypatch.setattr(D, "PASS_WORDS", 15)
    assert sorted(map(tuple, D.report(frame, bench).collect()), key=str) == expected
    monkeypatch.undo()
    assert len(D.report(odd, bench).collect()) == len(ODD)
    assert D.report(none, bench).collect() == []
    assert {r.n_hit for r in D.report(odd, bench.where("false")).collect()} == {0}


def test_against_brute_force(spark, documents):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert sorted(map(tuple, D.report(documents, items).collect()), key=str) == brute([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_sql_of_items_without_an_id(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE TABLE documents AS SELECT * FROM (VALUES (1, 'say alpha beta gamma twice'), (2, 'clean')) t(doc_id, text)")
    con.sql("CREATE TABLE benchmark AS SELECT * FROM (VALUES (CAST(NULL AS BIGINT), 'alpha beta gamma'), (NULL, 'twice'), (7, 'beta')) t(item_id, text)")
    docs = spark.createDataFrame([(1, "say alpha beta gamma twice"), (2, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "alpha beta gamma"), (None, "twice"), (7, "beta")], "item_id long, text string")
    rows = sorted(map(tuple, D.report(docs, items).collect()))
    assert rows == sorted(con.sql(D.ORACLE_SQL).fetchall()) and rows[0][2:4] == (4, 2)


def test_automaton_in_arrays():
    import pickle
    import random

    rng = random.Random(1)
    items = [(str(i), [f"w{rng.randrange(20_000)}".encode() for _ in range(200)]) for i in range(250)]
    machine = D.Automaton(items, 13)
    assert len(pickle.dumps(machine)) < 100 * 50_000


def test_cutting_spans(spark, odd):
    item = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item + " rest"), (2, "clean"), (3, "f " * 1000 + item + "! end"), (4, None)], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in D.decontaminate(docs, items).collect()}
    assert set(kept) == {2, 3, 4} and kept[3].endswith("! end")
    cut = {r.doc_id: r.text for r in D.decontaminate(docs, items, longest=15).collect()}
    assert cut[3] == "f " * 1000 + "! end" and cut[2] == "clean" and cut[4] is None
    assert D.decontaminate(odd, items).columns == odd.columns
