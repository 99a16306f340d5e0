import sys

import duckdb
import pytest

import __spark_entry__
from vesper.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in frame.collect()), key=repr)
    if name in catalog.ORACLE_SQL:
        rel = duck.sql(catalog.ORACLE_SQL[name])
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in columns]
        assert got == sorted(([plain(r[i]) for i in at] for r in rel.fetchall()), key=repr)
    else:
        assert got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_parts(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("vesper.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("vesper.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)
            return None

    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    assert set(__spark_entry__.queries()) == set(catalog.QUERIES)


def test_searches_take_the_whole_query_set(spark, tmp_path):
    from pyspark.sql import functions as F

    asked = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 50 = 0").collect()}
    for name in ("flat_scan_hamming_set", "indexed_search_set", "indexed_search_counters"):
        assert {r.query_id for r in catalog.QUERIES[name](spark, SF).select("query_id").collect()} == asked
    # the counters of one query are those of the search by one vector
    rows, clusters, members = catalog.indexed(spark, SF)
    one = catalog.index.search(rows, clusters, members, catalog.first_row(rows), (10, 16, 17, 17))[1].first().asDict()
    assert catalog.indexed_search_counters(spark, SF).where("query_id = 0").drop("query_id").first().asDict() == one
    # no row 0: no hits
    spark.read.parquet(f"{SF}/embeddings.parquet").where(F.col("vec_id") > 0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert catalog.indexed_search(spark, str(tmp_path)).collect() == []


def test_residual_is_of_all_edges(spark):
    import numpy as np

    from vesper.operators import graph

    entities, edges, vecs, container = catalog.stored_edges(spark, SF)
    n = edges.count()
    assert {r.n_coefficients for r in catalog.organic_residual(spark, SF).collect()} == {n}
    # more edges than may be solved at once
    probes = graph.bound(graph.resolved(entities, edges), vecs, catalog.BASE).orderBy("seq").collect()
    t = np.array([r.probe for r in probes], float)
    best = np.linalg.lstsq(t.T, np.array(container), rcond=None)[0]
    for most in (2048, 5):
        rest, found = graph.residual(entities, edges, vecs, catalog.BASE, container, most)
        assert len(found) == n
        assert np.allclose(rest, np.array(container) - best @ t, atol=1e-6) and np.allclose(found, best, atol=1e-6)
    # more edges than places
    short = vecs.selectExpr("index", "slice(vec, 1, 8) vec")
    probes = graph.bound(graph.resolved(entities, edges), short, catalog.BASE).orderBy("seq").collect()
    t = np.array([r.probe for r in probes], float)
    best = np.linalg.lstsq(t.T, np.array(container[:8]), rcond=None)[0]
    rest, found = graph.residual(entities, edges, short, catalog.BASE, container[:8])
    assert n > 8 and np.allclose(rest, np.array(container[:8]) - best @ t, atol=1e-6) and np.allclose(found, best, atol=1e-6)


def test_sweeps_run_the_full_grids(spark):
    assert catalog.recovery_sweep(spark, SF).count() == 3024
    assert catalog.recognition_sweep(spark, SF).count() == 72


def test_places_of_writes_are_in_single_precision(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    # (x + 1) * 97 is 82 in single precision and less in double
    vectors = [[0.1, x, 0.3, 0.2] + [0.0] * 60 for x in (-0.15463918447494507, 0.25, -0.5)]
    # all in one container
    rows = pa.table({"vec_id": pa.array([24, 49, 74], pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))})
    pq.write_table(rows, f"{tmp_path}/embeddings.parquet")
    assert catalog.writes(spark, str(tmp_path)).where("seq = 24").first().y == 82 % 8
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = {tuple(r) for r in catalog.wavelet_readback(spark, str(tmp_path)).select("seq", "phase", "amplitude").collect()}
    assert got == set(con.sql(catalog.ORACLE_SQL["wavelet_readback"]).fetchall())
