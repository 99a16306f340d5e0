import corpus_pipeline
from pyspark.sql import functions as F

from .conftest import ODD

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents):
    docs = documents
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF).cache()
        if i < 4:
            assert out.columns == docs.columns
        assert 0 < out.count() and out.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0
        docs = out
    assert docs.where(F.col("text").contains("@mail")).count() == 0


def test_one_row_of_each_group_stays(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(5, words(1)), (3, words(1)), (3, words(2)), (9, words(2)), (None, words(1)), (None, words(3)), (None, words(3)), (7, words(4)), (7, words(4)), (8, None), (6, ""), (2, "y")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(map(lambda r: (r.doc_id, r.text), got.collect()), key=repr) == sorted([(3, words(1)), (3, words(2)), (None, words(3)), (7, words(4)), (6, ""), (2, "y")], key=repr)


def test_near_duplicates_against_brute_force(spark, documents):
    from .test_simhash import brute, groups

    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, documents, SF).collect()}
    assert got == set(groups([(r.doc_id, brute(r.text)) for r in documents.collect()]).values())


def test_run_agrees_with_itself(spark):
    key = lambda r: (r.doc_id, r.copy)
    assert sorted(corpus_pipeline.run(spark, SF).collect(), key=key) == sorted(corpus_pipeline.run(spark, SF).collect(), key=key)


def test_odd_rows(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() <= 3 * len(ODD)
        assert stage(spark, odd.where("false"), SF).collect() == []
