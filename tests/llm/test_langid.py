import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from vesper.llm import kernels as K
from vesper.llm import langid as L

from .conftest import ODD


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = L.report(docs).collect()
    assert len(rows) == len(lang)
    out = [r for r in rows if r.held_out]
    assert {r.doc_id for r in out} == {i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_probabilities_add_up_and_are_kneser_neys():
    texts = ["abab abc", "bca cab b", "aaa"]
    data = " ".join(texts).encode()
    letters, of = L.characters(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    count = {}
    for gram in zip(*(c[1:].tolist() for c in L._back(letters, of, 3)), strict=True):
        count[gram] = count.get(gram, 0) + 1
    grams = [np.array(c) for c in zip(*count, strict=True)]
    n = np.array([*count.values()])
    # a language beside it that has other letters doesn't change anything
    model = L.kneser_ney([(grams, n), ([g + 5 for g in grams], n)], ["x", "y"], 3)
    model.size = size = 1 + len(set(letters.tolist()))
    alone = L.kneser_ney([(grams, n)], ["x"], 3)
    every = [*sorted(set(letters.tolist())), 999]
    for context in {g[1:] for g in count} | {(97, 97), (999, 97), (97, 999)}:
        asked = [np.array(every), *(np.full(size, c) for c in context)]
        assert model.probabilities(asked)[:, 0].sum() == pytest.approx(1.0)
        assert model.probabilities(asked)[:, 0] == pytest.approx(alone.probabilities(asked)[:, 0])
    # the highest order by hand: discounted share of the count plus weight times the lower order
    n1, n2 = (n == 1).sum(), (n == 2).sum()
    d = min(0.9, max(0.1, n1 / (n1 + 2 * n2)))
    gram = next(iter(count))
    same = [k for g, k in count.items() if g[1:] == gram[1:]]
    asked = [np.array([c]) for c in gram]
    lower = L.kneser_ney([(grams, n)], ["x"], 3)
    lower.p[3].value[:] = 0
    base = lower.probabilities(asked)[0, 0] / (d * len(same) / sum(same))
    expected = max(count[gram] - d, 0) / sum(same) + d * len(same) / sum(same) * base
    assert alone.probabilities(asked)[0, 0] == pytest.approx(expected)


def test_entropies_don_t_depend_on_blocks(spark, documents, monkeypatch):
    import pyarrow as pa

    models = L.train(documents)
    data, offsets = K.flat(pa.array([r.text for r in documents.limit(30).collect()] + ["", "é", "12 a"]))
    bits, n = L.Scorer(models).entropies(data, offsets)
    monkeypatch.setattr(L, "AT_ONCE", 999)
    monkeypatch.setattr(L, "KEPT", 9999)
    again, m = L.Scorer(models).entropies(data, offsets)
    assert again == pytest.approx(bits) and m.tolist() == n.tolist()


def test_many_languages(spark):
    import random

    rng = random.Random(2)
    rows = []
    for lang in range(260):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 7))) for _ in range(12)]
        rows += [(len(rows) + k, " ".join(rng.choice(words) for _ in range(40)), f"l{lang}") for k in range(6)]
    lang = {i: x for i, _, x in rows}
    out = [r for r in L.report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out]) > 0.97


def test_characters_don_t_depend_on_neighbours(documents):
    import pyarrow as pa

    texts = [r.text for r in documents.limit(20).collect()] + ["", "é", "12 a", " x "]
    data, offsets = K.flat(pa.array(texts))
    letters, of = L.characters(data, offsets)
    for i, t in enumerate(texts):
        one, own = L.characters(*K.flat(pa.array([t])))
        assert letters[of[i] : of[i + 1]].tolist() == one.tolist()


def test_odd_rows(spark, odd, none, documents):
    rows = {r.doc_id: r for r in L.report(odd).collect()}
    assert len(L.report(odd).collect()) == len(ODD)
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == rows[4].lang_pred == "und" and rows[1].score == 0
    models = L.train(documents)
    got = L.identify(odd, models)
    assert got.count() == len(ODD) and L.identify(none, models).collect() == []
    with pytest.raises(ValueError):
        L.train(none)
    assert L.report(none).collect() == []
    unknown = L.report(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(unknown) == len(ODD) and {r.lang_pred for r in unknown} == {"und"}
    gibberish = spark.createDataFrame([(1, "qxzjk vwqxz " * 40)], "doc_id long, text string")
    assert L.identify(gibberish, models).first().lang_rejected
    assert L.identify(documents, models).where("lang_rejected").count() <= 1


def test_scripts_are_told_apart(spark):
    import random

    rng = random.Random(1)
    # two languages a script, of words alike in length; the last script isn't learnt
    firsts = {"latin": 0x61, "cyrillic": 0x430, "greek": 0x3B1, "han": 0x4E00, "hangul": 0xAC00, "thai": 0xE01, "devanagari": 0x915, "arabic": 0x621}
    rows, strange = [], []
    for script, first in firsts.items():
        for half in (0, 1):
            step = 24 if script in ("han", "hangul") else 10
            letters = [chr(first + half * step + i) for i in range(step)]
            for _ in range(60):
                text = " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(60))
                if script == "arabic":
                    strange.append((len(strange), text))
                else:
                    rows.append((len(rows), text, f"{script}{half}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lang = {i: x for i, _, x in rows}
    out = [r for r in L.report(docs).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out]) == 1
    got = L.identify(spark.createDataFrame(strange, "doc_id long, text string"), L.train(docs))
    assert got.where("not lang_rejected").count() == 0
