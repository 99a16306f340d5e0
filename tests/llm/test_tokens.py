import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vesper.llm import tokens

from .conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_counts_are_the_librarys(documents, library):
    rows = documents.select("doc_id", "text").collect()
    expected = dict(zip((r.doc_id for r in rows), (len(x) for x in library.encode_batch([r.text for r in rows], add_special_tokens=False)), strict=True))
    got = tokens.count_tokens(documents, PATH).collect()
    assert {r.doc_id: r.n_tokens for r in got} == expected
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert {r.doc_id: r.n_bytes for r in got} == {r.doc_id: len(r.text.encode()) for r in rows}


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.sampled_from([*"aBéÀß×÷İıſŸŉªµz!~_'\t\n\r\x0b\x0c\x1c\x85\xa0 ́Σς漢1٣<|>endoftx.-"]), max_size=40))
def test_words_apart_count_like_the_whole(text):
    from tokenizers import Tokenizer

    whole = test_words_apart_count_like_the_whole.__dict__.setdefault("library", Tokenizer.from_file(PATH))
    count = test_words_apart_count_like_the_whole.__dict__.setdefault("count", tokens.counter(PATH, open(PATH, "rb").read()))
    for t in (text, text + "<|endoftext|>" + text):
        assert count([t.encode()]) == [len(whole.encode(t, add_special_tokens=False))]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(documents, name):
    path = public_tokenizers.path(name)
    rows = documents.limit(20).collect()
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        expected = [len(x) for x in Tokenizer.from_file(path).encode_batch([r.text for r in rows], add_special_tokens=False)]
    else:
        import sentencepiece

        expected = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([r.text for r in rows])]
    ids = [r.doc_id for r in rows]
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(documents.where(documents.doc_id.isin(ids)), path).collect()}
    assert got == dict(zip(ids, expected, strict=True))


def test_cache(spark, documents, tmp_path):
    cache = str(tmp_path / "cache")
    first = sorted(tokens.count_tokens(documents.where("doc_id < 100"), PATH, cache).collect())
    held = spark.read.parquet(cache)
    assert held.count() == held.select("digest").distinct().count()
    before = {r.digest for r in held.collect()}
    every = tokens.count_tokens(documents, PATH, cache).collect()
    held = spark.read.parquet(cache)
    assert held.count() == held.select("digest").distinct().count() > len(before)
    assert set(first) <= set(every)
    n = held.count()
    tokens.count_tokens(documents, PATH, cache).collect()
    assert spark.read.parquet(cache).count() == n


def test_odd_rows(odd, none):
    rows = tokens.count_tokens(odd, PATH).collect()
    assert len(rows) == len(ODD)
    assert {r.doc_id: r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1: 0, 2: 0, 3: 0}
    assert tokens.count_tokens(none, PATH).collect() == []
