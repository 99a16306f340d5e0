import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def spaced(text):
    return WORD.findall(lower(text))


#: Rows that every operator must bear: null, empty, blank, wordless, long, repeated, without id, wide characters.
ODD = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, " \t\n", "en", "b", 3), (4, "!!! ??? ...", "de", "a", 11), (5, "word " * 30_000, "en", "b", 150_000), (6, "same text here for two rows", "en", "a", 26), (6, "same text here for two rows", "en", "a", 26), (7, "same text here for two rows", "de", None, 26), (None, "a row without an id", "en", "a", 19), (8, "ÀÉ 漢字 😀 naïve ǅ ﬁ", "fr", "c", 16), (9, "x" * 50_000, "en", "c", 50_000), (10, "a\x00b c\x0bd", "en", "c", 7)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of names that operators use themselves.
CLASHES = {c: 1 for c in ("fp", "node", "size", "n_words", "hit_spans", "pii", "copy", "score", "lang_pred", "digest", "row", "start", "_spans", "component_id", "copies", "target")}


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(v) for c, v in CLASHES.items()})


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
