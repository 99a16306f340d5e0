"""Token counts with a digest cache.

The cache is a table (tokenizer, digest, n_tokens) in a folder. A text's digest is
that of its normalised content, the tokenizer's that of its file and library
version. Stored counts are joined; of what is missing each different text is
encoded once and appended.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .session import bound_batches, cut, scratch

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"
#: Different words whose counts a worker keeps, and the longest that it keeps, in bytes.
MEMO_WORDS, MEMO_BYTES = 300_000, 64


def version(path: str) -> tuple[str, bytes]:
    """Digest of a tokenizer's file and library, and the file's bytes."""
    with open(path, "rb") as f:
        data = f.read()
    if path.endswith(".json"):
        import tokenizers as library
    elif path.endswith(".model"):
        import sentencepiece as library
    else:
        raise ValueError("a tokenizer is a .json or .model file")
    return hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode() + data).hexdigest(), data


def splits_at_space(path: str, data: bytes) -> bool:
    """Whether the tokenizer drops white space before anything else, so that the words of a text can be encoded apart."""
    if not path.endswith(".json"):
        return False
    spec = json.loads(data)
    steps = lambda x, key: [] if not x else x[key] if x["type"] == "Sequence" else [x]
    normal = [n["type"] for n in steps(spec.get("normalizer"), "normalizers")]
    first = (steps(spec.get("pre_tokenizer"), "pretokenizers") or [{}])[0]
    pattern = first.get("pattern", {}).get("Regex", "") if first.get("type") == "Split" else ""
    # every alternative is of other than white space, and what lies between matches is removed
    alternatives = {"[\\p{L}]+", "[\\p{N}]", "[\\p{N}]+", "[^\\s\\p{L}\\p{N}]+"}
    plain = all(a in alternatives or a.replace("'", "").isalpha() for a in pattern.split("|"))
    whole = spec.get("truncation") is None and spec.get("padding") is None
    special = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not t["normalized"] and not any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
    return bool(pattern) and plain and whole and special and first.get("behavior") == "Removed" and first.get("invert") is True and set(normal) <= {"NFC", "Replace", "Lowercase"}


def piece_counter(tokenizer, data: bytes) -> Callable[[list[bytes]], dict[bytes, int]] | None:
    """Counts words of plain characters by what the library's model makes of their pieces; leaves out all other words.

    Plain are printable ASCII and the precomposed Latin letters up to U+017F that
    composition leaves alone and lower-casing maps one to one. Their pieces are
    those of the tokenizer's own pattern. None if the tokenizer does anything else.
    """
    spec = json.loads(data)
    kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    after = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[1:]
    model = spec["model"]
    if kinds != ["NFC", "Replace", "Lowercase"] or [a.get("type") for a in after] != ["ByteLevel"] or after[0]["add_prefix_space"] or after[0]["use_regex"] or model["type"] != "BPE" or model["dropout"]:
        return None
    letters, digits = "a-z\u00df-\u00f6\u00f8-\u017f", "0-9"
    pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    find = re.compile(pattern.replace("\\p{L}", letters).replace("\\p{N}", digits)).findall
    plain = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*").fullmatch
    special = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])) or "(?!)").search
    # the byte-level alphabet: printable bytes stand for themselves, others for code points from 256 on
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    byte_level = str.maketrans({chr(b): chr(256 + i) for i, b in enumerate(rest)})
    tokenize = tokenizer.model.tokenize
    memo: dict[str, int] = {}

    def count(words: list[bytes]) -> dict[bytes, int]:
        if len(memo) > MEMO_WORDS:
            memo.clear()
        out = {}
        for word in words:
            text = word.decode()
            if plain(text) and not special(text):
                n = 0
                for piece in find(text.lower()):
                    if (k := memo.get(piece)) is None:
                        k = len(tokenize(piece.encode().decode("latin-1").translate(byte_level)))
                        if len(piece) <= MEMO_BYTES:
                            memo[piece] = k
                    n += k
                out[word] = n
        return out

    return count


def counter(path: str, data: bytes) -> Callable[[list[bytes]], list[int]]:
    """A function from texts (UTF-8) to their token counts."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(x) for x in model.encode([t.decode() for t in texts], num_threads=1)] if texts else []
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(data.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    whole = lambda texts: [len(x) for x in encode([t.decode() for t in texts], add_special_tokens=False)]
    if not splits_at_space(path, data):
        return whole
    memo: dict[bytes, int] = {}
    pieces = piece_counter(tokenizer, data)

    def count_words(new: list[bytes]) -> dict[bytes, int]:
        out = pieces(new) if pieces else {}
        rest = [w for w in new if w not in out]
        return out | dict(zip(rest, whole(rest), strict=True))

    def by_word(texts: list[bytes]) -> list[int]:
        split = [t.split() for t in texts]  # at ASCII white space
        if len(memo) > MEMO_WORDS:
            memo.clear()
        found = count_words(list({w for words in split for w in set(words).difference(memo)}))
        memo.update((w, n) for w, n in found.items() if len(w) <= MEMO_BYTES)
        rest = {w: n for w, n in found.items() if len(w) > MEMO_BYTES}
        if rest:
            return [sum(memo[w] if w in memo else rest[w] for w in words) for words in split]
        return [sum(map(memo.__getitem__, words)) for words in split]

    return by_word


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_tokens, over_limit, digest.

    tokenizer: path of a .json or .model file, which the driver reads and sends
    to the workers. No begin, end or added special tokens are counted; the
    strings of special tokens in a text are treated as the library does by
    default. A null text counts as empty: 0 bytes and tokens. Rows that repeat
    share one entry of the cache and keep a row each, as do rows without an id; an
    empty table has no rows and adds nothing. cache: its folder, made if missing;
    None: one for this call. Other columns of docs aren't read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    digest_of_tokenizer, data = version(tokenizer)
    cache = cache or scratch(spark, "token-cache")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # white space that the tokenizer drops anyway doesn't make another text
    normal = F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\x0B\\x0C]+", " ")) if splits_at_space(tokenizer, data) else text
    digest = F.unhex(F.sha2(normal.cast("binary"), 256))
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache) if _exists(spark, cache) else spark.createDataFrame([], CACHE_SCHEMA)
    known = known.where(F.col("tokenizer") == digest_of_tokenizer).select("digest").distinct()
    # different texts only, first within each task
    missing = docs.select(digest.alias("digest"), normal.alias("text")).groupBy("digest").agg(F.first("text").alias("text")).join(known, "digest", "left_anti")
    held = spark.sparkContext.broadcast(data)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer, held.value)
        for batch in batches:
            texts, out = batch.column(1), []
            for i, j, block, offsets in K.blocks(texts):
                raw = block.tobytes()
                out += count([raw[offsets[k] : offsets[k + 1]] for k in range(j - i)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["digest", "n_tokens"])

    new = missing.mapInArrow(encode, "digest binary, n_tokens bigint")
    new.select(F.lit(digest_of_tokenizer).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == digest_of_tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = cut(counts)  # so that the join has a shuffle of its own, whose large partitions are split
    rows = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), digest.alias("digest"))
    return rows.join(counts, "digest").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.lower(F.hex("digest")).alias("digest"))
