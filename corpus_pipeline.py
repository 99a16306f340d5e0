"""A cleaning pipeline over the table documents: each stage works on all that the one before kept.

Language ID (rejected documents go), SimHash near-duplicates (the smallest id of
each group stays), benchmark decontamination (contaminated documents go), personal
data (masked), and mixing of sources to target weights.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesper.llm import decontaminate, langid, mixing, pii, simhash
from vesper.llm.session import scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; models learn from the rows' own labels. Without any label all rows stay."""
    if docs.where("lang is not null and text is not null").limit(1).count() == 0:
        return docs.select(*COLUMNS)
    return langid.identify(docs.select(*COLUMNS), langid.train(docs)).where("not lang_rejected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id, of equal or missing ids the first by content.

    Groups are of rows' fingerprints, whatever the ids: rows that share an id and
    differ are in groups of their own. Texts are shuffled once, to meet the rows
    that stay.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(*COLUMNS).alias("content"))
    marked = docs.select(*COLUMNS).withColumn("_order", order)
    groups = simhash.near_duplicates(marked.select("_order", "text"), id_col="_order", shingle=4, limit=4, seed=42)
    # rows that are equal in all columns have one group and one order
    chosen = groups.where(F.col("_order") == F.col("component_id")).select("_order").distinct()
    kept = marked.join(chosen, "_order", "left_semi")
    repeated = chosen.join(groups.groupBy("_order").count().where("count > 1"), "_order", "left_semi")
    if repeated.isEmpty():
        return kept.select(*COLUMNS)
    once = kept.join(repeated, "_order", "left_semi").groupBy("_order").agg(*[F.first(c).alias(c) for c in COLUMNS])
    return kept.join(repeated, "_order", "left_anti").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is inside benchmark windows; null and empty texts have none. Rows that repeat or have no id are judged each."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, share=0.05)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text. A null text stays null with its n_chars; repeated rows and rows without an id stay."""
    masked = pii.mask(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them: columns of documents and copy (1, 2, 3). Each row has its own draw, with or without id, text or source."""
    return mixing.mix(docs.select(*COLUMNS), weights=(1, 2, 3), most=3.0, seed=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("pii", personal_data),
    ("mixing", mixture),
]

#: Not expressible: the language models, fingerprints and the span classifier have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
