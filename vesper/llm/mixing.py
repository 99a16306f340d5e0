"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

A source's documents are put in order of size and of a digest of the id. Each has the same expected
number of copies, the source's target over its size, so the prefix sum at the
n-th document is n times that number; with one random offset a source, a document
is taken once for each integer between two prefix sums. As neighbours in that
order are of nearly equal size, the words taken come as near to the target as the
source's largest document allows.

The rank n is never counted in one task: it is the sum of the documents of smaller
sizes, of earlier digest ranges of that size, and of earlier ones of that range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of equal source and size that one window ranks together, about.
RANGE_ROWS = 20_000
#: Equal rows that are numbered at once.
PART_ROWS = 4096


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size) with target added: all words are shared by weight, none above most times its source's size.

    Sources in code point order, null last, have these weights in turn. The
    excess of a stopped source goes to the others by weight, until none is above:
    all take one level times their weight or what they are stopped at, so the
    sources are sorted by the level at which they stop.
    """
    everything = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(cycle, ((F.col("n") - 1) % len(weights) + 1).cast("int"))).withColumn("stop", F.lit(float(most)) * F.col("source_size")).withColumn("stops_at", F.col("stop") / F.col("weight"))
    before = Window.orderBy("stops_at", "n").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("stops_at", "n").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level)
    # the level is that of the first source that doesn't stop; if none goes on, all stop
    least = F.min(F.when(F.col("level") < F.col("stops_at"), F.struct("stops_at", "n", "level"))).over(everything)
    return ranked.withColumn("final", least["level"]).select("source", "source_size", F.coalesce(F.least("stop", F.col("weight") * F.col("final")), F.col("stop")).alias("target"))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys, null being equal to null."""
    b = b.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    return a.join(b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*[f"_{k}" for k in keys])


def _draw(rank: Column, most: float) -> Column:
    """Copies of the document of that rank; rounding of large ranks doesn't take them above most, rounded up."""
    each, offset = F.col("each"), F.col("offset")
    return F.least(F.floor(rank * each + offset) - F.floor((rank - 1) * each + offset), F.lit(-int(-most // 1))).cast("int")


def plan(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 0) -> DataFrame:
    """From (id, source, size, same, rows), rows being of equal documents: source_size, target, before, each and offset added.

    Documents of a source are in order of size, of the id's md5 and of `same`;
    before is the rank of the one before. The md5 spreads ids of any type and
    spacing evenly over ranges. The offset is a hash of seed and source: reruns
    agree. The table of sources, a row each, is sorted in one task.
    """
    sized = cut(sized.withColumn("at", F.md5(F.when(F.col("id").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("id").cast("string"))))))
    by_source = targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), weights, most)
    ranges = -(-sized.count() // RANGE_ROWS)
    of_range = F.floor(F.conv(F.substring("at", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) * ranges).cast("long")
    ranged = sized.withColumn("range", of_range)

    counts = ranged.groupBy("source", "size", "range").agg(F.sum("rows").alias("n"))
    of_size = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    smaller = of_size.select("source", "size", (F.sum("n").over(Window.partitionBy("source").orderBy("size")) - F.col("n")).alias("smaller"))
    earlier = counts.select("source", "size", "range", (F.sum("n").over(Window.partitionBy("source", "size").orderBy("range")) - F.col("n")).alias("earlier"))
    ranks = _same(_same(earlier, smaller, ["source", "size"]), by_source, ["source"]).withColumn("first", F.col("smaller") + F.col("earlier")).drop("smaller", "earlier")
    own = Window.partitionBy("source", "size", "range").orderBy("at", "same").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("first") + F.sum("rows").over(own) - F.col("rows")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))))
    offset = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ranked = _same(ranged, ranks, ["source", "size", "range"])
    return ranked.select("id", "source", "size", "same", "rows", "source_size", "target", before.alias("before"), each.alias("each"), offset.alias("offset"))


def _each_row(planned: DataFrame, most: float) -> DataFrame:
    """A row for each of the equal documents of a row, with its copies."""
    parts = planned.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / PART_ROWS))))
    nth = F.explode(F.sequence(F.col("part") * PART_ROWS + 1, F.least(F.col("rows"), (F.col("part") + 1) * PART_ROWS)))
    return parts.withColumn("nth", nth).withColumn("copies", _draw(F.col("before") + F.col("nth"), most)).drop("part")


def _size(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")


def report(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id_col, size, source_size, target, taken (words the mix takes) for each row of docs.

    Size: runs of other than ASCII white space; null and empty texts have 0. Each
    row has a draw of its own, rows that repeat an id or have none as well; ids may
    be of any type that casts to string. A null source is one source. An empty
    table has no rows. Other columns aren't read.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _size(text_col).alias("size")).groupBy("id", "source", "size").agg(F.count("*").alias("rows"))
    planned = plan(sized.withColumn("same", F.lit(0)), weights, most, seed)
    return _each_row(planned, most).select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken, with its own columns and `copy` (1, 2, ...).

    A column `copy` of docs is replaced. Sizes, draws, null ids, sources and texts
    as in report(): the words taken are the same. Empty documents are drawn like
    others. Rows that are equal in all columns stand for each other. An empty table
    gives an empty mix.
    """
    docs = docs.drop("copy")
    names = docs.columns
    # maps have no hash of their own
    same = F.xxhash64(*[F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields])
    keyed = docs.withColumns({"_vesper_size": _size(text_col), "_vesper_same": same})
    sized = keyed.groupBy(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col("_vesper_size").alias("size"), F.col("_vesper_same").alias("same")).agg(F.count("*").alias("rows"))
    taken = (F.floor((F.col("before") + F.col("rows")) * F.col("each") + F.col("offset")) > F.floor(F.col("before") * F.col("each") + F.col("offset")))
    planned = cut(plan(sized, weights, most, seed).where(taken).select("id", "source", "size", "same", "rows", "before", "each", "offset"))

    def joined(part: DataFrame) -> DataFrame:
        part = part.select(*[F.col(c).alias(f"_vesper_of_{c}") for c in part.columns])
        on = F.col(id_col).eqNullSafe(F.col("_vesper_of_id")) & F.col(source_col).eqNullSafe(F.col("_vesper_of_source")) & (F.col("_vesper_size") == F.col("_vesper_of_size")) & (F.col("_vesper_same") == F.col("_vesper_of_same"))
        return keyed.join(part, on)

    def copied(rows: DataFrame) -> DataFrame:
        return rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))

    single = planned.where("rows = 1").withColumn("copies", _draw(F.col("before") + 1, most)).drop("before", "each", "offset")
    out = joined(single).withColumnRenamed("_vesper_of_copies", "_vesper_copies").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_vesper_copies")))).select(*[f"`{c}`" for c in names], "copy")
    repeated = planned.where("rows > 1")
    if repeated.isEmpty():
        return out
    # of equal rows one is kept, as often as all of them are taken
    held = joined(repeated).groupBy("_vesper_of_same", "_vesper_of_id", "_vesper_of_source", "_vesper_of_size").agg(F.first(F.struct(*[f"`{c}`" for c in names])).alias("doc"), *[F.first(f"_vesper_of_{c}").alias(c) for c in ("rows", "before", "each", "offset")])
    return out.unionByName(copied(_each_row(held, most)).select("doc.*", "copy"))


#: DuckDB SQL of report() with its defaults over the table documents.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM sized GROUP BY source
), weighted AS (
  SELECT *, CAST((n - 1) % 3 + 1 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS stop FROM sources
), levels AS (
  SELECT *, stop / weight AS stops_at,
    (sum(source_size) OVER () - coalesce(sum(stop) OVER (ORDER BY stop / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY stop / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), chosen AS (
  SELECT source, source_size, coalesce(least(stop, weight * (SELECT level FROM levels WHERE level < stops_at ORDER BY stops_at, n LIMIT 1)), stop) AS target FROM levels
), ranked AS (
  SELECT s.doc_id, s.size, c.source_size, c.target,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, md5(CASE WHEN s.doc_id IS NULL THEN '-' ELSE '+' || CAST(s.doc_id AS VARCHAR) END), s.doc_id) AS i,
    CASE WHEN c.source_size > 0 THEN c.target / c.source_size ELSE 0 END AS each,
    CAST(CAST('0x' || substr(md5('0:' || CASE WHEN s.source IS NULL THEN '-' ELSE '+' || s.source END), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM sized s JOIN chosen c ON s.source IS NOT DISTINCT FROM c.source
)
SELECT doc_id, size, source_size, target, CAST(size * least(floor(i * each + u) - floor((i - 1) * each + u), 3) AS BIGINT) AS taken FROM ranked
"""
