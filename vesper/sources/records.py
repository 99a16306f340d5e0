"""Four-channel records of 4 x 2048 bytes as Parquet tables with explicit row ids, their packed form, and reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

CHANNELS = ("meta", "cam", "btree", "embed")
SIZE = 2048
SCHEMA = T.StructType([T.StructField("row_id", T.LongType(), False), *[T.StructField(c, T.BinaryType(), False) for c in CHANNELS]])
#: The mode byte of a record's meta channel.
MODES = {0: "Empty", 1: "Carrier", 2: "Gabor"}


def checked(records: DataFrame) -> DataFrame:
    """records by name, failing on a channel that isn't 2048 bytes long."""
    right = [F.when(F.octet_length(c) == SIZE, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} must have {SIZE} bytes")).cast("binary")).alias(c) for c in CHANNELS]
    return records.select(F.col("row_id").cast("long").alias("row_id"), *right)


def from_arrow(spark: SparkSession, table) -> DataFrame:
    """Records of an Arrow table or record batch."""
    import pyarrow as pa

    return checked(spark.createDataFrame(pa.Table.from_batches([table]) if isinstance(table, pa.RecordBatch) else table))


def to_arrow(records: DataFrame):
    """An Arrow table of a result that fits the driver."""
    return records.select("row_id", *CHANNELS).toArrow()


def write(records: DataFrame, path: str) -> None:
    """A new table; fails if there is one."""
    checked(records).write.mode("errorifexists").parquet(path)


def append(records: DataFrame, path: str) -> None:
    """Adds records behind those of the table, with ids from its greatest on, in their own order of row_id.

    Places are counted within ranges of row_id and added up over ranges, so no task numbers all rows.
    """
    spark = records.sparkSession
    last = spark.read.schema(SCHEMA).parquet(path).agg(F.max("row_id").alias("m")).first().m
    ranged = records.withColumn("_range", F.floor(F.col("row_id") / 100_000))
    before = ranged.groupBy("_range").count().select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))
    numbered = ranged.join(before, "_range").withColumn("row_id", F.lit(-1 if last is None else last) + F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy("row_id")))
    checked(numbered).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the session's checkpoints are in, which executors share; a temporary one only where none is set and the master is local."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="vesper-")
    return f"{folder.rstrip('/')}/records-{uuid.uuid4().hex}"


def pack() -> Column:
    """The 8192-byte form: meta, cam, btree, embed."""
    return F.concat(*CHANNELS)


def unpack(packed: str | Column) -> list[Column]:
    """The channels of a packed record, and no permutation."""
    data = F.col(packed) if isinstance(packed, str) else packed
    return [F.substring(data, 1 + SIZE * i, SIZE).alias(c) for i, c in enumerate(CHANNELS)] + [F.lit(None).cast("array<int>").alias("cam_perm")]


def zeros(spark: SparkSession, rows: int = 1) -> DataFrame:
    return spark.range(rows).select(F.col("id").alias("row_id"), *[F.lit(bytes(SIZE)).alias(c) for c in CHANNELS])


def filled(spark: SparkSession, rows: int, step: int = 1) -> DataFrame:
    """Row i has channels filled with i, i + step, i + 2 step, i + 3 step, modulo 256."""
    fill = lambda v: F.unhex(F.repeat(F.lpad(F.hex(F.pmod(v, F.lit(256))), 2, "0"), SIZE))
    return spark.range(rows).select(F.col("id").alias("row_id"), *[fill(F.col("id") + k * step).alias(c) for k, c in enumerate(CHANNELS)])


def mode(meta: str = "meta") -> Column:
    """Empty, Carrier or Gabor by the first byte; any other is Empty."""
    code = F.conv(F.hex(F.substring(F.col(meta), 1, 1)), 16, 10).cast("int")
    return F.when(code == 1, "Carrier").when(code == 2, "Gabor").otherwise("Empty")


def with_mode(name: str, meta: str = "meta") -> Column:
    code = next(k for k, v in MODES.items() if v == name)
    return F.concat(F.unhex(F.lit(f"{code:02X}")), F.substring(F.col(meta), 2, SIZE - 1))


def sweep_report(results: DataFrame) -> DataFrame:
    """One CSV line for each row of a parameter sweep, under the names that `write_report` puts first."""
    return results.select(F.concat_ws(",", F.col("d").cast("string"), "base", F.col("signed").cast("string"), F.col("axes").cast("string"), F.col("k").cast("string"), F.col("bind_depth").cast("string"), F.format_string("%.6f", "mean_error"), F.format_string("%.4f", "bell_coefficient"), F.format_string("%.1f", "bits_per_concept"), F.col("storage_bytes").cast("string")).alias("line"))


#: Fixed value: the report's first line.
REPORT_HEADER = "d,base,signed,axes,k,bind_depth,mean_error,bell_coefficient,bits_per_concept,storage_bytes"


def padded(text: Column, width: int) -> Column:
    """Text in a column of this width: padded, or cut to one less and an ellipsis."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, F.lit(1), F.lit(width - 1)), F.lit("…"))).otherwise(F.rpad(text, width, " "))
