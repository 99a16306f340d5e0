"""Incremental forms of appending, index upkeep, co-occurrence and learning, by Structured Streaming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import index
from ..sources import records


def _once(spark: SparkSession, path: str, batch_id: int, rows: DataFrame) -> None:
    """Writes a batch's rows at path in a folder of its own, which a retry of the batch replaces."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def append_records(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Each batch of a record stream (channels, row_id by order within the batch) is appended to the table at path.

    Before a batch is appended the number of rows that the table has is written
    beside the checkpoint; a batch that is retried, and finds more rows than that,
    was appended already. Nothing else may append to the table meanwhile.
    """
    spark = stream.sparkSession
    marks = f"{checkpoint.rstrip('/')}-appended"

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        have = records.read(spark, path).count()
        mark = f"{marks}/{number}"
        if _exists(spark, mark):
            before = spark.read.parquet(mark).first().rows
            if have > before:
                return  # it was appended; only the stream's own commit was lost
        else:
            spark.createDataFrame([(have,)], "rows bigint").write.mode("overwrite").parquet(mark)
        records.append(batch, path)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def learn_records(stream: DataFrame, clusters: DataFrame, members_path: str, radii_path: str, checkpoint: str, update_meta: bool = False) -> DataStreamWriter:
    """Each batch is put in its nearest clusters: memberships go to members_path, how far and how many they are to radii_path.

    `grown` and `with_members` give the index of all batches so far. As with
    `index.learn`, rows aren't found by search until meta has them, which
    update_meta=True brings about. A batch that is retried replaces itself.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        channels = index.CHANNELS if update_meta else index.CHANNELS[1:]
        placed = [index.assign(batch, c, clusters.where(F.col("channel") == c).select("cluster_id", "centre")) for c in channels]
        _once(spark, members_path, number, reduce(DataFrame.unionByName, [p.select("channel", "cluster_id", "row_id") for p in placed]))
        _once(spark, radii_path, number, reduce(DataFrame.unionByName, placed).groupBy("channel", "cluster_id").agg(F.max("dist").alias("radius"), F.count("*").alias("n")))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def grown(clusters: DataFrame, radii_path: str) -> DataFrame:
    """clusters with the radii and sizes that all learnt batches make of them."""
    more = clusters.sparkSession.read.parquet(radii_path).groupBy("channel", "cluster_id").agg(F.max("radius").alias("_radius"), F.sum("n").alias("_n"))
    both = clusters.join(more, ["channel", "cluster_id"], "left")
    return both.select("channel", "cluster_id", "centre", F.greatest("radius", F.coalesce("_radius", "radius")).alias("radius"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"))


def with_members(members: DataFrame, members_path: str) -> DataFrame:
    """members and those of all learnt batches."""
    return members.unionByName(members.sparkSession.read.parquet(members_path).select("channel", "cluster_id", "row_id"))


def windowed_cooccurrence(events: DataFrame, time: str, item: str, width: str, late: str = "10 minutes") -> DataFrame:
    """(window, items): the set of items of each tumbling window; pairs follow by `pairs_of`. Windows and lateness are an addition."""
    windows = events.withWatermark(time, late) if events.isStreaming else events
    return windows.groupBy(F.window(time, width).alias("window")).agg(F.array_sort(F.collect_set(item)).alias("items"))


def pairs_of(windows: DataFrame) -> DataFrame:
    """(i, j), i < j, of each window's items."""
    indexed = windows.select("window", "items", F.posexplode("items").alias("p", "i"))
    return indexed.select("window", "i", F.explode(F.slice("items", F.col("p") + 2, F.greatest(F.size("items") - F.col("p") - 1, F.lit(0)))).alias("j"))


def learn_classes(stream: DataFrame, classes: DataFrame, sums_path: str, checkpoint: str) -> DataStreamWriter:
    """Sums and counts of each batch of examples (class_idx, vec) are written at sums_path, once however often a batch is retried; `learnt_classes` reads the means."""

    def step(batch: DataFrame, number: int) -> None:
        sums = batch.select("class_idx", F.posexplode("vec").alias("pos", "x")).groupBy("class_idx", "pos").agg(F.sum("x").alias("total"), F.count("*").alias("n"))
        _once(stream.sparkSession, sums_path, number, sums)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def learnt_classes(classes: DataFrame, sums: DataFrame) -> DataFrame:
    """Templates as `recognise.learn` gives them, from sums of earlier batches."""
    own = classes.select("class_idx", F.posexplode("template").alias("pos", "x"))
    whole = own.select("class_idx", "pos", F.col("x").cast("long").alias("total"), F.lit(1).cast("long").alias("n")).unionByName(sums.select("class_idx", "pos", F.col("total").cast("long").alias("total"), F.col("n").cast("long").alias("n")))
    mean = F.sum("total") / F.sum("n")
    places = whole.groupBy("class_idx", "pos").agg(F.greatest(F.lit(-128), F.least(F.lit(127), F.signum(mean) * F.floor(F.abs(mean) + 0.5))).cast("int").alias("v"))
    learnt = places.groupBy("class_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("w")).select("class_idx", F.transform("w", lambda x: x["v"]).alias("template"))
    return classes.select("class_idx", "class_id").join(learnt, "class_idx")
