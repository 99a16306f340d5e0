"""XOR delta layers over immutable ground tables, and overlays with snapshots.

Layers are rows (key, layer_seq, delta) beside ground rows (key, value); vectors
are arrays of 64-bit words. XOR commutes, so reading all layers is one grouped
aggregate with a map-side part, whatever the number of layers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V


def read(ground: Column | str, delta: Column | str) -> Column:
    """The value under one layer; collapsing it writes this."""
    return V.xor(ground, delta)


def write(ground: Column | str, value: Column | str) -> Column:
    """The delta that makes ground read as value."""
    return V.xor(ground, value)


def patch(delta: Column | str, change: Column | str) -> Column:
    return V.xor(delta, change)


def clean(words: int) -> Column:
    return F.array_repeat(F.lit(0).cast("long"), words)


def fold(layers: DataFrame, key: str = "key") -> DataFrame:
    """(key, delta): the XOR of each key's layers, by word."""
    words = layers.select(key, F.posexplode("delta").alias("pos", "word"))
    by_word = words.groupBy(key, "pos").agg(F.bit_xor("word").alias("word"))
    return by_word.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w")).select(key, F.transform("w", lambda x: x["word"]).alias("delta"))


def read_all(ground: DataFrame, layers: DataFrame, key: str = "key") -> DataFrame:
    """(key, value, depth) of ground through all layers; keys without a layer read as ground."""
    depth = layers.groupBy(key).agg(F.count("*").alias("depth"))
    joined = ground.join(fold(layers, key), key, "left").join(depth, key, "left")
    return joined.select(key, F.when(F.col("delta").isNull(), F.col("value")).otherwise(V.xor("value", "delta")).alias("value"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


def read_through(ground: DataFrame, layers: DataFrame, key: str = "key", upto: int | None = None) -> DataFrame:
    """(key, layer_seq, value): each version of each key, or that through the layer `upto`."""
    words = layers.select(key, "layer_seq", F.posexplode("delta").alias("pos", "word"))
    running = words.withColumn("word", F.bit_xor("word").over(Window.partitionBy(key, "pos").orderBy("layer_seq").rowsBetween(Window.unboundedPreceding, 0)))
    versions = running.groupBy(key, "layer_seq").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w")).select(key, "layer_seq", F.transform("w", lambda x: x["word"]).alias("delta"))
    if upto is not None:
        versions = versions.where(F.col("layer_seq") <= upto).withColumn("_last", F.max("layer_seq").over(Window.partitionBy(key))).where("layer_seq = _last").drop("_last")
    return versions.join(ground, key).select(key, "layer_seq", V.xor("value", "delta").alias("value"))


def push(layers: DataFrame, ground: DataFrame, key: str = "key") -> DataFrame:
    """layers with a clean one on top of every key."""
    depth = ground.select(key, "value").join(layers.groupBy(key).agg(F.count("*").alias("depth")), key, "left")
    top = depth.select(key, F.coalesce("depth", F.lit(0)).cast("long").alias("layer_seq"), F.transform("value", lambda x: x * 0).alias("delta"))
    return layers.select(key, F.col("layer_seq").cast("long").alias("layer_seq"), "delta").unionByName(top)


def collapse_all(ground: DataFrame, layers: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """The new ground, and no layers; the old ground is the table given."""
    return read_all(ground, layers, key).select(key, "value"), layers.where("false")


def collapse_layer(ground: DataFrame, layers: DataFrame, seq: int, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """One layer goes into ground; the others move up."""
    one = layers.where(F.col("layer_seq") == seq).select(key, "delta")
    new = ground.join(one, key, "left").select(key, F.when(F.col("delta").isNull(), F.col("value")).otherwise(V.xor("value", "delta")).alias("value"))
    rest = layers.where(F.col("layer_seq") != seq).withColumn("layer_seq", F.when(F.col("layer_seq") > seq, F.col("layer_seq") - 1).otherwise(F.col("layer_seq")))
    return new, rest


def changed_bits(ground: DataFrame, layers: DataFrame, key: str = "key") -> DataFrame:
    """(key, changed): bits in which the value read through all layers differs from ground."""
    return ground.select(key).join(fold(layers, key), key, "left").select(key, F.coalesce(V.popcount("delta"), F.lit(0)).cast("long").alias("changed"))


# overlays: rows (overlay_id, buffer) and snapshots (overlay_id, depth, buffer)


def overlay_read(base: Column | str, buffer: Column | str, how: str) -> Column:
    """Base through an overlay: "xor", "add" (modulo 256) or "add_i8" (saturating). Flushing writes this and clears the overlay."""
    return {"xor": V.xor, "add": V.phase_bind, "add_i8": V.saturating_add_i8}[how](base, buffer)


def flush(base: DataFrame, overlays: DataFrame, how: str, key: str = "overlay_id", column: str = "value") -> tuple[DataFrame, DataFrame]:
    """base with its overlays committed, and cleared overlays."""
    joined = base.join(overlays.select(key, F.col("buffer").alias("_buffer")), key, "left")
    new = joined.withColumn(column, F.when(F.col("_buffer").isNull(), F.col(column)).otherwise(overlay_read(F.col(column), F.col("_buffer"), how))).drop("_buffer")
    return new, discard(overlays)


def discard(overlays: DataFrame) -> DataFrame:
    return overlays.withColumn("buffer", F.transform("buffer", lambda x: x * 0))


def snapshot(overlays: DataFrame, snapshots: DataFrame, key: str = "overlay_id") -> DataFrame:
    """snapshots with the overlays' buffers on top."""
    depth = overlays.join(snapshots.groupBy(key).agg(F.count("*").alias("_depth")), key, "left")
    return snapshots.select(key, F.col("depth").cast("long").alias("depth"), "buffer").unionByName(depth.select(key, F.coalesce("_depth", F.lit(0)).cast("long").alias("depth"), "buffer"))


def rewind(overlays: DataFrame, snapshots: DataFrame, key: str = "overlay_id") -> tuple[DataFrame, DataFrame]:
    """Overlays as of their last snapshot, with `rewound` (false where there was none), and the snapshots before it."""
    last = snapshots.groupBy(key).agg(F.max("depth").alias("_top"), F.max_by("buffer", "depth").alias("_old"))
    back = overlays.join(last, key, "left").withColumn("rewound", F.col("_old").isNotNull()).withColumn("buffer", F.coalesce("_old", "buffer"))
    rest = snapshots.join(last.select(key, "_top"), key).where("depth < _top").drop("_top")
    return back.drop("_old", "_top"), rest
