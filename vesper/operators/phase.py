"""Bundles of phase vectors by group."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _by_place(rows: DataFrame, group: str, vector: str, value) -> DataFrame:
    places = rows.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(value.alias("v"))
    return places.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("w")).select(group, F.transform("w", lambda x: x["v"]).alias("bundle"))


def bundle_mean(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, bundle): the whole part of each place's mean."""
    return _by_place(rows, group, vector, F.floor(F.sum("x") / F.count("x")).cast("int"))


def bundle_circular(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, bundle): the mean angle of each place in 256ths, rounded; what rounds to 256 is 255."""
    angle = F.col("x") * F.lit(2 * math.pi / 256)
    turn = F.atan2(F.sum(F.sin(angle)), F.sum(F.cos(angle))) * F.lit(256 / (2 * math.pi))
    return _by_place(rows, group, vector, F.least(F.lit(255), F.round(F.pmod(turn, F.lit(256.0)))).cast("int"))


def bundle_xor(rows: DataFrame, group: str, vector: str) -> DataFrame:
    return _by_place(rows, group, vector, F.bit_xor("x"))


def bundle_majority(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """Binary vectors: 1 where at least half of a group has it."""
    return _by_place(rows, group, vector, F.when(2 * F.sum("x") >= F.count("x"), 1).otherwise(0))


def bundle_clamped(rows: DataFrame, group: str, vector: str, low: int, high: int) -> DataFrame:
    """Sums, clamped once."""
    return _by_place(rows, group, vector, F.greatest(F.lit(low), F.least(F.lit(high), F.sum("x"))).cast("int"))
