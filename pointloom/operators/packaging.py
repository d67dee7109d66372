"""Frames, groups of frames, refreshes, segments and offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def frame_records(spark: SparkSession, start: int, end: int, step: int, fps: float) -> DataFrame:
    """frame, position and timestamp of an inclusive range."""
    return spark.range(1).select(F.posexplode(F.sequence(F.lit(start), F.lit(end), F.lit(step))).alias("position", "frame")).select("frame", "position", ((F.col("frame") - start) / fps).alias("timestamp"))


def sample_grid(frames: DataFrame, axes: dict[str, Sequence[float]]) -> DataFrame:
    """Every frame with every combination of the axes' values; the axes are short lists, not tables."""
    out = frames
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out


def refresh_interval(settings: Column, layer: Column, quality: Column, alias: Column, default: int = 1) -> Column:
    """The first of the map's entries for layer, quality, alias and "default", else the default."""
    return F.coalesce(*(F.try_element_at(settings, x) for x in (layer, quality, alias, F.lit("default"))), F.lit(default))


def groups_of_frames(members: DataFrame, keys: Sequence[str], position: str, size: str, gof: int) -> DataFrame:
    """Tumbling count windows: first and last position, members and bytes of each."""
    own = members.withColumn("gof", F.floor(F.col(position) / gof))
    return own.groupBy(*keys, "gof").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("members"), F.sum(size).alias("bytes"))


def refresh_flags(members: DataFrame, position: str, gof: int, interval: int) -> DataFrame:
    """is_refresh at each interval inside a group of frames, is_reset at its start."""
    place = F.col(position) % gof
    return members.withColumns({"is_refresh": place % interval == 0, "is_reset": place == 0})


def segments(members: DataFrame, keys: Sequence[str], position: str, gof: int, length: int, interval: int) -> DataFrame:
    """Adds gof and segment: cuts at group starts, refreshes and segment multiples inside a group."""
    place = F.col(position) % gof
    cut = ((place == 0) | (place % interval == 0) | (place % length == 0)).cast("int")
    w = Window.partitionBy(*keys, "gof").orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return members.withColumn("gof", F.floor(F.col(position) / gof)).withColumn("segment", F.sum(cut).over(w) - 1)


def offsets(members: DataFrame, keys: Sequence[str], position: str, size: str) -> DataFrame:
    """Adds where each member begins in its container: the bytes before it."""
    w = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return members.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("bigint"))


def missing_references(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges to parents that do not exist."""
    return edges.join(nodes.select(F.col("id").alias("parent")), "parent", "left_anti")


def coverage_gaps(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, with the side that lacks them; empty if both cover the same."""
    keys = expected.columns
    return expected.join(actual, keys, "left_anti").select(*keys, F.lit("actual").alias("lacking")).union(actual.select(*keys).distinct().join(expected, keys, "left_anti").select(*keys, F.lit("expected")))


def running_closure(members: DataFrame, keys: Sequence[str], position: str, size: str, gof: int) -> DataFrame:
    """Cold access where each member needs all earlier ones of its group: bytes and depth without recursion."""
    w = Window.partitionBy(*keys, F.floor(F.col(position) / gof)).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return members.withColumns({"cold_bytes": F.sum(size).over(w), "depth": F.count("*").over(w) - 1})
