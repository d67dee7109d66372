"""Quality profiles: summaries, gains between qualities, and lookup at a view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.columns import aggregate, if_complete, wrapped

SPAN_FLOORS = {"azimuth": 180.0, "elevation": 45.0, "scale": 1.0, "timestamp": 1e-6}


def summarize(facts: DataFrame, keys: Sequence[str], value: str, weight: str | None = None, higher_is_better: bool = False) -> DataFrame:
    """mean, median, p95, worst (and weighted_mean) per key, with sample_count; null if any value is missing."""
    x = F.col(value)
    stats = {"mean": aggregate("mean", x), "median": aggregate("median", x), "p95": aggregate("p95", x), "worst": aggregate("worst", x, higher_is_better=higher_is_better)}
    if weight:
        stats["weighted_mean"] = aggregate("weighted_mean", x, F.coalesce(F.col(weight), F.lit(1.0)))
    return facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("sample_count"), *(if_complete(x, s).alias(n) for n, s in stats.items()))


def gains(facts: DataFrame, view_keys: Sequence[str], rank: str, value: str, order: Sequence[str] | None = None) -> DataFrame:
    """Loss saved by going from each quality to the next higher one at the same view.

    With `order`, qualities are paired as it lists them, and a view that lacks one raises.
    """
    w = Window.partitionBy(*view_keys).orderBy("_rank")
    ranks = F.array_position(F.array(*map(F.lit, order)), F.col(rank)) if order else F.col(rank)
    out = facts.withColumn("_rank", ranks).where(F.col("_rank") > 0) if order else facts.withColumn("_rank", ranks)
    out = out.withColumns({"quality_to": F.lead(rank).over(w), "gain": F.col(value) - F.lead(value).over(w), "_next": F.lead("_rank").over(w), "_first": F.row_number().over(w)})
    if order:
        whole = (F.col("_rank") == F.col("_first")) & (F.coalesce("_next", F.lit(len(order) + 1)) == F.col("_rank") + 1)
        out = out.withColumn("gain", F.when(whole, F.col("gain")).otherwise(F.raise_error(F.lit("a view lacks a quality")).cast("double")))
    out = out.where("quality_to is not null" if not order else "quality_to is not null or gain is not null")
    return out.withColumnRenamed(rank, "quality_from").select(*view_keys, "quality_from", "quality_to", "gain")


def missing_qualities(facts: DataFrame, view_keys: Sequence[str], rank: str, order: Sequence[str]) -> DataFrame:
    """(view, quality) that are not there, for views with at least one of the qualities."""
    seen = facts.where(F.col(rank).isin(*order)).groupBy(*view_keys).agg(F.collect_set(rank).alias("_seen"))
    return seen.select(*view_keys, F.explode(F.array_except(F.array(*map(F.lit, order)), "_seen")).alias(rank))


def conflicting(facts: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys whose rows disagree; an insert is idempotent only where this is empty."""
    return facts.groupBy(*keys).agg(F.count_distinct(F.to_json(F.struct(*values))).alias("versions")).where("versions > 1")


def _measured(facts: DataFrame, probes: DataFrame, probe_id: str) -> DataFrame:
    """Squared scaled distance between every fact and the few probes, on a grid of 1e-9.

    Axes: azimuth (periodic), elevation, ln(scale), timestamp; each is divided by its range or a floor.
    Probes are a query's short list and are broadcast; facts are never shuffled for this.
    """
    spans = facts.agg(*((F.max(c) - F.min(c)).alias(f"_s{i}") for i, c in enumerate((F.pmod(F.col("azimuth"), F.lit(360.0)), F.col("elevation"), F.log("scale"), F.col("timestamp")))))
    floors = list(SPAN_FLOORS.values())
    q = probes.select(F.col(probe_id).alias("_probe"), *(F.col(c).alias(f"_{c}") for c in SPAN_FLOORS)).crossJoin(F.broadcast(spans))
    both = facts.crossJoin(F.broadcast(q))
    parts: list[Column] = [
        wrapped(F.pmod(F.col("azimuth"), F.lit(360.0)) - F.pmod(F.col("_azimuth"), F.lit(360.0))),
        F.col("elevation") - F.col("_elevation"),
        F.log("scale") - F.log("_scale"),
        F.col("timestamp") - F.col("_timestamp"),
    ]
    d2 = sum(((p / F.greatest(F.col(f"_s{i}"), F.lit(floors[i]))) * (p / F.greatest(F.col(f"_s{i}"), F.lit(floors[i]))) for i, p in enumerate(parts)), F.lit(0.0))
    return both.withColumn("_d2", F.floor(d2 * 1e9 + 0.5).cast("double") / 1e9)


def nearest(facts: DataFrame, probes: DataFrame, probe_id: str, fact_id: str, value: str) -> DataFrame:
    """The closest fact of each probe; of equal ones that of the least id. Partial aggregation, no sort."""
    best = _measured(facts, probes, probe_id).groupBy("_probe").agg(F.min(F.struct("_d2", fact_id, value)).alias("m"))
    return best.select(F.col("_probe").alias(probe_id), F.col(f"m.{fact_id}").alias(fact_id), F.col("m._d2").alias("distance2"), F.col(f"m.{value}").alias(value))


def inverse_distance(facts: DataFrame, probes: DataFrame, probe_id: str, fact_id: str, value: str, neighbours: int = 16) -> DataFrame:
    """Mean of the closest facts weighted by 1 / distance**2; an exact hit alone decides."""
    w = Window.partitionBy("_probe").orderBy("_d2", fact_id)
    near = _measured(facts, probes, probe_id).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= neighbours)
    hit = F.min("_d2") < 1e-24
    first = F.min(F.struct("_d2", fact_id, F.col(value).alias("v")))
    weighted = F.sum(F.col(value) / F.greatest(F.col("_d2"), F.lit(1e-300))) / F.sum(1 / F.greatest(F.col("_d2"), F.lit(1e-300)))
    return near.groupBy("_probe").agg(F.when(hit, first["v"]).otherwise(weighted).alias(value), F.count("*").cast("bigint").alias("sources")).withColumnRenamed("_probe", probe_id)


def _bracket(grid: DataFrame, probes: DataFrame, probe_id: str, axis: str, periodic: bool) -> DataFrame:
    """(probe, coordinate, weight) of the one or two grid values around each probe along an axis."""
    values = grid.select(F.col(axis).alias("v")).distinct()
    if periodic:
        values = values.select(F.explode(F.array(F.col("v") - 360, F.col("v"), F.col("v") + 360)).alias("v"))
    x = F.pmod(F.col(axis), F.lit(360.0)) if periodic else F.col(axis)
    p = probes.select(probe_id, x.alias("x"))
    near = p.crossJoin(F.broadcast(values)).groupBy(probe_id, "x").agg(
        F.max(F.when(F.col("v") <= F.col("x") + 1e-12, F.col("v"))).alias("lo"), F.min(F.when(F.col("v") >= F.col("x") - 1e-12, F.col("v"))).alias("hi")
    )
    near = near.select(probe_id, "x", F.coalesce("lo", "hi").alias("lo"), F.coalesce("hi", "lo").alias("hi"))
    share = F.when(F.col("hi") - F.col("lo") <= 1e-12, 0.0).otherwise((F.col("x") - F.col("lo")) / F.when(F.col("hi") != F.col("lo"), F.col("hi") - F.col("lo")))
    ends = near.withColumn("s", share).select(probe_id, F.explode(F.array(F.struct(F.col("lo").alias("v"), (1 - F.col("s")).alias("w")), F.struct(F.col("hi").alias("v"), F.col("s").alias("w")))).alias("e"))
    coordinate = F.pmod(F.col("e.v"), F.lit(360.0)) if periodic else F.col("e.v")
    return ends.where("e.w > 0").select(probe_id, coordinate.alias(axis), F.col("e.w").alias(f"_w_{axis}"))


def multilinear(grid: DataFrame, probes: DataFrame, probe_id: str, value: str) -> DataFrame:
    """Multilinear interpolation on a grid of azimuth (periodic), elevation, scale and timestamp.

    Outside its range an axis is clamped. corners tells how many grid rows took part; a probe
    whose weights of present corners fall short of one has a hole in its cell: complete is false.
    """
    corners = None
    for axis in SPAN_FLOORS:
        ends = _bracket(grid, probes, probe_id, axis, axis == "azimuth")
        corners = ends if corners is None else corners.join(ends, probe_id)
    weight = F.col("_w_azimuth") * F.col("_w_elevation") * F.col("_w_scale") * F.col("_w_timestamp")
    found = grid.join(F.broadcast(corners.withColumn("_w", weight)), list(SPAN_FLOORS))
    return found.groupBy(probe_id).agg((F.sum(F.col(value) * F.col("_w"))).alias(value), F.count("*").cast("bigint").alias("corners"), (F.sum("_w") > 1 - 1e-9).alias("complete"))


def document(facts: DataFrame, quality: str, version: int = 1) -> DataFrame:
    """The head of a profile document as JSON: version, samples and qualities."""
    one = facts.agg(F.count("*").alias("samples"), F.count_distinct(quality).alias("qualities"))
    return one.select(F.to_json(F.struct(F.lit(version).alias("version"), "samples", "qualities")).alias("document"))
