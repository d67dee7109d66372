"""Byte ledgers: accounting at several grains, operating points, frontiers and variant comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets in which a frontier is first sought on its own.
SALTS = 64


def accounting(ledger: DataFrame, owner: str, category: str, raw: str, coded: str) -> DataFrame:
    """Raw and coded bytes in all, per owner, and per owner and category; grain names the level."""
    out = ledger.groupingSets([[], [F.col(owner)], [F.col(owner), F.col(category)]], F.col(owner), F.col(category)).agg(
        F.sum(raw).alias("raw_bytes"), F.sum(coded).alias("coded_bytes"), F.grouping_id().alias("_g")
    )
    grain = F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, "owner").otherwise("category")
    return out.select(grain.alias("grain"), F.col(owner).alias("owner"), F.col(category).alias("category"), "raw_bytes", "coded_bytes")


def owner_shares(ledger: DataFrame, owner: str, is_value: Column, coded: str) -> DataFrame:
    """Per owner: coded bytes, its share of all, value bytes, and their share of the owner; shares are null for nothing."""
    per = ledger.groupBy(F.col(owner).alias("owner")).agg(F.sum(coded).alias("coded_bytes"), F.coalesce(F.sum(F.when(is_value, F.col(coded))), F.lit(0)).alias("value_bytes"))
    # One row per owner is left, so a window over all of them is small.
    everything = Window.partitionBy()
    return per.withColumns({"share": F.try_divide(F.col("coded_bytes"), F.sum("coded_bytes").over(everything)), "value_share": F.try_divide(F.col("value_bytes"), F.col("coded_bytes"))})


def breakdown(ledger: DataFrame, owner: str, attribute: str, raw: str, coded: str) -> DataFrame:
    """Every pair of owner and attribute, with zero bytes where it does not occur."""
    sums = ledger.groupBy(owner, attribute).agg(F.sum(raw).alias("raw_bytes"), F.sum(coded).alias("coded_bytes"))
    dims = sums.select(owner).distinct().crossJoin(sums.select(attribute).distinct())
    out = dims.join(sums, [owner, attribute], "left").fillna(0, ["raw_bytes", "coded_bytes"])
    return out.withColumn("ratio", F.coalesce(F.try_divide(F.col("raw_bytes"), F.col("coded_bytes")), F.lit(0.0)))


def _dominated(cost: Sequence[str]) -> Column:
    no_worse = [F.col(f"o.{c}") <= F.col(f"r.{c}") for c in cost]
    better = [F.col(f"o.{c}") < F.col(f"r.{c}") for c in cost]
    return _all(no_worse) & _any(better)


def _all(xs: list[Column]) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out & x
    return out


def _any(xs: list[Column]) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out | x
    return out


def frontier(variants: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Rows that no other row beats in one of two costs without losing in the other.

    A row is beaten if a smaller x has y no larger, or an equal x has a smaller y. That is a
    running minimum, taken per salt first, so that only local frontiers meet in one place.
    """

    def pass_(df: DataFrame, *part: str) -> DataFrame:
        lower = Window.partitionBy(*part).orderBy(x).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        strictly = Window.partitionBy(*part).orderBy(x, y).rowsBetween(Window.unboundedPreceding, -1)
        least = Window.partitionBy(*part, x)
        out = df.withColumn("_row", F.min(y).over(least))
        out = out.where(F.col(y) == F.col("_row"))  # within equal x only the least y can stay
        out = out.withColumn("_before", F.min(F.struct(y, x)).over(strictly)).withColumn("_low", F.min(y).over(lower))
        earlier = F.col("_before").isNull() | (F.col(f"_before.{y}") > F.col(y)) | (F.col(f"_before.{x}") == F.col(x)) & (F.col("_low") == F.col(y)) & (F.col(f"_before.{y}") == F.col(y))
        return out.where(earlier).drop("_row", "_before", "_low")

    local = pass_(variants.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS))), "_salt").drop("_salt")
    return pass_(local)


def frontier_many(variants: DataFrame, key: str, cost: Sequence[str]) -> DataFrame:
    """The same for any number of costs: anti-joins with the inequality, per salt and then over what is left."""
    salted = variants.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    local = salted.alias("r").join(salted.alias("o"), (F.col("r._salt") == F.col("o._salt")) & _dominated(cost), "left_anti").drop("_salt")
    return local.alias("r").join(local.alias("o"), _dominated(cost), "left_anti")


def operating_point(variants: DataFrame, eligible: Column, cost: str, ordinal: str) -> DataFrame:
    """The cheapest eligible row; of equal ones the first."""
    every = F.struct(*variants.columns)
    return variants.where(eligible).agg(F.min_by(every, F.struct(cost, ordinal)).alias("r")).where("r is not null").select("r.*")


def within_parent(variants: DataFrame, parent: DataFrame, slack: dict[str, float]) -> DataFrame:
    """Rows that exceed the one parent row by at most the given slack in each column."""
    own = parent.select(*(F.col(c).alias(f"_{c}") for c in slack))
    return variants.crossJoin(F.broadcast(own)).where(_all([F.col(c) <= F.col(f"_{c}") + v for c, v in slack.items()])).drop(*(f"_{c}" for c in slack))


def paired_by_suffix(left: DataFrame, right: DataFrame, key: str, suffix: str, value: str) -> DataFrame:
    """Joins variants with their counterparts named with a suffix."""
    other = right.select(F.regexp_replace(key, f"{suffix}$", "").alias(key), F.col(value).alias("counterpart"))
    return left.select(key, value).join(other, key)


def side_by_side(a: DataFrame, b: DataFrame, key: str, prefixes: tuple[str, str]) -> DataFrame:
    """Inner join of two result sets, their columns prefixed."""
    first = a.select(key, *(F.col(c).alias(f"{prefixes[0]}{c}") for c in a.columns if c != key))
    second = b.select(key, *(F.col(c).alias(f"{prefixes[1]}{c}") for c in b.columns if c != key))
    return first.join(second, key)


def sequential_cost(touches: DataFrame, variant: str, frame: str, file: str, size: str) -> DataFrame:
    """Per variant and frame: bytes of files that it is the first to touch, and their running sum."""
    first = touches.groupBy(variant, file).agg(F.min(F.struct(frame, size)).alias("f")).select(variant, F.col(f"f.{frame}").alias(frame), F.col(f"f.{size}").alias("_b"))
    new = first.groupBy(variant, frame).agg(F.sum("_b").alias("new_bytes"))
    frames = touches.select(variant, frame).distinct().join(new, [variant, frame], "left").fillna(0, ["new_bytes"])
    run = Window.partitionBy(variant).orderBy(frame).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return frames.withColumn("cumulative_bytes", F.sum("new_bytes").over(run))


def pooled(streams: DataFrame, digest: str, size: str) -> DataFrame:
    """Content-addressed pooling: logical bytes charge every stream, physical bytes each content once."""
    per = streams.groupBy(digest).agg(F.first(size).alias("_one"), F.sum(size).alias("_all"), F.count("*").alias("_n"))
    return per.agg(F.sum("_all").cast("bigint").alias("logical_bytes"), F.sum("_one").cast("bigint").alias("physical_bytes"), F.sum("_n").cast("bigint").alias("streams"), F.count("*").alias("contents"))
