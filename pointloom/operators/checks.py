"""Rules of packages, lineages and reports, as queries that return what breaks them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def package_violations(index: DataFrame, keys: Sequence[str], position: str, size: str, offset: str, gof: str, length: int) -> DataFrame:
    """(keys, position, rule) of index rows that do not agree with what their positions and sizes give.

    Rules: size (not above zero), repeated (position twice), offset (not the bytes before it in its group), group (not its position's).
    """
    w = Window.partitionBy(*keys, gof).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    own = index.withColumn("_before", F.coalesce(F.sum(size).over(w), F.lit(0))).withColumn("_times", F.count("*").over(Window.partitionBy(*keys, position)))
    rules = {"size": F.col(size) <= 0, "repeated": F.col("_times") > 1, "offset": F.col(offset) != F.col("_before"), "group": F.col(gof) != F.floor(F.col(position) / length)}
    broken = F.filter(F.array(*(F.when(broken, F.lit(rule)) for rule, broken in rules.items())), lambda x: x.isNotNull())
    return own.select(*keys, position, F.explode(broken).alias("rule"))


def representation_violations(parts: DataFrame, totals: DataFrame, keys: Sequence[str], size: str, total: str) -> DataFrame:
    """Keys whose parts' bytes are not what the representation says, or that one side lacks."""
    sums = parts.groupBy(*keys).agg(F.sum(size).alias("_sum"))
    return sums.join(totals, list(keys), "full_outer").where(~F.col("_sum").eqNullSafe(F.col(total))).select(*keys, F.coalesce("_sum", F.lit(0)).alias("found"), F.coalesce(total, F.lit(0)).alias("stated"))


def lineage_mismatches(parent: DataFrame, child: DataFrame, row_col: str, attributes: Sequence[str]) -> DataFrame:
    """Per attribute: rows of the parent that the child lacks or holds with other bits; all zero if the parent is a prefix of the child."""
    both = parent.select(row_col, *(F.col(a).alias(f"_{a}") for a in attributes)).join(child.select(row_col, F.lit(True).alias("_there"), *attributes), row_col, "left")
    counts = [F.sum((F.col("_there").isNull() | ~F.col(a).eqNullSafe(F.col(f"_{a}"))).cast("bigint")).alias(a) for a in attributes]
    one = both.agg(*counts)
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.coalesce(a, F.lit(0)).alias("mismatches")) for a in attributes))).alias("x")).select("x.*")


def uneven(rows: DataFrame, keys: Sequence[str], expected: int) -> DataFrame:
    """Keys with another number of rows than a report promises."""
    return rows.groupBy(*keys).agg(F.count("*").alias("found")).where(F.col("found") != expected)


def temporal_rejections(payloads: DataFrame, id_col: str, frame: str, parent: str) -> DataFrame:
    """Payloads that depend on another frame, which a packager without prediction rejects."""
    own = payloads.select(F.col(id_col).alias(parent), F.col(frame).alias("_frame"))
    return payloads.join(own, parent).where(F.col("_frame") != F.col(frame)).select(id_col, parent)


def decoded_index(kind: Column, rows: Column, ids: Column, mask: Column) -> Column:
    """Row numbers of a coded selection: dense (all), ids, complement (all but ids) or mask (bits of bytes, lowest first).

    Ids that do not rise strictly raise.
    """
    every = F.when(rows > 0, F.sequence(F.lit(0).cast("bigint"), rows - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
    rising = F.array_sort(F.array_distinct(ids))
    checked = F.when(rising == ids, ids).otherwise(F.raise_error(F.lit("ids do not rise strictly")).cast("array<bigint>"))
    byte = lambda i: F.element_at(mask, (F.floor(i / 8) + 1).cast("int"))
    set_bits = F.filter(every, lambda i: byte(i).bitwiseAND(F.pow(F.lit(2), i % 8).cast("int")) > 0)
    return F.when(kind == "dense", every).when(kind == "ids", checked).when(kind == "complement", F.array_except(every, checked)).when(kind == "mask", set_bits)
