"""Scene states as tables: joins by id and by row, subsets, changes, lifetimes and training row operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.columns import bits, logit, norm, sigmoid


def match_ids(target: DataFrame, parent: DataFrame, id_col: str, row_col: str) -> DataFrame:
    """Every target row with the parent's row of the same id, -1 if there is none."""
    own = parent.select(id_col, F.col(row_col).alias("parent_row"))
    out = target.select(id_col, row_col).join(own, id_col, "left")
    return out.select(id_col, row_col, F.coalesce("parent_row", F.lit(-1)).alias("parent_row"), F.col("parent_row").isNotNull().alias("common"))


def new_ids(target: DataFrame, parent: DataFrame, id_col: str) -> DataFrame:
    return target.join(parent.select(id_col), id_col, "left_anti").select(id_col)


def deleted_ids(target: DataFrame, parent: DataFrame, id_col: str) -> DataFrame:
    """Distinct ids of the parent that the target lacks."""
    return parent.select(id_col).distinct().join(target.select(id_col), id_col, "left_anti")


def row_prefix(a: DataFrame, b: DataFrame, row_col: str, value: str, n: int) -> DataFrame:
    """Rows 0..n-1 of two states side by side."""
    left = a.where(F.col(row_col) < n).select(row_col, F.col(value).alias("a"))
    return left.join(b.where(F.col(row_col) < n).select(row_col, F.col(value).alias("b")), row_col)


def subset(state: DataFrame, wanted: DataFrame, id_col: str) -> DataFrame:
    """Rows of the wanted ids in the order of wanted.pos; raises on repeated or missing ids."""
    bad = wanted.groupBy(id_col).count().where("count > 1").select(id_col).union(wanted.join(state, id_col, "left_anti").select(id_col)).limit(8).collect()
    if bad:
        raise ValueError(f"repeated or missing ids: {[r[0] for r in bad]}")
    return state.join(wanted, id_col)


def top_ids(state: DataFrame, score: str, id_col: str, k: int) -> DataFrame:
    """The k rows of the highest score, of equal ones those of lower id."""
    return state.orderBy(F.desc(score), F.asc(id_col)).limit(k).select(id_col)


def changes(pairs: DataFrame, attributes: dict[str, tuple[list[Column], list[Column], float]]) -> DataFrame:
    """Per attribute: rows, rows that differ in value, share that differ, share beyond a tolerance, mean absolute and
    root mean square difference of components, and mean, median, p95 and maximum of the row differences' lengths."""
    rows = []
    for name, (a, b, tolerance) in attributes.items():
        d = [y - x for x, y in zip(a, b)]
        rows.append(F.struct(F.lit(name).alias("attribute"), F.lit(tolerance).alias("tolerance"), F.array(*d).alias("d"), norm(d).alias("length")))
    long = pairs.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    changed = F.exists("d", lambda x: x != 0)
    absolute = F.aggregate("d", F.lit(0.0), lambda s, x: s + F.abs(x)) / F.size("d")
    square = F.aggregate("d", F.lit(0.0), lambda s, x: s + x * x) / F.size("d")
    return long.groupBy("attribute").agg(
        F.count("*").alias("rows"),
        F.sum(changed.cast("bigint")).alias("changed"),
        F.avg(changed.cast("double")).alias("changed_share"),
        F.avg((F.col("length") > F.col("tolerance")).cast("double")).alias("beyond_share"),
        F.avg(absolute).alias("mae"),
        F.sqrt(F.avg(square)).alias("rms"),
        F.avg("length").alias("mean"),
        F.median("length").alias("median"),
        F.percentile("length", 0.95).alias("p95"),
        F.max("length").alias("max"),
    )


def static_rows(sequence: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per row: whether its bits are the same in all frames."""
    return sequence.groupBy(*keys).agg((F.min(bits(F.col(value))) == F.max(bits(F.col(value)))).alias("static"), F.count("*").alias("frames"))


def lifetimes(sequence: DataFrame, owner: Sequence[str], row: str, value: str) -> DataFrame:
    """Per owner: rows, static rows, their share, and whether the whole group is static."""
    per = static_rows(sequence, [*owner, row], value)
    return per.groupBy(*owner).agg(F.count("*").alias("rows"), F.sum(F.col("static").cast("bigint")).alias("static_rows"), F.avg(F.col("static").cast("double")).alias("static_share"), F.every("static").alias("whole_static"))


def transitions(sequence: DataFrame, owner: Sequence[str], row: str, frame: str, value: str) -> DataFrame:
    """Per owner and frame after the first: rows, rows changed in bits since the frame before."""
    w = Window.partitionBy(*owner, row).orderBy(frame)
    before = F.lag(bits(F.col(value))).over(w)
    out = sequence.withColumn("_b", before).where("_b is not null")
    return out.groupBy(*owner, frame).agg(F.count("*").alias("rows"), F.sum((F.col("_b") != bits(F.col(value))).cast("bigint")).alias("changed"))


def residual_stats(sequence: DataFrame, owner: Sequence[str], row: str, frame: str, value: str) -> DataFrame:
    """Statistics of the size of frame-to-frame residuals, with the share of zero ones."""
    w = Window.partitionBy(*owner, row).orderBy(frame)
    out = sequence.withColumn("_m", F.abs(F.col(value) - F.lag(value).over(w))).where("_m is not null")
    return out.groupBy(*owner).agg(
        F.count("*").alias("residuals"), F.avg("_m").alias("mean"), F.median("_m").alias("median"), F.percentile("_m", 0.95).alias("p95"), F.max("_m").alias("max"), F.avg(F.when(F.col("_m") == 0, 1.0).otherwise(0.0)).alias("zero_share")
    )


def append_rows(base: DataFrame, more: DataFrame, row_col: str) -> DataFrame:
    """Rows of base, then those of more, renumbered behind them."""
    size = base.agg((F.coalesce(F.max(row_col), F.lit(-1)) + 1).alias("_n"))
    return base.unionByName(more.crossJoin(F.broadcast(size)).withColumn(row_col, F.col(row_col) + F.col("_n")).drop("_n"))


def complement(rows: DataFrame, chosen: DataFrame, row_col: str) -> DataFrame:
    return rows.join(chosen.select(row_col), row_col, "left_anti")


def invalid_rows(state: DataFrame, vectors: dict[str, int], rotation: str, id_col: str) -> DataFrame:
    """(id, rule) of rows with a wrong width, a number that is not finite, a zero quaternion or a repeated id."""
    inf = F.lit(float("inf"))
    rules = [F.when(F.size(c) != n, F.lit(f"{c}_width")) for c, n in vectors.items()]
    rules += [F.when(F.exists(c, lambda x: F.isnan(x) | (F.abs(x) == inf) | x.isNull()), F.lit(f"{c}_finite")) for c in vectors]
    rules.append(F.when(F.aggregate(rotation, F.lit(0.0), lambda s, x: s + x.cast("double") * x) == 0, F.lit("zero_rotation")))
    per_row = state.select(id_col, F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("rule"))
    repeated = state.groupBy(id_col).count().where("count > 1").select(id_col, F.lit("repeated_id").alias("rule"))
    return per_row.union(repeated)


def prune(state: DataFrame, masked: Column, row_col: str, protected: int) -> DataFrame:
    """Drops masked rows, except the first `protected` ones."""
    return state.where((F.col(row_col) < protected) | ~masked)


def clone(state: DataFrame, selected: Column, row_col: str) -> DataFrame:
    """Appends copies of selected rows in row order."""
    order = Window.orderBy(row_col)
    copies = state.where(selected).withColumn(row_col, (F.row_number().over(order) - 1).cast("bigint"))
    return append_rows(state, copies, row_col)


def split(state: DataFrame, selected: Column, row_col: str, log_scale: str, n: int = 2) -> DataFrame:
    """Replaces each selected row by n rows whose scales are divided by 0.8 n; part numbers them from 1."""
    parts = state.where(selected).withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(n))))
    shrunk = parts.withColumn(log_scale, F.transform(log_scale, lambda x: x - F.log(F.lit(0.8 * n))))
    return state.where(~selected).withColumn("part", F.lit(0)).unionByName(shrunk.withColumn("part", F.col("part").cast("int")))


def reset_opacity(state: DataFrame, opacity: str, row_col: str, protected: int, most: float = 0.01) -> DataFrame:
    """Lowers opacities (logits) to at most that of `most`; the first rows keep theirs."""
    capped = logit(F.least(sigmoid(F.col(opacity)), F.lit(most)))
    return state.withColumn(opacity, F.when(F.col(row_col) < protected, F.col(opacity)).otherwise(capped))


def accumulate(observations: DataFrame, id_col: str, radius: str, gradient: str) -> DataFrame:
    """Largest radius, gradient sum and count of visible observations per row."""
    return observations.where(F.col(radius) > 0).groupBy(id_col).agg(F.max(radius).alias("max_radius"), F.sum(gradient).alias("gradient"), F.count("*").alias("views"))
