"""Incremental work: which tasks must run again, merged settings, and folds over an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(*parts: Column) -> Column:
    """A digest of a task's settings and input hashes."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts)))), 256)


def pending(tasks: DataFrame, journal: DataFrame) -> DataFrame:
    """Tasks whose (key, fingerprint) the journal has no completed entry for."""
    return tasks.join(journal.where("status = 'completed'").select("key", "fingerprint"), ["key", "fingerprint"], "left_anti")


def changed_without_permission(tasks: DataFrame, journal: DataFrame) -> DataFrame:
    """Tasks done before under another fingerprint: they may only run again if overwriting is allowed."""
    old = journal.where("status = 'completed'").select("key", F.col("fingerprint").alias("old"))
    return tasks.join(old, "key").where("old <> fingerprint")


def counters(tasks: DataFrame, journal: DataFrame) -> DataFrame:
    """How many tasks run and how many are skipped."""
    done = journal.where("status = 'completed'").select("key", "fingerprint", F.lit(True).alias("done")).distinct()
    return tasks.join(done, ["key", "fingerprint"], "left").agg(F.count_if(F.col("done").isNull()).alias("executed"), F.count_if(F.col("done").isNotNull()).alias("skipped"))


def later_wins(layers: Sequence[DataFrame], key: str) -> DataFrame:
    """Merge of settings tables, a later one's rows in place of an earlier one's."""
    every = None
    for rank, layer in enumerate(layers):
        own = layer.withColumn("_rank", F.lit(rank))
        every = own if every is None else every.unionByName(own)
    columns = [c for c in every.columns if c != "_rank"]
    return every.groupBy(key).agg(F.max_by(F.struct(*columns), "_rank").alias("_r")).select("_r.*")


def moving_average(rows: DataFrame, keys: Sequence[str], order: str, value: str, share: float = 0.4) -> DataFrame:
    """Exponential moving average in order, from 0: share * x + (1 - share) * average so far; per sequence."""
    xs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))))
    return rows.groupBy(*keys).agg(F.aggregate(xs, F.lit(0.0), lambda a, x: share * x["v"] + (1 - share) * a).alias("average"))


def stride_sample(rows: DataFrame, order: str, wanted: int) -> DataFrame:
    """Rows at positions floor(i * n / wanted): an even subsample of an ordered list; both numbers are the feature."""
    spark = rows.sparkSession
    placed = rows.withColumn("_p", F.row_number().over(Window.orderBy(order)) - 1)
    total = rows.agg(F.count("*").alias("_n"))
    picks = spark.range(wanted).crossJoin(F.broadcast(total)).select(F.floor(F.col("id") * F.col("_n") / wanted).cast("int").alias("_p")).distinct()
    return placed.join(F.broadcast(picks), "_p", "left_semi").drop("_p")


def planned(tasks: DataFrame, journal: DataFrame, key: str, digest: str) -> DataFrame:
    """What a run would do with each task: skip (done with this hash), again (done with another one) or run."""
    done = journal.select(key, F.col(digest).alias("_done"))
    action = F.when(F.col("_done").isNull(), "run").when(F.col("_done") == F.col(digest), "skip").otherwise("again")
    return tasks.join(done, key, "left").select(key, action.alias("action"))


def stage_status(tasks: DataFrame, stage: str, state: str, completed: str, failed: str) -> DataFrame:
    """Per stage its tasks and their common status: completed (all), failed (any) or running."""
    out = tasks.groupBy(stage).agg(F.count("*").alias("tasks"), F.count_if(F.col(state) == completed).alias("completed"), F.count_if(F.col(state) == failed).alias("_failed"))
    return out.withColumn("status", F.when(F.col("tasks") == F.col("completed"), "completed").when(F.col("_failed") > 0, "failed").otherwise("running")).drop("_failed")


def training_report(cameras: DataFrame, ordinal: str, split: str, metrics: Sequence[str], every: int) -> DataFrame:
    """Means of the metrics over every n-th camera of a split."""
    own = cameras.where(F.col(ordinal) % every == 0).groupBy(split)
    return own.agg(F.count("*").alias("cameras"), *(F.avg(m).alias(m) for m in metrics))


def with_commands(tasks: DataFrame, commands: DataFrame, keys: Sequence[str], command: str, default: str) -> DataFrame:
    """Each task with its first recorded command, or the default."""
    first = commands.groupBy(*keys).agg(F.min(command).alias(command))
    return tasks.join(first, list(keys), "left").withColumn(command, F.coalesce(command, F.lit(default)))


def ordered(rows: DataFrame, within: Sequence[str], by: Sequence, place: str) -> DataFrame:
    """The place of each row by several keys; without `within`, rows have to be a short list."""
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*within).orderBy(*by)))
