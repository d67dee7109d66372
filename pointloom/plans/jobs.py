"""Queries on incremental work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.columns import safe_path, snap
from pointloom.operators import jobs
from pointloom.plans.named import named
from pointloom.plans.profiles import s
from pointloom.session import table


def _tasks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus", "o_custkey")
    tasks = o.select("key", jobs.fingerprint(F.col("o_orderstatus"), F.col("o_custkey")).alias("fingerprint"))
    journal = o.where("key % 3 <> 0").select(
        "key", jobs.fingerprint(F.when(F.col("key") % 7 == 0, "old").otherwise(F.col("o_orderstatus")), F.col("o_custkey")).alias("fingerprint"), F.when(F.col("key") % 5 == 0, "failed").otherwise("completed").alias("status")
    )
    return tasks, journal


@named("incremental_skip", "select o_orderkey as key from orders where o_orderkey % 3 = 0 or o_orderkey % 5 = 0 or o_orderkey % 7 = 0")
def incremental_skip(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.pending(*_tasks(spark, sf)).select("key")


@named("incremental_refused", "select o_orderkey as key from orders where o_orderkey % 3 <> 0 and o_orderkey % 5 <> 0 and o_orderkey % 7 = 0")
def incremental_refused(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.changed_without_permission(*_tasks(spark, sf)).select("key")


@named("incremental_counters", "select count(*) filter (o_orderkey % 3 = 0 or o_orderkey % 5 = 0 or o_orderkey % 7 = 0) as executed, count(*) filter (not (o_orderkey % 3 = 0 or o_orderkey % 5 = 0 or o_orderkey % 7 = 0)) as skipped from orders")
def incremental_counters(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.counters(*_tasks(spark, sf))


@named("later_wins", "select c_custkey as key, case when c_custkey % 4 = 0 then 'user' else c_mktsegment end as value from customer")
def later_wins(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    return jobs.later_wins([c, c.where("key % 4 = 0").withColumn("value", F.lit("user"))], "key")


@named(
    "ema_fold",
    f"""with recursive o as (select user_id, value, row_number() over (partition by user_id order by event_id) as n, count(*) over (partition by user_id) as c from events),
    r as (select user_id, n, c, 0.4 * value as a from o where n = 1 union all select o.user_id, o.n, o.c, 0.4 * o.value + 0.6 * r.a from r join o on o.user_id = r.user_id and o.n = r.n + 1)
    select user_id, {s("a", "average")} from r where n = c""",
)
def ema_fold(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.moving_average(table(spark, sf, "events"), ["user_id"], "event_id", "value")
    return out.withColumn("average", snap(F.col("average")))


@named("stride_sample", "with p as (select c_custkey, row_number() over (order by c_custkey) - 1 as p, count(*) over () as n from customer) select c_custkey from p where p in (select floor(i * n / 40)::bigint from range(40) r(i))")
def stride_sample(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.stride_sample(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 40)


@named(
    "safe_paths",
    r"""with p as (select page_id, case page_id % 6 when 0 then '/absolute.bin' when 1 then '../escape.bin' when 2 then 'folder/../../escape.bin' when 3 then 'a\b' when 4 then '.' else 'folder/a..b.bin' end as path from pages)
    select page_id, path, page_id % 6 = 5 as safe from p""",
)
def safe_paths(spark: SparkSession, sf: str) -> DataFrame:
    cases = ["/absolute.bin", "../escape.bin", "folder/../../escape.bin", "a\\b", ".", "folder/a..b.bin"]
    path = F.element_at(F.array(*map(F.lit, cases)), (F.col("page_id") % 6 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", path.alias("path")).withColumn("safe", safe_path(F.col("path")))
