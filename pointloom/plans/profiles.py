"""Quality-profile queries: events stand for profile facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.columns import snap
from pointloom.operators import profile
from pointloom.plans.named import named
from pointloom.session import table


def _snapped(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: snap(F.col(c)) for c in columns})


SNAP = "floor(({}) * 1e6 + 0.5) / 1e6"


def s(x: str, name: str) -> str:
    """The snapped expression in DuckDB SQL."""
    return f"{SNAP.format(x)} as {name}"


@named(
    "profile_summary",
    f"""select user_id % 5 as object, event_type as quality, count(*)::bigint as sample_count,
    {s("avg(value)", "mean")}, {s("median(value)", "median")}, {s("quantile_cont(value, 0.95)", "p95")}, {s("max(value)", "worst")}
    from events group by 1, 2""",
)
def profile_summary(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "events").select((F.col("user_id") % 5).alias("object"), F.col("event_type").alias("quality"), "value")
    return _snapped(profile.summarize(facts, ["object", "quality"], "value"), "mean", "median", "p95", "worst")


@named(
    "profile_weighted_mean",
    f"""select event_type as quality, {s("sum(case when user_id % 3 > 0 then value * (user_id % 3) end) / sum(user_id % 3)", "weighted_mean")}
    from events group by 1""",
)
def profile_weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "events").select(F.col("event_type").alias("quality"), "value", (F.col("user_id") % 3).alias("weight"))
    return _snapped(profile.summarize(facts, ["quality"], "value", "weight").select("quality", "weighted_mean"), "weighted_mean")


@named(
    "profile_null_poisoned",
    f"""select user_id as object, count(*)::bigint as sample_count,
    case when count(*) = count(case when event_id % 97 <> 0 then value end) then {SNAP.format("avg(value)")} end as mean
    from events group by 1""",
)
def profile_null_poisoned(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "events").select(F.col("user_id").alias("object"), F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("value"))
    return _snapped(profile.summarize(facts, ["object"], "value").select("object", "sample_count", "mean"), "mean")


@named(
    "psnr_summary",
    f"""select event_type as quality, {s("min(-10 * log10((event_id % 7 + 1) / 100.0))", "worst")}, {s("avg(-10 * log10((event_id % 7 + 1) / 100.0))", "mean")}
    from events group by 1""",
)
def psnr_summary(spark: SparkSession, sf: str) -> DataFrame:
    from pointloom.functions.columns import psnr

    facts = table(spark, sf, "events").select(F.col("event_type").alias("quality"), psnr((F.col("event_id") % 7 + 1) / 100.0).alias("psnr"))
    return _snapped(profile.summarize(facts, ["quality"], "psnr", higher_is_better=True).select("quality", "worst", "mean"), "worst", "mean")


@named(
    "transition_gains",
    f"""with f as (select l_suppkey as view, l_returnflag as quality, avg(l_discount) as mse from lineitem group by 1, 2),
    g as (select view, quality as quality_from, lead(quality) over w as quality_to, mse - lead(mse) over w as gain from f window w as (partition by view order by quality))
    select view, quality_from, quality_to, {s("gain", "gain")} from g where quality_to is not null""",
)
def transition_gains(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("view"), F.col("l_returnflag").alias("quality")).agg(F.avg("l_discount").alias("mse"))
    return _snapped(profile.gains(facts, ["view"], "quality", "mse", ["A", "N", "R"]), "gain")


@named(
    "profile_conflicts",
    """select user_id, event_type, count(distinct props) as versions from events group by 1, 2 having count(distinct props) > 1""",
)
def profile_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.conflicting(table(spark, sf, "events"), ["user_id", "event_type"], ["props"])


@named(
    "profile_point_lookup",
    """select event_id, value from events where event_type = (select min(event_type) from events) and user_id % 7 = 3 and event_id % 4 = 1""",
)
def profile_point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    first = events.agg(F.min("event_type").alias("event_type"))
    return events.join(F.broadcast(first), "event_type", "left_semi").where("user_id % 7 = 3 and event_id % 4 = 1").select("event_id", "value")


def _views(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    facts = table(spark, sf, "events").selectExpr(
        "event_id", "value", "cast(event_id * 37 % 360 as double) as azimuth", "cast(event_id * 17 % 90 - 45 as double) as elevation", "cast(1 + user_id % 4 as double) as scale", "event_id % 100 / 10D as timestamp"
    )
    probes = table(spark, sf, "nation").selectExpr(
        "n_nationkey as probe", "n_nationkey * 29.5D - 180 as azimuth", "n_nationkey * 3D - 40.25 as elevation", "1 + n_nationkey % 5 / 2D as scale", "n_nationkey * 0.45D as timestamp"
    )
    return facts, probes


_VIEWS = """f as (select event_id, value, (event_id * 37 % 360)::double as az, (event_id * 17 % 90 - 45)::double as el, (1 + user_id % 4)::double as sc, (event_id % 100) / 10.0::double as t from events),
p as (select n_nationkey as probe, n_nationkey * 29.5::double - 180 as az, n_nationkey * 3::double - 40.25 as el, 1 + (n_nationkey % 5) / 2.0::double as sc, n_nationkey * 0.45::double as t from nation),
sp as (select greatest(max(az) - min(az), 180) as s0, greatest(max(el) - min(el), 45) as s1, greatest(max(ln(sc)) - min(ln(sc)), 1) as s2, greatest(max(t) - min(t), 1e-6) as s3 from f),
d as (select probe, event_id, value, floor(((
  pow(((((((f.az - ((p.az % 360 + 360) % 360)) + 180) % 360) + 360) % 360) - 180) / s0, 2)
  + pow((f.el - p.el) / s1, 2) + pow((ln(f.sc) - ln(p.sc)) / s2, 2) + pow((f.t - p.t) / s3, 2))) * 1e9 + 0.5) / 1e9 as d2 from f, p, sp),
r as (select *, row_number() over (partition by probe order by d2, event_id) as n from d)"""


@named("profile_nearest", f"with {_VIEWS} select probe, event_id, {s('d2', 'distance2')}, value from r where n = 1")
def profile_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return _snapped(profile.nearest(*_views(spark, sf), "probe", "event_id", "value"), "distance2")


@named(
    "profile_idw",
    f"""with {_VIEWS} select probe, {s("case when min(d2) < 1e-24 then min(case when n = 1 then value end) else sum(value / greatest(d2, 1e-300)) / sum(1 / greatest(d2, 1e-300)) end", "value")},
    count(*)::bigint as sources from r where n <= 16 group by 1""",
)
def profile_idw(spark: SparkSession, sf: str) -> DataFrame:
    return _snapped(profile.inverse_distance(*_views(spark, sf), "probe", "event_id", "value"), "value")


@named(
    "profile_multilinear",
    f"""with g as (select (event_id % 4 * 90)::double as az, (event_id // 4 % 2 * 60 - 30)::double as el, (1 + event_id // 8 % 2)::double as sc, (event_id // 16 % 2)::double as t, avg(value) as value from events group by 1, 2, 3, 4),
    p as (select n_nationkey as probe, ((n_nationkey * 29.5::double - 180) % 360 + 360) % 360 as az, greatest(-30, least(30, n_nationkey * 3::double - 40.25)) as el,
      greatest(1, least(2, 0.75 + n_nationkey % 5 / 3.0::double)) as sc, greatest(0, least(1, n_nationkey * 0.05::double - 0.1)) as t from nation),
    c as (select probe, ((floor(az / 90) + a.i) % 4) * 90 as az, case when a.i = 0 then 1 - (az / 90 - floor(az / 90)) else az / 90 - floor(az / 90) end as wa,
      b.i * 60 - 30 as el, case when b.i = 0 then 1 - (el + 30) / 60 else (el + 30) / 60 end as we,
      1 + s.i as sc, case when s.i = 0 then 2 - sc else sc - 1 end as ws, u.i as t, case when u.i = 0 then 1 - t else t end as wt
      from p, range(2) a(i), range(2) b(i), range(2) s(i), range(2) u(i))
    select probe, {s("sum(value * wa * we * ws * wt)", "value")}, count(*)::bigint as corners, true as complete
    from c join g using (az, el, sc, t) where wa > 0 and we > 0 and ws > 0 and wt > 0 group by 1""",
)
def profile_multilinear(spark: SparkSession, sf: str) -> DataFrame:
    grid = (
        table(spark, sf, "events")
        .selectExpr("cast(event_id % 4 * 90 as double) as azimuth", "cast(event_id div 4 % 2 * 60 - 30 as double) as elevation", "cast(1 + event_id div 8 % 2 as double) as scale", "cast(event_id div 16 % 2 as double) as timestamp", "value")
        .groupBy("azimuth", "elevation", "scale", "timestamp")
        .agg(F.avg("value").alias("value"))
    )
    probes = table(spark, sf, "nation").selectExpr(
        "n_nationkey as probe", "n_nationkey * 29.5D - 180 as azimuth", "n_nationkey * 3D - 40.25 as elevation", "0.75D + n_nationkey % 5 / 3D as scale", "n_nationkey * 0.05D - 0.1D as timestamp"
    )
    return _snapped(profile.multilinear(grid, probes, "probe", "value"), "value")


@named(
    "distortion_composite",
    f"""select event_type as quality, {s("avg(0.7 * value / 10 + 0.3 * (event_id % 11) / 5)", "distortion")} from events group by 1""",
)
def distortion_composite(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "events").select(F.col("event_type").alias("quality"), (0.7 * F.col("value") / 10 + 0.3 * (F.col("event_id") % 11) / 5).alias("d"))
    return facts.groupBy("quality").agg(snap(F.avg("d")).alias("distortion"))
