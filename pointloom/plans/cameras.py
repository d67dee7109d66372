"""Camera, footprint and selection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import cameras as K
from pointloom.functions.columns import norm, rotation_matrix, sigmoid, snap, unit, vector
from pointloom.plans.named import named
from pointloom.plans.profiles import s
from pointloom.session import table

_MATRIX = [[0.0, -1.0, 0.0, 2.0], [1.0, 0.0, 0.0, -1.0], [0.0, 0.0, 1.0, 3.0], [0.1, 0.0, 0.0, 1.0]]


@named("projection_matrix", f"select p_partkey, {s('1 / tan(radians(20 + p_size)::double / 2)', 'p00')}, {s('100 / 99.99::double', 'p22')}, {s('-100 * 0.01 / 99.99::double', 'p23')} from part")
def projection_matrix(spark: SparkSession, sf: str) -> DataFrame:
    fov = F.radians((20 + F.col("p_size")).cast("double"))
    m = K.projection(0.01, 100.0, fov, fov)
    return table(spark, sf, "part").select("p_partkey", *(snap(m[k]).alias(k) for k in ("p00", "p22", "p23")))


@named("transform_points", f"""with e as (select vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings) select vec_id, {s("(2 - y) / (1 + 0.1 * x + 1e-7)", "x")}, {s("(x - 1) / (1 + 0.1 * x + 1e-7)", "y")}, {s("(z + 3) / (1 + 0.1 * x + 1e-7)", "z")} from e""")
def transform_points(spark: SparkSession, sf: str) -> DataFrame:
    p = K.transformed(vector(F.col("embedding"), 3), _MATRIX)
    return table(spark, sf, "embeddings").select("vec_id", *(snap(x).alias(n) for x, n in zip(p, "xyz")))


@named(
    "normalise_cloud",
    f"""with e as (select vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings), c as (select (min(x)+max(x))/2 as a, (min(y)+max(y))/2 as b, (min(z)+max(z))/2 as c from e)
    select vec_id, {s("(x - a) / 4.0", "x")}, {s("-(z - c.c) / 4.0", "y")}, {s("(y - b) / 4.0 - 0.1", "z")} from e, c""",
)
def normalise_cloud(spark: SparkSession, sf: str) -> DataFrame:
    from pointloom.operators.scenes import box_centre

    v = vector(F.col("embedding"), 3)
    points = table(spark, sf, "embeddings").select("vec_id", *(x.alias(n) for x, n in zip(v, "xyz")))
    both = points.crossJoin(F.broadcast(box_centre(points, ["x", "y", "z"])))
    out = K.normalised_cloud([F.col(n) for n in "xyz"], [F.col(f"c_{n}") for n in "xyz"], 4.0)
    return both.select("vec_id", *(snap(x + 1e-12).alias(n) for x, n in zip(out, "xyz")))


@named(
    "splat_footprint",
    f"""with c as (select vec_id, abs(embedding[1]::double) + 1 as a, embedding[2]::double / 2 as b, abs(embedding[3]::double) + 1 as c, 1 / (1 + exp(-embedding[11]::double)) as o from embeddings)
    select vec_id, {s("3 * sqrt((a + c) / 2 + 0.3 + sqrt(pow(a - c, 2) / 4 + b * b))", "radius")},
    {s("least(0.99, o * exp(-0.5 * ((c + 0.3) * 0.25 - 2 * b * 0.5 * -0.25 + (a + 0.3) * 0.0625) / ((a + 0.3) * (c + 0.3) - b * b)))", "alpha")} from c""",
)
def splat_footprint(spark: SparkSession, sf: str) -> DataFrame:
    x = vector(F.col("embedding"), 11)
    rows = table(spark, sf, "embeddings").select("vec_id", (F.abs(x[0]) + 1).alias("a"), (x[1] / 2).alias("b"), (F.abs(x[2]) + 1).alias("c"), sigmoid(x[10]).alias("o"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return rows.select("vec_id", snap(K.splat_radius(a, b, c)).alias("radius"), snap(K.splat_alpha(F.lit(0.5), F.lit(-0.25), a, b, c, F.col("o"))).alias("alpha"))


@named("learning_rate", f"""select event_id, {s("1000 * (0.01 + 0.99 * sin(pi() / 2 * least(1, event_id / 500.0::double))) * exp(ln(0.016) * (1 - least(1, event_id / 3000.0::double)) + ln(0.00016) * least(1, event_id / 3000.0::double))", "rate")} from events""")
def learning_rate(spark: SparkSession, sf: str) -> DataFrame:
    rate = K.learning_rate(F.col("event_id"), 0.016, 0.00016, 3000, 500, 0.01)
    return table(spark, sf, "events").select("event_id", snap(1000 * rate).alias("rate"))


@named("target_width", "select p_partkey, round_even(p_size * 97 / 4.0::double, 0)::bigint as quarter, least(p_size * 97, 1600)::bigint as capped, 640::bigint as fixed from part")
def target_width(spark: SparkSession, sf: str) -> DataFrame:
    w = F.col("p_size") * 97
    return table(spark, sf, "part").select("p_partkey", K.target_width(w, 4).alias("quarter"), K.target_width(w, -1).alias("capped"), K.target_width(w, 640).alias("fixed"))


@named("clear_black", "select event_id, (case when event_id % 2 = 0 and event_id % 3 = 0 and event_id % 5 = 0 then 0 else 255 end)::int as alpha from events")
def clear_black(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", K.clear_black(e % 2, e % 3, e % 5, F.lit(255)).alias("alpha"))


@named(
    "threshold_mask",
    """with r as (select a.vec_id, a.embedding::double[] as a, b.embedding::double[] as b from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
    select vec_id, sqrt(pow(b[1]-a[1],2) + pow(b[2]-a[2],2) + pow(b[3]-a[3],2)) > 0.3 as xyz, abs(1/(1+exp(-b[11])) - 1/(1+exp(-a[11]))) > 0.05 as opacity, b[12] <> a[12] as sh from r""",
)
def threshold_mask(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    a, b = vector(F.col("embedding"), 12), vector(F.col("next"), 12)
    moved = norm([y - x for x, y in zip(a[:3], b[:3])]) > 0.3
    return both.select("vec_id", moved.alias("xyz"), (F.abs(sigmoid(b[10]) - sigmoid(a[10])) > 0.05).alias("opacity"), (b[11] != a[11]).alias("sh"))


@named(
    "scene_results",
    f"""select l_returnflag as scene, l_linestatus as split, l_linenumber as method, count(*) as views, {s("avg(l_discount)", "ssim")}, {s("avg(l_tax)", "lpips")}, {s("avg(l_quantity)", "psnr")} from lineitem group by 1, 2, 3""",
)
def scene_results(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("scene"), F.col("l_linestatus").alias("split"), F.col("l_linenumber").alias("method"))
    return rows.agg(F.count("*").alias("views"), snap(F.avg("l_discount")).alias("ssim"), snap(F.avg("l_tax")).alias("lpips"), snap(F.avg("l_quantity")).alias("psnr"))


@named(
    "image_pairs",
    """with r as (select vec_id, 'view_' || vec_id || '.png' as name, embedding[1] as value from embeddings where vec_id % 7 <> 3), g as (select 'view_' || vec_id || '.png' as name, embedding[2] as value from embeddings where vec_id % 5 <> 1)
    select name, r.value::double as render, g.value::double as truth from r join g using (name)""",
)
def image_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Renders and true images, each in a folder of its own, meet by file name; a name that one side lacks has no pair."""
    e = table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("view_"), F.col("vec_id").cast("string"), F.lit(".png")).alias("name"), "embedding")
    renders = e.where("vec_id % 7 <> 3").select("name", F.col("embedding")[0].cast("double").alias("render"))
    truths = e.where("vec_id % 5 <> 1").select("name", F.col("embedding")[1].cast("double").alias("truth"))
    return renders.join(truths, "name")


@named(
    "camera_json",
    f"""with q as (select s_suppkey, s_nationkey, s_name, s_suppkey % 5 + 1.0::double as w, s_suppkey % 3 + 0.0::double as x, s_nationkey % 4 + 0.0::double as y, s_nationkey % 2 + 0.0::double as z from supplier),
    u as (select *, sqrt(w*w + x*x + y*y + z*z) as n from q), v as (select s_suppkey, s_nationkey, s_name, w/n as w, x/n as x, y/n as y, z/n as z from u)
    select s_suppkey as id, s_name as name, s_nationkey::double as p0, (s_nationkey + 1)::double as p1, {s("1 - 2 * (y*y + z*z)", "r00")}, {s("2 * (x*y - w*z)", "r01")}, {s("2 * (y*z + w*x)", "r21")}, {s("800 / (2 * tan((0.5 + s_nationkey / 100.0::double) / 2))", "fx")}, {s("600 / (2 * tan(0.6::double / 2))", "fy")} from v""",
)
def camera_json(spark: SparkSession, sf: str) -> DataFrame:
    """Each camera's JSON (position, 3 x 3 rotation, focal lengths), read back into columns."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    q = unit([(x).cast("double") for x in (k % 5 + 1, k % 3, n % 4, n % 2)])
    rows = table(spark, sf, "supplier").select(K.camera_json(k, F.col("s_name"), [n, n + 1, F.lit(0)], rotation_matrix(q), F.lit(800), F.lit(600), 0.5 + n / 100, F.lit(0.6)).alias("json"))
    out = rows.select(F.from_json("json", "id bigint, name string, position array<double>, rotation array<array<double>>, fx double, fy double").alias("c"))
    r = lambda i, j: snap(F.col("c.rotation")[i][j])
    return out.select(F.col("c.id").alias("id"), F.col("c.name").alias("name"), F.col("c.position")[0].alias("p0"), F.col("c.position")[1].alias("p1"), r(0, 0).alias("r00"), r(0, 1).alias("r01"), r(2, 1).alias("r21"), snap(F.col("c.fx")).alias("fx"), snap(F.col("c.fy")).alias("fy"))


@named("initial_attributes", f"""select vec_id, {s("ln(0.1 / 0.9)::double", "opacity")}, 1.0::double as rotation0, {s("(embedding[12]::double / 2 + 0.5 - 0.5) / 0.28209479177387814", "sh0")} from embeddings""")
def initial_attributes(spark: SparkSession, sf: str) -> DataFrame:
    from pointloom.functions.columns import SH0, logit

    red = vector(F.col("embedding"), 12)[11] / 2 + 0.5
    return table(spark, sf, "embeddings").select("vec_id", snap(logit(F.lit(0.1))).alias("opacity"), F.lit(1.0).alias("rotation0"), snap((red - 0.5) / SH0).alias("sh0"))
