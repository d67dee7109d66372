"""Geometry and imaging queries: embeddings stand for points, rotations and 8 x 8 rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import columns as C
from pointloom.functions.columns import snap, vector
from pointloom.operators import scenes
from pointloom.plans.named import named
from pointloom.plans.profiles import s
from pointloom.session import table

_PAIR = "r as (select a.vec_id, a.embedding::double[] as a, b.embedding::double[] as b from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"
_UNIT = f"""{_PAIR}, n as (select vec_id, sqrt(a[4]*a[4]+a[5]*a[5]+a[6]*a[6]+a[7]*a[7]) as na, sqrt(b[4]*b[4]+b[5]*b[5]+b[6]*b[6]+b[7]*b[7]) as nb, a, b from r),
u as (select vec_id, a[4]/na as aw, a[5]/na as ax, a[6]/na as ay, a[7]/na as az, b[4]/nb as bw, b[5]/nb as bx, b[6]/nb as b_y, b[7]/nb as bz from n)"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")


def _rotations(df: DataFrame) -> tuple[list, list]:
    return vector(F.col("embedding"), 7)[3:], vector(F.col("next"), 7)[3:]


def _unit_pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, list, list]:
    df = _pairs(spark, sf)
    a, b = _rotations(df)
    df, ua = scenes.unit_rotations(df, a, "ua")
    df, ub = scenes.unit_rotations(df, b, "ub")
    return df, ua, ub


@named("rotation_angle", f"with {_UNIT} select vec_id, {s('degrees(2 * acos(least(1, abs(aw*bw+ax*bx+ay*b_y+az*bz))))', 'angle')} from u")
def rotation_angle(spark: SparkSession, sf: str) -> DataFrame:
    df, a, b = _unit_pairs(spark, sf)
    return df.select("vec_id", snap(F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs(C.dot(a, b)))))).alias("angle"))


@named(
    "so3_residual",
    f"""with {_UNIT}, q as (select vec_id, bw*aw+bx*ax+b_y*ay+bz*az as w, -bw*ax+bx*aw-b_y*az+bz*ay as x, -bw*ay+bx*az+b_y*aw-bz*ax as y, -bw*az-bx*ay+b_y*ax+bz*aw as z from u),
    p as (select vec_id, abs(w) as w, x * f as x, y * f as y, z * f as z, sqrt(x*x+y*y+z*z) as n from (select *, case when w < 0 then -1 else 1 end as f from q)),
    k as (select *, case when n < 1e-12 then 2 else 2 * atan2(n, w) / n end as g from p) select vec_id, {s("x * g", "rx")}, {s("y * g", "ry")}, {s("z * g", "rz")} from k""",
)
def so3_residual(spark: SparkSession, sf: str) -> DataFrame:
    df, a, b = _unit_pairs(spark, sf)
    df, r = scenes.rotation_residuals(df, a, b)
    return df.select("vec_id", *(snap(x).alias(n) for x, n in zip(r, ("rx", "ry", "rz"))))


@named("so3_roundtrip", f"with {_PAIR} select vec_id, true as same from r")
def so3_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    df, a, b = _unit_pairs(spark, sf)
    df, r = scenes.rotation_residuals(df, a, b)
    df, back = scenes.apply_residuals(df, r, a)
    return df.select("vec_id", (F.abs(C.dot(back, b)) > 1 - 1e-12).alias("same"))


@named(
    "rotation_matrix",
    f"with {_UNIT} select vec_id, {s('1 - 2 * (ay*ay + az*az)', 'm00')}, {s('2 * (ax*ay - aw*az)', 'm01')}, {s('2 * (ax*az + aw*ay)', 'm02')}, {s('1 - 2 * (ax*ax + ay*ay)', 'm22')} from u",
)
def rotation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    df, a, _ = _unit_pairs(spark, sf)
    m = C.rotation_matrix(a)
    return df.select("vec_id", *(snap(m[i][j]).alias(f"m{i}{j}") for i, j in ((0, 0), (0, 1), (0, 2), (2, 2))))


@named(
    "covariance",
    f"""with {_UNIT}, m as (select u.*, exp(2 * a[8]) as s0, exp(2 * a[9]) as s1, exp(2 * a[10]) as s2 from u join r using (vec_id))
    select vec_id, {s("pow(1 - 2*(ay*ay+az*az), 2) * s0 + pow(2*(ax*ay-aw*az), 2) * s1 + pow(2*(ax*az+aw*ay), 2) * s2", "c00")},
    {s("(1-2*(ay*ay+az*az)) * 2*(ax*ay+aw*az) * s0 + 2*(ax*ay-aw*az) * (1-2*(ax*ax+az*az)) * s1 + 2*(ax*az+aw*ay) * 2*(ay*az-aw*ax) * s2", "c01")} from m""",
)
def covariance(spark: SparkSession, sf: str) -> DataFrame:
    df, a, _ = _unit_pairs(spark, sf)
    c = C.covariance(a, vector(F.col("embedding"), 10)[7:])
    return df.select("vec_id", snap(c["c00"]).alias("c00"), snap(c["c01"]).alias("c01"))


@named(
    "sh_color",
    f"""with {_PAIR}, d as (select vec_id, a, a[1]/n as x, a[2]/n as y, a[3]/n as z from (select *, sqrt(a[1]*a[1]+a[2]*a[2]+a[3]*a[3]) as n from r))
    select vec_id, {s("0.28209479177387814*a[12]", "degree0")}, {s("0.28209479177387814*a[12] - 0.4886025119029199*y*a[13] + 0.4886025119029199*z*a[14] - 0.4886025119029199*x*a[15]", "degree1")},
    {s("0.28209479177387814*a[12] - 0.4886025119029199*y*a[13] + 0.4886025119029199*z*a[14] - 0.4886025119029199*x*a[15] + 1.0925484305920792*x*y*a[16] - 1.0925484305920792*y*z*a[17] + 0.31539156525252005*(2*z*z-x*x-y*y)*a[18] - 1.0925484305920792*x*z*a[19] + 0.5462742152960396*(x*x-y*y)*a[20]", "degree2")} from d""",
)
def sh_color(spark: SparkSession, sf: str) -> DataFrame:
    df = _pairs(spark, sf)
    all_ = vector(F.col("embedding"), 28)
    df, d = scenes.unit_rotations(df, all_[:3], "d")
    return df.select("vec_id", *(snap(C.sh_color(all_[11:], d, k)).alias(f"degree{k}") for k in (0, 1, 2)))


@named("opacity_activation", f"select vec_id, {s('1 / (1 + exp(-embedding[11]::double))', 'opacity')}, {s('exp(embedding[8]::double)', 'scale')}, {s('embedding[12]::double * 0.28209479177387814 + 0.5', 'red')} from embeddings")
def opacity_activation(spark: SparkSession, sf: str) -> DataFrame:
    x = vector(F.col("embedding"), 12)
    return table(spark, sf, "embeddings").select("vec_id", snap(C.sigmoid(x[10])).alias("opacity"), snap(F.exp(x[7])).alias("scale"), snap(x[11] * C.SH0 + 0.5).alias("red"))


@named("camera_norm", f"""with m as (select avg(s_acctbal) as a, avg(s_nationkey) as b from supplier) select {s("max(1.1 * sqrt(pow(s_acctbal - a, 2) + pow(s_nationkey - b, 2)))", "radius")}, {s("-any_value(a)", "t0")}, {s("-any_value(b)", "t1")} from supplier, m""")
def camera_norm(spark: SparkSession, sf: str) -> DataFrame:
    out = scenes.camera_spread(table(spark, sf, "supplier"), ["s_acctbal", "s_nationkey"])
    return out.select(*(snap(F.col(c)).alias(c) for c in ("radius", "t0", "t1")))


@named(
    "orbit_camera",
    f"""with c as (select p_partkey, radians((p_partkey % 360)::double) as az, radians((p_size - 25)::double) as el, 1 + p_size / 10.0::double as d from part)
    select p_partkey, {s("d * sin(az) * cos(el)", "eye0")}, {s("d * sin(el)", "eye1")}, {s("d * cos(az) * cos(el)", "eye2")}, {s("-cos(az) * cos(el)", "view2")} from c""",
)
def orbit_camera(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    c = scenes.orbit_camera((F.col("p_partkey") % 360).cast("double"), (F.col("p_size") - 25).cast("double"), 1 + F.col("p_size") / 10.0)
    return part.select("p_partkey", *(snap(c[k]).alias(k) for k in ("eye0", "eye1", "eye2", "view2")))


@named("focal_length", f"""select p_partkey, {s("p_retailprice / (2 * tan(radians(20 + p_size)::double / 2))", "focal")}, {s("degrees(2 * atan(p_retailprice / (2 * 900.0::double)))", "fov")} from part""")
def focal_length(spark: SparkSession, sf: str) -> DataFrame:
    price, fov = F.col("p_retailprice"), F.radians((20 + F.col("p_size")).cast("double"))
    return table(spark, sf, "part").select("p_partkey", snap(C.focal_length(fov, price)).alias("focal"), snap(F.degrees(C.field_of_view(F.lit(900.0), price))).alias("fov"))


@named(
    "voxel_downsample",
    f"""with p as (select vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings), l as (select min(x) as a, min(y) as b, min(z) as c from p)
    select floor((x - a) / 0.25)::bigint as v0, floor((y - b) / 0.25)::bigint as v1, floor((z - c) / 0.25)::bigint as v2, count(*) as points, {s("avg(x)", "x")}, {s("avg(y)", "y")}, {s("avg(z)", "z")} from p, l group by 1, 2, 3""",
)
def voxel_downsample(spark: SparkSession, sf: str) -> DataFrame:
    out = scenes.voxel_downsample(_points(spark, sf), ["x", "y", "z"], 0.25)
    return out.withColumns({c: snap(F.col(c)) for c in "xyz"})


def _points(spark: SparkSession, sf: str) -> DataFrame:
    v = vector(F.col("embedding"), 3)
    return table(spark, sf, "embeddings").select("vec_id", *(x.alias(n) for x, n in zip(v, "xyz")))


@named("box_centre", f"select {s('(min(embedding[1]::double) + max(embedding[1]::double)) / 2', 'c_x')}, {s('(min(embedding[2]::double) + max(embedding[2]::double)) / 2', 'c_y')} from embeddings")
def box_centre(spark: SparkSession, sf: str) -> DataFrame:
    out = scenes.box_centre(_points(spark, sf), ["x", "y"])
    return out.select(snap(F.col("c_x")).alias("c_x"), snap(F.col("c_y")).alias("c_y"))


@named(
    "nearest_scale",
    f"""with p as (select vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings),
    d as (select a.vec_id, b.vec_id as o, pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2) as d from p a join p b on a.vec_id <> b.vec_id),
    n as (select *, row_number() over (partition by vec_id order by d, o) as n from d) select vec_id, count(*) as found, {s("ln(sqrt(greatest(avg(d), 1e-7)))", "log_scale")} from n where n <= 3 group by 1""",
)
def nearest_scale(spark: SparkSession, sf: str) -> DataFrame:
    return scenes.nearest_scale(_points(spark, sf), "vec_id", ["x", "y", "z"], 0.1).withColumn("log_scale", snap(F.col("log_scale")))


def _pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Two rasters of 64 pixels per vector: its own numbers and those of the next vector, in 0..1."""
    zipped = _pairs(spark, sf).select("vec_id", F.posexplode(F.arrays_zip("embedding", "next")).alias("p", "v"))
    return zipped.select("vec_id", "p", (F.col("v.embedding").cast("double") / 2 + 0.5).alias("a"), (F.col("v.next").cast("double") / 2 + 0.5).alias("b"))


_PIX = f"{_PAIR}, x as (select vec_id, g.i::int as p, a[g.i + 1] / 2 + 0.5 as a, b[g.i + 1] / 2 + 0.5 as b from r, range(64) g(i))"


@named("image_mse_psnr", f"with {_PIX} select vec_id, {s('avg(pow(a-b,2))', 'mse')}, {s('avg(abs(a-b))', 'mae')}, {s('max(abs(a-b))', 'worst')}, {s('-10*log10(avg(pow(a-b,2)))', 'psnr')} from x group by 1")
def image_mse_psnr(spark: SparkSession, sf: str) -> DataFrame:
    out = scenes.image_quality(_pixels(spark, sf), ["vec_id"], "a", "b")
    return out.select("vec_id", *(snap(F.col(c)).alias(c) for c in ("mse", "mae", "worst", "psnr")))


@named("channel_psnr", f"with {_PIX}, c as (select vec_id, p % 3 as ch, -10*log10(avg(pow(a-b,2))) as v from x group by 1, 2) select vec_id, {s('avg(v)', 'psnr')} from c group by 1")
def channel_psnr(spark: SparkSession, sf: str) -> DataFrame:
    out = scenes.channel_psnr(_pixels(spark, sf).withColumn("ch", F.col("p") % 3), ["vec_id"], "ch", "a", "b")
    return out.select("vec_id", snap(F.col("psnr")).alias("psnr"))


@named(
    "silhouette_compare",
    f"""with {_PIX} select vec_id, {s("coalesce(sum((a>0.5 and b>0.5)::int)::double / nullif(sum((a>0.5 or b>0.5)::int), 0), 1)", "iou")}, sum((a<=0.5 and b>0.5)::int)::bigint as false_positive, sum((a>0.5 and b<=0.5)::int)::bigint as false_negative,
    {s("avg(abs(b-a))", "alpha_mae")}, {s("sqrt(avg(pow(b-a,2)))", "alpha_rmse")}, {s("avg(case when a>0.5 and b>0.5 then abs(b*3-a*3) end)", "depth_mae")}, {s("sqrt(avg(case when a>0.5 and b>0.5 then pow(b*3-a*3,2) end))", "depth_rmse")} from x group by 1""",
)
def silhouette_compare(spark: SparkSession, sf: str) -> DataFrame:
    pixels = _pixels(spark, sf).withColumns({"da": F.col("a") * 3, "db": F.col("b") * 3})
    out = scenes.silhouettes(pixels, ["vec_id"], "a", "b", "da", "db")
    return out.withColumns({c: snap(F.col(c)) for c in ("iou", "alpha_mae", "alpha_rmse", "depth_mae", "depth_rmse")})


@named(
    "alpha_composite",
    f"""with p as (select event_id, user_id as pixel, value, (event_id % 89 + 1) / 100.0::double as al, (event_id * 7 % 1000)::double as z from events),
    t as (select *, coalesce(exp(sum(ln(1 - al)) over (partition by pixel order by z, event_id rows between unbounded preceding and 1 preceding)), 1) * al as w from p),
    g as (select pixel, sum(w * value) as c, sum(w) as al, sum(w * z) as d from t group by 1)
    select pixel, {s("c + (1 - al) * 0.5", "colour")}, {s("al", "alpha")}, {s("case when al > 1e-8 then d / al else 0 end", "depth")} from g""",
)
def alpha_composite(spark: SparkSession, sf: str) -> DataFrame:
    splats = table(spark, sf, "events").select("event_id", F.col("user_id").alias("pixel"), "value", ((F.col("event_id") % 89 + 1) / 100.0).alias("al"), (F.col("event_id") * 7 % 1000).cast("double").alias("z"))
    out = scenes.composite(splats, ["pixel"], ["z", "event_id"], "al", "value", "z", 0.5)
    return out.withColumns({c: snap(F.col(c)) for c in ("colour", "alpha", "depth")})


@named(
    "splat_pixels",
    """with p as (select event_id, (event_id * 13 % 40 - 4)::double as x, (event_id * 7 % 40 - 4)::double as y, (event_id % 3)::double as r from events),
    b as (select event_id, greatest(0, floor(x - r)) as l, least(31, ceil(x + r)) as ri, greatest(0, floor(y - r)) as t, least(31, ceil(y + r)) as bo from p)
    select px::bigint as px, py::bigint as py, count(*) as splats from b, range(32) gx(px), range(32) gy(py) where px between l and ri and py between t and bo group by 1, 2""",
)
def splat_pixels(spark: SparkSession, sf: str) -> DataFrame:
    splats = table(spark, sf, "events").selectExpr("cast(event_id * 13 % 40 - 4 as double) as x", "cast(event_id * 7 % 40 - 4 as double) as y", "cast(event_id % 3 as double) as r")
    return scenes.splat_pixels(splats, "x", "y", "r", 32, 32).groupBy("px", "py").agg(F.count("*").alias("splats"))


@named("train_test_stride", """select c_name, row_number() over (order by c_name) - 1 as position, case when (row_number() over (order by c_name) - 1) % 8 = 0 then 'test' else 'train' end as split from customer""")
def train_test_stride(spark: SparkSession, sf: str) -> DataFrame:
    return scenes.train_test(table(spark, sf, "customer").select("c_name"), "c_name")


@named(
    "ssim_neighbours",
    f"""with e as (select a.vec_id, a.embedding::double[] as a, b.embedding::double[] as b from embeddings a join embeddings b on b.vec_id = a.vec_id + 1),
    px as (select vec_id, i, a[i + 1] / 2 + 0.5 as p, b[i + 1] / 2 + 0.5 as q from e, range(64) r(i)),
    total as (select sum(exp(-d * d / 4.5::double)) as t from range(-5, 6) r(d)),
    g as (select i, j, exp(-(pow(i % 8 - j % 8, 2) + pow(i // 8 - j // 8, 2)) / 4.5::double) / (t * t) as w from range(64) x(i), range(64) y(j), total where abs(i % 8 - j % 8) <= 5 and abs(i // 8 - j // 8) <= 5),
    m as (select vec_id, g.i, sum(w * p) as mp, sum(w * q) as mq, sum(w * p * p) as pp, sum(w * q * q) as qq, sum(w * p * q) as pq from px join g on px.i = g.j group by 1, 2)
    select vec_id, {s("avg((2 * mp * mq + 1e-4) * (2 * (pq - mp * mq) + 9e-4) / ((mp * mp + mq * mq + 1e-4) * (pp - mp * mp + qq - mq * mq + 9e-4)))", "ssim")} from m group by 1""",
)
def ssim_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Each raster of 8 x 8 against the next one."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 64), lambda x: x.cast("double") / 2 + 0.5).alias("a"))
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return scenes.ssim(both, "vec_id", "a", "b", 8).withColumn("ssim", snap(F.col("ssim")))


@named("camera_join", """select n_name, r_name, count(*) as cameras from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""")
def camera_join(spark: SparkSession, sf: str) -> DataFrame:
    # Intrinsics are a short dimension: Spark broadcasts them by their size.
    views = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return views.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name", "r_name").agg(F.count("*").alias("cameras"))
