"""Scene-state queries: embeddings stand for states, events for sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.columns import snap, vector
from pointloom.operators import states
from pointloom.plans.named import named
from pointloom.plans.profiles import s
from pointloom.session import table

_E = "embeddings"


def _target(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, _E).where("vec_id % 3 <> 0")


def _parent(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, _E).where("vec_id % 4 <> 0")


@named(
    "id_match",
    """with p as (select vec_id, vec_id + 1000000 as r from embeddings where vec_id % 4 <> 0)
    select t.vec_id, t.vec_id + 1000000 as row_idx, coalesce(p.r, -1) as parent_row, p.r is not null as common from embeddings t left join p using (vec_id) where t.vec_id % 3 <> 0""",
)
def id_match(spark: SparkSession, sf: str) -> DataFrame:
    row = F.col("vec_id") + 1000000
    return states.match_ids(_target(spark, sf).withColumn("row_idx", row), _parent(spark, sf).withColumn("row_idx", row), "vec_id", "row_idx")


@named("new_ids", "select vec_id from embeddings where vec_id % 3 <> 0 and vec_id % 4 = 0")
def new_ids(spark: SparkSession, sf: str) -> DataFrame:
    return states.new_ids(_target(spark, sf), _parent(spark, sf), "vec_id")


@named("deleted_ids", "select vec_id from embeddings where vec_id % 4 <> 0 and vec_id % 3 = 0")
def deleted_ids(spark: SparkSession, sf: str) -> DataFrame:
    return states.deleted_ids(_target(spark, sf), _parent(spark, sf), "vec_id")


@named("row_prefix", f"""select vec_id, {s("embedding[1]::double", "a")}, {s("embedding[1]::double + label", "b")} from embeddings where vec_id < 200""")
def row_prefix(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, _E).withColumn("x", F.element_at("embedding", 1).cast("double"))
    out = states.row_prefix(e, e.withColumn("x", F.col("x") + F.col("label")), "vec_id", "x", 200)
    return out.withColumns({"a": snap(F.col("a")), "b": snap(F.col("b"))})


@named("stable_subset", "select vec_id, label, (300 - vec_id) // 7 as pos from embeddings where vec_id <= 300 and (300 - vec_id) % 7 = 0 and vec_id >= 6")
def stable_subset(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, _E).select("vec_id", "label")
    wanted = spark.range(0, 43).select((300 - F.col("id") * 7).alias("vec_id"), F.col("id").alias("pos"))
    return states.subset(e, wanted.where("vec_id >= 6"), "vec_id")


@named("proxy_topk", "select vec_id from (select vec_id, embedding[11] as o from embeddings order by o desc, vec_id limit 64)")
def proxy_topk(spark: SparkSession, sf: str) -> DataFrame:
    return states.top_ids(table(spark, sf, _E).select("vec_id", F.element_at("embedding", 11).alias("o")), "o", "vec_id", 64)


@named(
    "frozen_subset",
    """with k as (select vec_id from (select vec_id, embedding[11] as o from embeddings order by o desc, vec_id limit 64)) select label, count(*) as rows from embeddings where vec_id in (select vec_id from k) group by 1""",
)
def frozen_subset(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, _E)
    frozen = states.top_ids(e.select("vec_id", F.element_at("embedding", 11).alias("o")), "o", "vec_id", 64)
    return e.join(frozen, "vec_id", "left_semi").groupBy("label").agg(F.count("*").alias("rows"))


_STATS = """with r as (select a.vec_id, a.embedding::double[] as a, b.embedding::double[] as b, a.label % 3 = 0 as moved from embeddings a join embeddings b on b.vec_id = a.vec_id + 1),
d as (select 'xyz' as attribute, 0.05 as tol, [case when moved then b[i] - a[i] else 0 end for i in range(1, 4)] as d from r
  union all select 'scale', 0.2, [case when moved then b[i] - a[i] else 0 end for i in range(8, 11)] from r union all select 'opacity', 0.1, [b[11] - a[11]] from r),
l as (select *, sqrt(list_sum(list_transform(d, lambda x: x * x))) as len, list_sum(list_transform(d, lambda x: abs(x))) / len(d) as ab, list_sum(list_transform(d, lambda x: x * x)) / len(d) as sq,
  len(list_filter(d, lambda x: x <> 0)) > 0 as changed from d)"""


@named(
    "attribute_stats",
    f"""{_STATS} select attribute, count(*) as rows, sum(changed::int)::bigint as changed, {s("avg(changed::int)", "changed_share")}, {s("avg((len > tol)::int)", "beyond_share")}, {s("avg(ab)", "mae")}, {s("sqrt(avg(sq))", "rms")},
    {s("avg(len)", "mean")}, {s("median(len)", "median")}, {s("quantile_cont(len, 0.95)", "p95")}, {s("max(len)", "max")} from l group by 1""",
)
def attribute_stats(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, _E)
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    pairs = e.join(b, "vec_id")
    x, y, moved = vector(F.col("embedding"), 11), vector(F.col("next"), 11), F.col("label") % 3 == 0
    y = [F.when(moved, q).otherwise(p) if i < 10 else q for i, (p, q) in enumerate(zip(x, y))]
    out = states.changes(pairs, {"xyz": (x[:3], y[:3], 0.05), "scale": (x[7:10], y[7:10], 0.2), "opacity": (x[10:11], y[10:11], 0.1)})
    return out.withColumns({c: snap(F.col(c)) for c in ("changed_share", "beyond_share", "mae", "rms", "mean", "median", "p95", "max")})


_Q = "q as (select event_type as owner, user_id as row_idx, event_id as frame, case when user_id % 4 = 0 then 1 else event_id % 3 end as v from events)"


def _sequence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("owner"), F.col("user_id").alias("row_idx"), F.col("event_id").alias("frame"), F.expr("if(user_id % 4 = 0, 1, event_id % 3)").alias("v"))


@named("static_rows", f"with {_Q} select owner, row_idx, min(v) = max(v) as static, count(*) as frames from q group by 1, 2")
def static_rows(spark: SparkSession, sf: str) -> DataFrame:
    return states.static_rows(_sequence(spark, sf), ["owner", "row_idx"], "v")


@named(
    "lifetimes",
    f"""with {_Q}, p as (select owner, row_idx, min(v) = max(v) as st from q group by 1, 2)
    select owner, count(*) as rows, sum(st::int)::bigint as static_rows, {s("avg(st::int)", "static_share")}, bool_and(st) as whole_static from p group by 1""",
)
def lifetimes(spark: SparkSession, sf: str) -> DataFrame:
    return states.lifetimes(_sequence(spark, sf), ["owner"], "row_idx", "v").withColumn("static_share", snap(F.col("static_share")))


@named(
    "transition_changes",
    f"""with {_Q}, l as (select owner, frame // 1000 as span, v, lag(v) over (partition by owner, row_idx order by frame) as b from q)
    select owner, span, count(*) as rows, sum((b <> v)::int)::bigint as changed from l where b is not null group by 1, 2""",
)
def transition_changes(spark: SparkSession, sf: str) -> DataFrame:
    out = states.transitions(_sequence(spark, sf), ["owner"], "row_idx", "frame", "v")
    return out.groupBy("owner", F.floor(F.col("frame") / 1000).alias("span")).agg(F.sum("rows").alias("rows"), F.sum("changed").alias("changed"))


@named(
    "temporal_residual_stats",
    f"""with l as (select event_type as owner, abs(value - lag(value) over (partition by event_type, user_id order by event_id)) as m from events)
    select owner, count(*) as residuals, {s("avg(m)", "mean")}, {s("median(m)", "median")}, {s("quantile_cont(m, 0.95)", "p95")}, {s("max(m)", "max")}, {s("avg((m = 0)::int)", "zero_share")} from l where m is not null group by 1""",
)
def temporal_residual_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("event_type").alias("owner"), "user_id", "event_id", "value")
    out = states.residual_stats(rows, ["owner"], "user_id", "event_id", "value")
    return out.withColumns({c: snap(F.col(c)) for c in ("mean", "median", "p95", "max", "zero_share")})


@named(
    "append_rows",
    """select vec_id as row_idx, label from embeddings where vec_id < 100 union all select row_number() over (order by vec_id) - 1 + 100, label from embeddings where vec_id >= 100 and label = 3""",
)
def append_rows(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf, _E).select(F.col("vec_id").alias("row_idx"), "label")
    more = e.where("row_idx >= 100 and label = 3").withColumn("row_idx", (F.row_number().over(Window.orderBy("row_idx")) - 1).cast("bigint"))
    return states.append_rows(e.where("row_idx < 100"), more, "row_idx")


@named("row_complement", "select vec_id from embeddings where label <> 0")
def row_complement(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, _E)
    return states.complement(e.select("vec_id"), e.where("label = 0"), "vec_id")


@named(
    "invalid_rows",
    """select vec_id, 'rotation_width' as rule from embeddings where label = 7 union all select vec_id, 'zero_rotation' from embeddings where label = 2 union all select vec_id, 'xyz_finite' from embeddings where label = 5""",
)
def invalid_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, _E).selectExpr(
        "vec_id", "if(label = 5, transform(slice(embedding, 1, 3), x -> float('inf')), slice(embedding, 1, 3)) as xyz", "case label when 7 then slice(embedding, 4, 3) when 2 then transform(slice(embedding, 4, 4), x -> float(0)) else slice(embedding, 4, 4) end as rotation"
    )
    return states.invalid_rows(e, {"xyz": 3, "rotation": 4}, "rotation", "vec_id")


@named("prune_rows", "select vec_id, label from embeddings where vec_id < 50 or embedding[11] >= 0")
def prune_rows(spark: SparkSession, sf: str) -> DataFrame:
    return states.prune(table(spark, sf, _E), F.element_at("embedding", 11) < 0, "vec_id", 50).select("vec_id", "label")


@named("densify_clone", """select vec_id as row_idx, label from embeddings union all select row_number() over (order by vec_id) + (select max(vec_id) from embeddings), label from embeddings where embedding[8] > 0.1""")
def densify_clone(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, _E).select(F.col("vec_id").alias("row_idx"), "label", F.element_at("embedding", 8).alias("g"))
    return states.clone(e, F.col("g") > 0.1, "row_idx").select("row_idx", "label")


@named(
    "densify_split",
    f"""select vec_id, 0 as part, {s("embedding[8]::double", "scale0")} from embeddings where embedding[8] <= 0.1 union all select vec_id, p.i::int, {s("embedding[8]::double - ln(1.6)", "scale0")} from embeddings, range(1, 3) p(i) where embedding[8] > 0.1""",
)
def densify_split(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, _E).selectExpr("vec_id", "transform(slice(embedding, 8, 3), x -> double(x)) as scale")
    out = states.split(e, F.element_at("scale", 1) > F.lit(0.1).cast("float").cast("double"), "vec_id", "scale")
    return out.select("vec_id", "part", snap(F.element_at("scale", 1)).alias("scale0"))


@named("reset_opacity", f"""select vec_id, case when vec_id < 20 then {s("embedding[11]::double", "o").removesuffix(" as o")} else floor(ln(least(1 / (1 + exp(-embedding[11]::double)), 0.01) / (1 - least(1 / (1 + exp(-embedding[11]::double)), 0.01))) * 1e6 + 0.5) / 1e6 end as opacity from embeddings""")
def reset_opacity(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, _E).select("vec_id", F.element_at("embedding", 11).cast("double").alias("opacity"))
    return states.reset_opacity(e, "opacity", "vec_id", 20).withColumn("opacity", snap(F.col("opacity")))


@named("accumulate_gradients", f"""select user_id as row_idx, max(event_id % 9) as max_radius, {s("sum(value)", "gradient")}, count(*) as views from events where event_id % 9 > 0 group by 1""")
def accumulate_gradients(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "events").select(F.col("user_id").alias("row_idx"), (F.col("event_id") % 9).alias("radius"), "value")
    return states.accumulate(seen, "row_idx", "radius", "value").withColumn("gradient", snap(F.col("gradient")))
