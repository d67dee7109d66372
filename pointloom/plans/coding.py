"""Coding queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.columns import index_bytes, index_kind, packed_bytes, snap
from pointloom.operators import coding
from pointloom.plans.named import named
from pointloom.plans.profiles import s
from pointloom.session import table


def _components(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 3)).alias("axis", "x"))


def _quantize(width: int):
    sql = f"""with c as (select vec_id, a.i::int as axis, embedding[a.i + 1]::double as x from embeddings, range(3) a(i)), p as (select max(abs(x)) / {2 ** (width - 1) - 1}.0 as step from c)
    select vec_id, axis, round_even(x / step, 0)::int as q, floor((round_even(x / step, 0) * step)::float::double * 1e6 + 0.5) / 1e6 as decoded from c, p"""

    @named(f"quantize_q{width}", sql)
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return coding.quantize(_components(spark, sf), "x", width).select("vec_id", "axis", "q", snap(F.col("decoded").cast("double")).alias("decoded"))

    return query


quantize_q8, quantize_q10, quantize_q12, quantize_q16 = (_quantize(w) for w in (8, 10, 12, 16))


@named(
    "quantize_error_bound",
    """with c as (select label, embedding[a.i + 1]::double as x from embeddings, range(3) a(i)), p as (select label, max(abs(x)) / 127.0 as step from c group by 1)
    select label, count(*) as components, bool_and(abs(round_even(x / step, 0) * step - x) <= step / 2 + 1e-6) as within from c join p using (label) group by 1""",
)
def quantize_error_bound(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("label", F.explode(F.slice("embedding", 1, 3)).alias("x"))
    out = coding.quantize(rows, "x", 8, ["label"])
    return out.groupBy("label").agg(F.count("*").alias("components"), F.every(F.abs(F.col("q") * F.col("step") - F.col("x").cast("double")) <= F.col("step") / 2 + 1e-6).alias("within"))


@named("packed_size", "select label, w.b::int as width, ceil(count(*) * 3 * w.b / 8.0)::bigint as bytes from embeddings, (values (8), (10), (12), (16)) w(b) group by label, w.b")
def packed_size(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "embeddings").groupBy("label").agg((F.count("*") * 3).alias("n"))
    return n.select("label", "n", F.explode(F.array(*map(F.lit, (8, 10, 12, 16)))).alias("width")).select("label", "width", packed_bytes(F.col("n"), F.col("width")).alias("bytes"))


_CH = "c as (select label, count(*) as rows, sum((label > 6 or vec_id % (label * 10 + 1) = 0)::int)::bigint as changed from embeddings group by 1)"


def _changed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("rows"), F.sum(F.expr("cast(label > 6 or vec_id % (label * 10 + 1) = 0 as bigint)")).alias("changed"))


@named(
    "index_choice",
    f"""with {_CH} select label, rows, changed, case when changed = rows then 'dense' when 4 * changed < ceil(rows / 8.0) then 'ids' else 'mask' end as kind,
    (case when changed = rows then 0 when 4 * changed < ceil(rows / 8.0) then 4 * changed else ceil(rows / 8.0) end)::bigint as bytes from c""",
)
def index_choice(spark: SparkSession, sf: str) -> DataFrame:
    c, n = F.col("changed"), F.col("rows")
    return _changed(spark, sf).withColumns({"kind": index_kind(c, n), "bytes": index_bytes(c, n)})


@named(
    "coding_configurations",
    f"""with {_CH}, k(layout, width) as (values ('dense', 8), ('dense', 12), ('ids', 8), ('ids', 12), ('sparse', 8), ('sparse', 12), ('base', 32))
    select layout, width::int as width, sum(ceil(case when layout = 'dense' then rows else changed end * 3 * width / 8.0))::bigint as value_bytes,
    sum(case layout when 'ids' then 4 * changed when 'sparse' then case when changed = rows then 0 else least(4 * changed, ceil(rows / 8.0)) end else 0 end)::bigint as index_bytes from c, k group by 1, 2""",
)
def coding_configurations(spark: SparkSession, sf: str) -> DataFrame:
    layouts = spark.createDataFrame([("dense", 8), ("dense", 12), ("ids", 8), ("ids", 12), ("sparse", 8), ("sparse", 12), ("base", 32)], "layout string, width int")
    sizes = coding.serialized_sizes(_changed(spark, sf).withColumn("components", F.lit(3)), layouts)
    return sizes.groupBy("layout", "width").agg(F.sum("value_bytes").alias("value_bytes"), F.sum("index_bytes").alias("index_bytes"))


@named("pack_unpack_roundtrip", "select vec_id, 64::bigint as n, 96::bigint as packed_bytes, true as same from embeddings")
def pack_unpack_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.rint(x * 2000).cast("int")).alias("q"))
    return coding.pack_column(rows, "vec_id", "q", 12).select("vec_id", "n", "packed_bytes", "same")


_SP = """t as (select vec_id, label + case when vec_id % 5 = 0 then 1 else 0 end as v from embeddings where vec_id % 3 <> 0), p as (select vec_id, label as v from embeddings where vec_id % 4 <> 0)"""


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("v"))
    return e.where("vec_id % 3 <> 0").withColumn("v", F.expr("v + if(vec_id % 5 = 0, 1, 0)")), e.where("vec_id % 4 <> 0")


@named("sparse_encode", f"with {_SP} select t.vec_id, t.v, p.v is null as is_new from t left join p using (vec_id) where p.v is null or p.v <> t.v")
def sparse_encode(spark: SparkSession, sf: str) -> DataFrame:
    return coding.sparse_changes(*_versions(spark, sf), "vec_id", ["v"])


@named("sparse_decode", f"with {_SP} select * from t union all select * from p where vec_id not in (select vec_id from t)")
def sparse_decode(spark: SparkSession, sf: str) -> DataFrame:
    target, parent = _versions(spark, sf)
    return coding.apply_changes(parent, coding.sparse_changes(target, parent, "vec_id", ["v"]), "vec_id", ["v"])


@named(
    "closed_loop_temporal",
    """with recursive o as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as n from events),
    r as (select user_id, event_id, n, round_even(value / 0.5, 0)::bigint as q, round_even(value / 0.5, 0) * 0.5 as decoded, value from o where n = 1
      union all select o.user_id, o.event_id, o.n, round_even((o.value - r.decoded) / 0.5, 0)::bigint, r.decoded + round_even((o.value - r.decoded) / 0.5, 0) * 0.5, o.value from r join o on o.user_id = r.user_id and o.n = r.n + 1)
    select user_id, event_id, q, decoded::double as decoded, abs(value - decoded) <= 0.25 + 1e-9 as within from r""",
)
def closed_loop_temporal(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_id", "value")
    out = coding.closed_loop(rows, ["user_id"], "event_id", "value", 0.5)
    return out.select("user_id", "event_id", "q", "decoded", (F.col("error") <= 0.25 + 1e-9).alias("within"))


@named(
    "content_hash_dedupe",
    "select sha256(text) as digest, count(*) as copies, min(doc_id) as first_doc from documents group by 1",
)
def content_hash_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


@named(
    "state_digest",
    """select label, count(*) as rows, sha256(string_agg(sha256(vec_id::varchar || '|' || label::varchar), '' order by vec_id)) as digest from embeddings group by 1""",
)
def state_digest(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").withColumn("v", F.col("label"))
    return coding.state_digest(e, ["label"], "vec_id", ["v"])


@named(
    "container_roundtrip",
    """with m as (select conv_id, turn // 2 as segment, turn, encode(text) as data from conversations)
    select conv_id, segment, turn::varchar as id, octet_length(data)::bigint as length, sha256(data) as sha256,
    coalesce(sum(octet_length(data)) over (partition by conv_id, segment order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from m""",
)
def container_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    members = table(spark, sf, "conversations").select("conv_id", F.floor(F.col("turn") / 2).alias("segment"), "turn", F.col("turn").cast("string").alias("id"), F.col("text").cast("binary").alias("data"))
    boxes = coding.write_containers(members, ["conv_id", "segment"], "turn", "id", "data")
    return coding.read_containers(boxes, ["conv_id", "segment"]).select("conv_id", "segment", "id", "offset", "length", "sha256")
