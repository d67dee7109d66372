"""Byte-ledger queries: line items stand for coded streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.columns import snap
from pointloom.operators import ledger
from pointloom.plans.named import named
from pointloom.plans.profiles import s
from pointloom.session import table


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with whole numbers of bytes, so that sums are exact."""
    return table(spark, sf, "lineitem").withColumns({"l_quantity": F.floor("l_quantity"), "l_extendedprice": F.floor("l_extendedprice")})


@named(
    "ledger_accounting",
    f"""select case when grouping(l_returnflag) = 1 then 'total' when grouping(l_linestatus) = 1 then 'owner' else 'category' end as grain,
    l_returnflag as owner, l_linestatus as category, sum(floor(l_quantity))::bigint as raw_bytes, sum(floor(l_extendedprice))::bigint as coded_bytes
    from lineitem group by grouping sets ((), (l_returnflag), (l_returnflag, l_linestatus))""",
)
def ledger_accounting(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.accounting(_ledger(spark, sf), "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")


@named(
    "owner_shares",
    f"""with p as (select l_returnflag as owner, sum(floor(l_extendedprice))::bigint as c, sum(case when l_linestatus = 'F' then floor(l_extendedprice) else 0 end)::bigint as v from lineitem group by 1)
    select owner, c as coded_bytes, v as value_bytes, {s("c / (select sum(c) from p)", "share")}, {s("v / c", "value_share")} from p""",
)
def owner_shares(spark: SparkSession, sf: str) -> DataFrame:
    out = ledger.owner_shares(_ledger(spark, sf), "l_returnflag", F.col("l_linestatus") == "F", "l_extendedprice")
    return out.withColumns({c: snap(F.col(c)) for c in ("share", "value_share")})


@named(
    "owner_attribute_breakdown",
    f"""with t as (select l_returnflag as owner, l_linenumber as attribute, sum(floor(l_quantity))::bigint as r, sum(floor(l_extendedprice))::bigint as c from lineitem where l_linenumber <> 3 or l_returnflag <> 'R' group by 1, 2),
    d as (select * from (select distinct owner from t), (select distinct attribute from t))
    select owner, attribute, coalesce(r, 0) as raw_bytes, coalesce(c, 0) as coded_bytes, {s("coalesce(r / c, 0)", "ratio")} from d left join t using (owner, attribute)""",
)
def owner_attribute_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    rows = _ledger(spark, sf).where("l_linenumber <> 3 or l_returnflag <> 'R'").withColumnsRenamed({"l_returnflag": "owner", "l_linenumber": "attribute"})
    out = ledger.breakdown(rows, "owner", "attribute", "l_quantity", "l_extendedprice")
    return out.withColumns({c: snap(F.col(c)) for c in ("ratio",)})


@named("attribute_bytes", """select l_linenumber as attribute, sum(floor(l_extendedprice))::bigint as coded_bytes from lineitem where l_returnflag = 'A' group by 1""")
def attribute_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return _ledger(spark, sf).where("l_returnflag = 'A'").groupBy(F.col("l_linenumber").alias("attribute")).agg(F.sum("l_extendedprice").alias("coded_bytes"))


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    return _ledger(spark, sf).groupBy(F.col("l_suppkey").alias("variant")).agg(F.sum("l_extendedprice").alias("bytes"), snap(F.avg("l_discount")).alias("loss"), snap(F.avg("l_tax")).alias("worst"))


_VARIANTS = f"""v as (select l_suppkey as variant, sum(floor(l_extendedprice))::bigint as bytes, {s("avg(l_discount)", "loss")}, {s("avg(l_tax)", "worst")} from lineitem group by 1)"""


@named("pareto_frontier", f"with {_VARIANTS} select variant, bytes, loss from v r where not exists (select 1 from v a where a.bytes <= r.bytes and a.loss <= r.loss and (a.bytes < r.bytes or a.loss < r.loss))")
def pareto_frontier(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.frontier(_variants(spark, sf).select("variant", "bytes", "loss"), "variant", "bytes", "loss")


@named(
    "pareto_multi",
    f"with {_VARIANTS} select variant, bytes, loss, worst from v r where not exists (select 1 from v a where a.bytes <= r.bytes and a.loss <= r.loss and a.worst <= r.worst and (a.bytes < r.bytes or a.loss < r.loss or a.worst < r.worst))",
)
def pareto_multi(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.frontier_many(_variants(spark, sf), "variant", ["bytes", "loss", "worst"])


@named("operating_point", f"with {_VARIANTS} select variant, bytes, loss, worst from v where loss <= 0.05 and worst <= 0.0402 order by bytes, variant limit 1")
def operating_point(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.operating_point(_variants(spark, sf), (F.col("loss") <= 0.05) & (F.col("worst") <= 0.0402), "bytes", "variant")


@named("near_parent", f"with {_VARIANTS} select v.* from v, (select loss, worst from v where variant = 1) p where v.loss <= p.loss + 0.0005 and v.worst <= p.worst + 0.0002")
def near_parent(spark: SparkSession, sf: str) -> DataFrame:
    v = _variants(spark, sf)
    return ledger.within_parent(v, v.where("variant = 1"), {"loss": 0.0005, "worst": 0.0002})


@named(
    "access_comparison",
    """with a as (select source as variant, sum(n_chars)::bigint as bytes from documents where doc_id % 3 <> 0 group by 1),
    b as (select source || '_frame_access' as variant, sum(n_chars)::bigint as bytes from documents where doc_id % 3 = 0 group by 1)
    select a.variant, a.bytes, b.bytes as counterpart from a join b on a.variant = regexp_replace(b.variant, '_frame_access$', '')""",
)
def access_comparison(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    plain = docs.where("doc_id % 3 <> 0").groupBy(F.col("source").alias("variant")).agg(F.sum("n_chars").alias("bytes"))
    framed = docs.where("doc_id % 3 = 0").groupBy(F.concat("source", F.lit("_frame_access")).alias("variant")).agg(F.sum("n_chars").alias("bytes"))
    return ledger.paired_by_suffix(plain, framed, "variant", "_frame_access", "bytes")


@named(
    "two_prefix_join",
    f"""with q as (select o_orderpriority as variant, o_orderstatus as st, count(*)::bigint as views, {s("avg(o_totalprice)", "loss")} from orders group by 1, 2)
    select a.variant, a.views as q0_views, a.loss as q0_loss, b.views as q1_views, b.loss as q1_loss from q a join q b using (variant) where a.st = 'F' and b.st = 'O'""",
)
def two_prefix_join(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("variant"), "o_orderstatus").agg(F.count("*").alias("views"), snap(F.avg("o_totalprice")).alias("loss"))
    return ledger.side_by_side(q.where("o_orderstatus = 'F'").drop("o_orderstatus"), q.where("o_orderstatus = 'O'").drop("o_orderstatus"), "variant", ("q0_", "q1_"))


@named(
    "sequential_access_cost",
    """with t as (select event_type as variant, event_id // 500 as frame, user_id as file, 100 + user_id as size from events),
    f as (select variant, file, min(frame) as frame, any_value(size) as size from t group by 1, 2), n as (select variant, frame, sum(size)::bigint as b from f group by 1, 2)
    select variant, frame, coalesce(b, 0)::bigint as new_bytes, sum(coalesce(b, 0)) over (partition by variant order by frame)::bigint as cumulative_bytes
    from (select distinct variant, frame from t) left join n using (variant, frame)""",
)
def sequential_access_cost(spark: SparkSession, sf: str) -> DataFrame:
    touches = table(spark, sf, "events").selectExpr("event_type as variant", "event_id div 500 as frame", "user_id as file", "100 + user_id as size")
    return ledger.sequential_cost(touches, "variant", "frame", "file", "size")


@named(
    "frame_averages",
    f"""select l_suppkey as variant, l_linenumber as frame, {s("avg(l_quantity)", "quantity")}, {s("avg(l_discount)", "discount")}, {s("max(l_tax)", "worst")}, {s("quantile_cont(l_discount, 0.95)", "p95")}
    from lineitem group by 1, 2""",
)
def frame_averages(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("variant"), F.col("l_linenumber").alias("frame"))
    return rows.agg(snap(F.avg("l_quantity")).alias("quantity"), snap(F.avg("l_discount")).alias("discount"), snap(F.max("l_tax")).alias("worst"), snap(F.percentile("l_discount", 0.95)).alias("p95"))


@named(
    "stream_pooling",
    """with p as (select sha256(text) as h, any_value(octet_length(encode(text))) as one, sum(octet_length(encode(text))) as total, count(*) as n from documents group by 1)
    select sum(total)::bigint as logical_bytes, sum(one)::bigint as physical_bytes, sum(n)::bigint as streams, count(*)::bigint as contents from p""",
)
def stream_pooling(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("bigint").alias("size"))
    return ledger.pooled(docs, "digest", "size")


@named(
    "merged_runs",
    """select 'Q0' as prefix, o_orderpriority as variant, count(*)::bigint as views from orders where o_orderstatus = 'F' group by 2
    union all select 'Q1', o_orderpriority, count(*)::bigint from orders where o_orderstatus = 'O' group by 2""",
)
def merged_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").where("o_orderstatus in ('F', 'O')")
    prefix = F.when(F.col("o_orderstatus") == "F", "Q0").otherwise("Q1")
    return rows.groupBy(prefix.alias("prefix"), F.col("o_orderpriority").alias("variant")).agg(F.count("*").alias("views"))
