"""Packaging queries: conversations stand for payload chains, each turn needing the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators import graph, packaging
from pointloom.plans.named import named
from pointloom.session import table

_M = "m as (select conv_id, turn, strlen(text)::bigint as bytes from conversations)"


def _members(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.octet_length("text").cast("bigint").alias("bytes"))


@named("frame_records", """select frame::int as frame, ((frame - 1051) // 2)::int as position, (frame - 1051) / 30.0::double as timestamp from range(1051, 1062, 2) r(frame)""")
def frame_records(spark: SparkSession, sf: str) -> DataFrame:
    return packaging.frame_records(spark, 1051, 1061, 2, 30.0)


@named(
    "sample_grid",
    """select frame::int as frame, (frame - 1)::int as position, (frame - 1) / 10.0::double as timestamp, a.x::double as azimuth, e.x::double as elevation, s.x::double as scale
    from range(1, 4) r(frame), (values (-45), (45)) a(x), (values (0), (30)) e(x), (values (1), (2)) s(x)""",
)
def sample_grid(spark: SparkSession, sf: str) -> DataFrame:
    return packaging.sample_grid(packaging.frame_records(spark, 1, 3, 1, 10.0), {"azimuth": [-45.0, 45.0], "elevation": [0.0, 30.0], "scale": [1.0, 2.0]})


@named(
    "gof_windows",
    f"with {_M} select conv_id, turn // 4 as gof, min(turn) as first, max(turn) as last, count(*) as members, sum(bytes)::bigint as bytes from m group by 1, 2",
)
def gof_windows(spark: SparkSession, sf: str) -> DataFrame:
    return packaging.groups_of_frames(_members(spark, sf), ["conv_id"], "turn", "bytes", 4)


@named("refresh_flags", f"with {_M} select conv_id, turn, bytes, turn % 4 % 2 = 0 as is_refresh, turn % 4 = 0 as is_reset from m")
def refresh_flags(spark: SparkSession, sf: str) -> DataFrame:
    return packaging.refresh_flags(_members(spark, sf), "turn", 4, 2)


@named(
    "segment_boundaries",
    f"""with {_M}, c as (select conv_id, turn, bytes, turn // 4 as gof, (turn % 4 = 0 or turn % 4 % 2 = 0 or turn % 4 % 3 = 0)::int as cut from m)
    select conv_id, turn, bytes, gof, (sum(cut) over (partition by conv_id, gof order by turn) - 1)::bigint as segment from c""",
)
def segment_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return packaging.segments(_members(spark, sf), ["conv_id"], "turn", 4, 3, 2)


@named(
    "segment_offsets",
    f"""with {_M}, c as (select conv_id, turn, bytes, turn // 4 as gof, (turn % 4 = 0 or turn % 4 % 2 = 0 or turn % 4 % 3 = 0)::int as cut from m),
    g as (select *, (sum(cut) over (partition by conv_id, gof order by turn) - 1)::bigint as segment from c)
    select conv_id, turn, bytes, gof, segment, coalesce(sum(bytes) over (partition by conv_id, gof, segment order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from g""",
)
def segment_offsets(spark: SparkSession, sf: str) -> DataFrame:
    cut = packaging.segments(_members(spark, sf), ["conv_id"], "turn", 4, 3, 2)
    return packaging.offsets(cut, ["conv_id", "gof", "segment"], "turn", "bytes")


@named(
    "cold_access",
    f"""with recursive {_M}, e as (select conv_id * 100 + turn as id, conv_id * 100 + turn - 1 as parent from m where turn % 4 > 0),
    c(node, needs, depth) as (select conv_id * 100 + turn, conv_id * 100 + turn, 0 from m union all select c.node, e.parent, c.depth + 1 from c join e on e.id = c.needs)
    select c.node, count(*) as payloads, sum(bytes)::bigint as payload_bytes, max(depth)::int as depth from c join m on m.conv_id * 100 + m.turn = c.needs group by 1""",
)
def cold_access(spark: SparkSession, sf: str) -> DataFrame:
    members = _members(spark, sf).withColumn("id", F.col("conv_id") * 100 + F.col("turn"))
    edges = members.where("turn % 4 > 0").select("id", (F.col("id") - 1).alias("parent"))
    reach = graph.closure(members, edges)
    return reach.join(members.select(F.col("id").alias("needs"), "bytes"), "needs").groupBy("node").agg(F.count("*").alias("payloads"), F.sum("bytes").alias("payload_bytes"), F.max("depth").alias("depth"))


@named(
    "distinct_segment_access",
    f"""with {_M}, s as (select conv_id, turn // 2 as segment, sum(bytes)::bigint as bytes from m group by 1, 2)
    select m.conv_id, m.turn, count(*) as segments, sum(s.bytes)::bigint as request_bytes from m join s on s.conv_id = m.conv_id and s.segment between m.turn // 4 * 2 and m.turn // 2 group by 1, 2""",
)
def distinct_segment_access(spark: SparkSession, sf: str) -> DataFrame:
    members = _members(spark, sf)
    sizes = members.groupBy("conv_id", F.floor(F.col("turn") / 2).alias("segment")).agg(F.sum("bytes").alias("bytes"))
    # A member needs the segments from its group's start to its own.
    needed = members.select("conv_id", "turn", F.explode(F.sequence(F.floor(F.col("turn") / 4) * 2, F.floor(F.col("turn") / 2))).alias("segment"))
    return needed.join(sizes, ["conv_id", "segment"]).groupBy("conv_id", "turn").agg(F.count("*").alias("segments"), F.sum("bytes").alias("request_bytes"))


@named(
    "dependency_depth",
    f"""with {_M} select conv_id, turn, bytes, sum(bytes) over w::bigint as cold_bytes, count(*) over w - 1 as depth from m window w as (partition by conv_id, turn // 4 order by turn)""",
)
def dependency_depth(spark: SparkSession, sf: str) -> DataFrame:
    return packaging.running_closure(_members(spark, sf), ["conv_id"], "turn", "bytes", 4)


@named(
    "dependency_violations",
    f"""with {_M}, n as (select conv_id * 100 + turn as id, turn from m where (conv_id + turn) % 13 <> 5) select id, id - 1 as parent from n where turn % 4 > 0 and id - 1 not in (select id from n)""",
)
def dependency_violations(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "conversations").where("(conv_id + turn) % 13 <> 5").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "turn")
    return packaging.missing_references(nodes, nodes.where("turn % 4 > 0").select("id", (F.col("id") - 1).alias("parent"))).select("id", "parent")


@named(
    "coverage_check",
    """with x as (select distinct user_id % 50 as object, event_type as quality from events where (user_id % 50 + length(event_type)) % 11 <> 3),
    e as (select * from (select distinct user_id % 50 as object from events), (select distinct event_type as quality from events))
    select object, quality, 'actual' as lacking from (select * from e except select * from x) union all select object, quality, 'expected' from (select * from x except select * from e)""",
)
def coverage_check(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", (F.col("user_id") % 50).alias("object"), F.col("event_type").alias("quality"))
    expected = events.select("object").distinct().crossJoin(F.broadcast(events.select("quality").distinct()))
    actual = events.where("(object + length(quality)) % 11 <> 3").select("object", "quality")
    return packaging.coverage_gaps(expected, actual)


@named(
    "refresh_intervals",
    """select c_custkey, coalesce(case c_mktsegment when 'BUILDING' then 2 when 'MACHINERY' then 8 end, case c_nationkey % 3 when 0 then 4 end, 3)::int as interval from customer""",
)
def refresh_intervals(spark: SparkSession, sf: str) -> DataFrame:
    settings = F.create_map(*(F.lit(x) for x in ("BUILDING", 2, "MACHINERY", 8, "0", 4, "default", 3)))
    customer = table(spark, sf, "customer")
    interval = packaging.refresh_interval(settings, F.col("c_mktsegment"), (F.col("c_nationkey") % 3).cast("string"), F.lit("none"))
    return customer.select("c_custkey", interval.alias("interval"))
