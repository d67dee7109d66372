"""Graph, package, lineage and report queries; parts stand for payloads, conversations for payload chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.columns import matrix_quaternion, rotation_matrix, unit, vector
from pointloom.operators import checks, coding, graph, jobs, packaging, profile
from pointloom.plans.named import named
from pointloom.session import table

_M = "m as (select conv_id, turn, strlen(text)::bigint as bytes from conversations)"
# Every part needs the parts of half and of a third of its number: a graph full of diamonds.
_HALVES = "e as (select distinct p_partkey as id, unnest([p_partkey // 2, p_partkey // 3]) as parent from part), d as (select id, parent from e where parent > 0)"


def _members(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.octet_length("text").cast("bigint").alias("bytes"))


def _halves(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return parts.select("id", F.explode(F.array(F.floor(F.col("id") / 2), F.floor(F.col("id") / 3))).alias("parent")).where("parent > 0")


@named(
    "diamond_access",
    f"""with recursive {_HALVES}, c as (select p_partkey as node, p_partkey as needs from part union select c.node, d.parent from c join d on d.id = c.needs)
    select node, count(*) as payloads, sum(p_size)::bigint as payload_size from c join part on p_partkey = needs group by 1""",
)
def diamond_access(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size")
    reach = graph.closure(parts, _halves(spark, sf))
    return reach.join(parts.withColumnRenamed("id", "needs"), "needs").groupBy("node").agg(F.count("*").alias("payloads"), F.sum("p_size").cast("bigint").alias("payload_size"))


@named(
    "dependency_cycles",
    """with recursive e as (select p_partkey as id, case when p_partkey % 50 = 7 then p_partkey + 3 when p_partkey % 10 > 0 then p_partkey - 1 end as parent from part),
    d as (select * from e where parent is not null), c as (select id as node, parent as needs from d union select c.node, d.parent from c join d on d.id = c.needs),
    loops as (select distinct node from c where node = needs) select distinct c.node as id from c where needs in (select node from loops)""",
)
def dependency_cycles(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    parent = F.when(key % 50 == 7, key + 3).when(key % 10 > 0, key - 1)
    return graph.cyclic(table(spark, sf, "part").select(key.alias("id"), parent.alias("parent")).where("parent is not null"))


@named(
    "graph_violations",
    f"""with recursive {_M}, n as (select conv_id * 100 + turn as id, conv_id from m where (conv_id + turn) % 13 <> 5), e as (select conv_id * 100 + turn as id, conv_id * 100 + turn - case when (conv_id + turn) % 17 = 3 then 100 else 1 end as parent from m where turn > 0 and (conv_id + turn) % 13 <> 5
      union all select id, id - 2 from n where id % 100 = 5 union all select id, id + 1 from n where id % 100 = 1 and conv_id % 9 = 2 and id + 1 in (select id from n)),
    pairs as (select e.id, e.parent, n.conv_id as own, p.conv_id as other from e join n on n.id = e.id left join n p on p.id = e.parent),
    c as (select distinct id as node, parent as needs from e union select c.node, e.parent from c join e on e.id = c.needs), loops as (select distinct node from c where node = needs)
    select distinct id, 'missing_parent' as rule from pairs where other is null union all select distinct id, 'other_frame' from pairs where other <> own
    union all select id, 'many_parents' from e group by 1 having count(distinct parent) > 1 union all select distinct node, 'cycle' from c where needs in (select node from loops) or node in (select node from loops)""",
)
def graph_violations(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "conversations").where("(conv_id + turn) % 13 <> 5").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "conv_id", "turn")
    first = nodes.where("turn > 0").select("id", (F.col("id") - F.when((F.col("conv_id") + F.col("turn")) % 17 == 3, 100).otherwise(1)).alias("parent"))
    back = nodes.where("turn = 1 and conv_id % 9 = 2").select("id", (F.col("id") + 1).alias("parent")).join(nodes.select(F.col("id").alias("parent")), "parent").select("id", "parent")
    edges = first.union(nodes.where("turn = 5").select("id", F.col("id") - 2)).union(back)
    return graph.violations(nodes, edges, "conv_id")


@named("predictor_chain", f"with {_M} select conv_id, turn, len(range(turn // 6 * 6, turn + 1)) as links, list_sum(range(turn // 6 * 6, turn + 1))::bigint as chain from m")
def predictor_chain(spark: SparkSession, sf: str) -> DataFrame:
    chain = graph.predictors(F.col("turn"), 6)
    return _members(spark, sf).select("conv_id", "turn", F.size(chain).cast("bigint").alias("links"), F.aggregate(chain, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("chain"))


@named(
    "package_violations",
    f"""with {_M}, o as (select conv_id, turn, case when (conv_id * 7 + turn) % 23 = 4 then 0 else bytes end as bytes, turn // 4 + case when (conv_id + turn * 3) % 29 = 1 then 1 else 0 end as gof from m),
    t as (select *, coalesce(sum(bytes) over (partition by conv_id, turn // 4 order by turn rows between unbounded preceding and 1 preceding), 0) + case when (conv_id + turn) % 19 = 2 then 8 else 0 end as "offset" from o),
    b as (select *, coalesce(sum(bytes) over (partition by conv_id, gof order by turn rows between unbounded preceding and 1 preceding), 0) as before, count(*) over (partition by conv_id, turn) as times from t)
    select conv_id, turn, 'size' as rule from b where bytes <= 0 union all select conv_id, turn, 'repeated' from b where times > 1 union all select conv_id, turn, 'offset' from b where "offset" <> before
    union all select conv_id, turn, 'group' from b where gof <> turn // 4""",
)
def package_violations(spark: SparkSession, sf: str) -> DataFrame:
    m = _members(spark, sf).withColumn("bytes", F.when((F.col("conv_id") * 7 + F.col("turn")) % 23 == 4, 0).otherwise(F.col("bytes")))
    right = packaging.offsets(m.withColumn("group", F.floor(F.col("turn") / 4)), ["conv_id", "group"], "turn", "bytes")
    wrong = right.select("conv_id", "turn", "bytes", (F.col("group") + ((F.col("conv_id") + F.col("turn") * 3) % 29 == 1).cast("int")).alias("gof"), (F.col("offset") + 8 * ((F.col("conv_id") + F.col("turn")) % 19 == 2).cast("int")).alias("offset"))
    return checks.package_violations(wrong, ["conv_id"], "turn", "bytes", "offset", "gof", 4)


@named(
    "representation_violations",
    f"""with {_M}, p as (select conv_id, sum(bytes)::bigint as found from m where turn <> 3 group by 1), t as (select conv_id, sum(bytes)::bigint as stated from m group by 1)
    select coalesce(p.conv_id, t.conv_id) as conv_id, coalesce(found, 0) as found, coalesce(stated, 0) as stated from p full join t on p.conv_id = t.conv_id where found is distinct from stated""",
)
def representation_violations(spark: SparkSession, sf: str) -> DataFrame:
    m = _members(spark, sf)
    return checks.representation_violations(m.where("turn <> 3"), m.groupBy("conv_id").agg(F.sum("bytes").alias("total")), ["conv_id"], "bytes", "total")


@named(
    "lineage_mismatches",
    """select 'price' as attribute, sum((o_orderkey % 5 = 0)::int)::bigint as mismatches from orders union all select 'customer', sum((o_orderkey % 5 = 0 or o_orderkey % 7 = 1)::int)::bigint from orders""",
)
def lineage_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"))
    child = rows.where("row % 5 <> 0").withColumn("customer", F.when(F.col("row") % 7 == 1, F.col("customer") + 1).otherwise(F.col("customer")))
    return checks.lineage_mismatches(rows, child, "row", ["price", "customer"])


@named("report_counts", "select o_orderpriority as variant, o_orderstatus as view, count(*) as found from orders group by 1, 2 having count(*) <> 80")
def report_counts(spark: SparkSession, sf: str) -> DataFrame:
    return checks.uneven(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("variant"), F.col("o_orderstatus").alias("view")), ["variant", "view"], 80)


@named("temporal_rejections", f"with {_M}, p as (select conv_id * 100 + turn as id, turn // 2 as frame, conv_id * 100 + turn - 1 as parent from m) select p.id, p.parent from p join p q on q.id = p.parent where q.frame <> p.frame")
def temporal_rejections(spark: SparkSession, sf: str) -> DataFrame:
    id_ = F.col("conv_id") * 100 + F.col("turn")
    payloads = _members(spark, sf).select(id_.alias("id"), F.floor(F.col("turn") / 2).alias("frame"), (id_ - 1).alias("parent"))
    return checks.temporal_rejections(payloads, "id", "frame", "parent")


@named(
    "index_decode",
    """with x as (select p_partkey, ['dense', 'ids', 'complement', 'mask'][p_partkey % 4 + 1] as kind, (p_partkey % 40)::bigint as n from part),
    y as (select *, case kind when 'dense' then range(n) when 'ids' then list_filter(range(n), lambda i: i % 3 = 1) when 'complement' then list_filter(range(n), lambda i: i % 3 <> 1) else list_filter(range(n), lambda i: ((p_partkey * 37 + (i // 8) * 11) % 256) // pow(2, i % 8)::int % 2 = 1) end as ids from x)
    select p_partkey, kind, len(ids)::bigint as rows, coalesce(list_sum(ids), 0)::bigint as checksum from y""",
)
def index_decode(spark: SparkSession, sf: str) -> DataFrame:
    key, n = F.col("p_partkey"), (F.col("p_partkey") % 40).cast("bigint")
    every = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
    kind = F.element_at(F.array(*map(F.lit, ("dense", "ids", "complement", "mask"))), (key % 4 + 1).cast("int"))
    mask = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda b: ((key * 37 + b * 11) % 256).cast("int"))
    own = table(spark, sf, "part").select("p_partkey", kind.alias("kind"), n.alias("n"), F.filter(every, lambda i: i % 3 == 1).alias("ids"), mask.alias("mask"))
    out = own.select("p_partkey", "kind", checks.decoded_index(F.col("kind"), F.col("n"), F.col("ids"), F.col("mask")).alias("rows"))
    return out.select("p_partkey", "kind", F.size("rows").cast("bigint").alias("rows"), F.aggregate("rows", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("checksum"))


@named("missing_qualities", "with f as (select distinct user_id as view, event_type as quality from events), q as (select distinct event_type as quality from events where event_type in ('click', 'view', 'purchase')) select v.view, q.quality from (select distinct view from f where quality in ('click', 'view', 'purchase')) v, (values ('click'), ('view'), ('purchase')) q(quality) where (v.view, q.quality) not in (select view, quality from f)")
def missing_qualities(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "events").select(F.col("user_id").alias("view"), F.col("event_type").alias("quality"))
    return profile.missing_qualities(facts, ["view"], "quality", ["click", "view", "purchase"])


@named("training_report", "select l_returnflag as split, count(*) as cameras, round(avg(l_discount), 9) as l1, round(avg(l_quantity), 9) as psnr from lineitem where l_linenumber % 5 = 0 group by 1")
def training_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("split"), F.col("l_discount").alias("l1"), F.col("l_quantity").alias("psnr"))
    out = jobs.training_report(rows, "n", "split", ["l1", "psnr"], 5)
    return out.withColumns({c: F.round(c, 9) for c in ("l1", "psnr")})


@named("train_plan", "select res::int as resolution, model, split, n_nationkey as frame from nation, (values (480), (720)) r(res), (values ('base'), ('layered')) m(model), (values ('train'), ('test')) s(split)")
def train_plan(spark: SparkSession, sf: str) -> DataFrame:
    frames = table(spark, sf, "nation").select(F.col("n_nationkey").alias("frame"))
    return packaging.sample_grid(frames, {"resolution": [480, 720], "model": ["base", "layered"], "split": ["train", "test"]}).select("resolution", "model", "split", "frame")


@named(
    "manifest_commands",
    """with c as (select c_nationkey as frame, c_custkey % 3 as level, min(c_name) as command from customer where c_custkey % 4 = 0 group by 1, 2)
    select n_nationkey as frame, l::bigint as level, coalesce(command, '{}') as command from nation cross join range(3) r(l) left join c on c.frame = n_nationkey and c.level = l""",
)
def manifest_commands(spark: SparkSession, sf: str) -> DataFrame:
    tasks = packaging.sample_grid(table(spark, sf, "nation").select(F.col("n_nationkey").alias("frame")), {"level": [0, 1, 2]}).withColumn("level", F.col("level").cast("bigint"))
    commands = table(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.col("c_nationkey").alias("frame"), (F.col("c_custkey") % 3).alias("level"), F.col("c_name").alias("command"))
    return jobs.with_commands(tasks, commands, ["frame", "level"], "command", "{}")


@named("task_plan", "select o_orderkey as task, case when o_orderkey % 3 = 0 and o_orderstatus = 'F' then 'skip' when o_orderkey % 3 = 0 then 'again' else 'run' end as action from orders")
def task_plan(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task"), F.col("o_orderstatus").alias("hash"))
    journal = orders.where("task % 3 = 0").withColumn("hash", F.lit("F"))
    return jobs.planned(orders, journal, "task", "hash")


@named("stage_status", "select o_orderpriority as stage, count(*) as tasks, count(*) filter (o_orderstatus = 'F') as completed, case when count(*) = count(*) filter (o_orderstatus = 'F') then 'completed' when count(*) filter (o_orderstatus = 'P') > 0 then 'failed' else 'running' end as status from orders group by 1")
def stage_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("state"))
    return jobs.stage_status(rows, "stage", "state", "F", "P")


@named("payload_order", f"with {_M} select conv_id, turn, row_number() over (partition by conv_id order by turn % 2, 3 - turn % 4, turn) as place from m")
def payload_order(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.ordered(_members(spark, sf).withColumns({"mode": F.col("turn") % 2, "quality": 3 - F.col("turn") % 4}), ["conv_id"], ["mode", "quality", "turn"], "place").select("conv_id", "turn", "place")


@named("attributes_by_bytes", "select l_returnflag as attribute, sum(l_quantity)::double as bytes, row_number() over (order by sum(l_quantity) desc, l_returnflag) as place from lineitem group by 1")
def attributes_by_bytes(spark: SparkSession, sf: str) -> DataFrame:
    sums = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("attribute")).agg(F.sum("l_quantity").cast("double").alias("bytes"))
    return jobs.ordered(sums, [], [F.desc("bytes"), "attribute"], "place")


@named("first_files", "select c_nationkey as folder, c_name as name from customer qualify row_number() over (partition by c_nationkey order by c_name) <= 5")
def first_files(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "customer").select(F.col("c_nationkey").alias("folder"), F.col("c_name").alias("name"))
    return jobs.ordered(files, ["folder"], ["name"], "_n").where("_n <= 5").drop("_n")


@named("quaternion_roundtrip", "select vec_id, true as same from embeddings")
def quaternion_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    x = vector(F.col("embedding"), 12)
    q = unit([F.col(f"q{k}") for k in range(4)])
    rows = table(spark, sf, "embeddings").select("vec_id", *(x[3 + k].alias(f"q{k}") for k in range(4)))
    rows = rows.select("vec_id", *(c.alias(f"u{k}") for k, c in enumerate(q)))
    u = [F.col(f"u{k}") for k in range(4)]
    back = matrix_quaternion(rotation_matrix(u))
    agree = F.abs(sum((a * b for a, b in zip(u, back)), F.lit(0.0)))
    return rows.select("vec_id", ((agree > 1 - 1e-9) & (back[0] >= 0)).alias("same"))


@named("frame_labels", f"with {_M} select conv_id, turn, 'xyz_frame' || turn as stream, 'xyz' as attribute, turn % 3 = 0 as stable from m")
def frame_labels(spark: SparkSession, sf: str) -> DataFrame:
    return coding.labelled(_members(spark, sf), "turn", "xyz", F.col("turn") % 3 == 0).select("conv_id", "turn", "stream", "attribute", "stable")


@named("profile_document", """select '{"version":1,"samples":' || count(*) || ',"qualities":' || count(distinct l_returnflag) || '}' as document from lineitem""")
def profile_document(spark: SparkSession, sf: str) -> DataFrame:
    return profile.document(table(spark, sf, "lineitem"), "l_returnflag")
