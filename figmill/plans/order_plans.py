"""Order-dependent operators, dedupes, shards and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figmill.functions.jsonx import stable_hash
from figmill.operators import identifiers, joins, ordered
from figmill.operators.geometry import parsed
from figmill.plans.registry import query
from figmill.sources import manifests
from figmill.sources.tables import table


@query(
    """select o_custkey, o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_custkey order by o_orderpriority desc, o_orderdate desc, o_orderkey desc) k from orders) where k = 1"""
)
def priority_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("run", F.struct("o_orderdate", "o_orderkey"))
    return ordered.by_priority(rows, "o_custkey", "o_orderpriority", "run").select("o_custkey", "o_orderkey", "o_orderpriority")


@query("select paper_id, pmcid, doi, year from (select *, row_number() over (partition by paper_id order by loaded_at desc, pmcid desc nulls last, doi desc nulls last, year desc nulls last) k from papers where paper_id is not null) where k = 1")
def latest_papers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").where("paper_id is not null").select("paper_id", "pmcid", "doi", "year", "loaded_at")
    return joins.one_per_key(p, ["paper_id"], [F.desc("loaded_at"), *[F.desc_nulls_last(c) for c in ("pmcid", "doi", "year")]]).drop("loaded_at")


@query("select doc_id from (select doc_id, row_number() over (order by doc_id) - 1 i from documents) where i % 4 = 1")
def modulo_shard(spark: SparkSession, d: str) -> DataFrame:
    return ordered.shard(table(spark, d, "documents").select("doc_id"), ["doc_id"], 4, 1)


_FIRSTS = "select l_suppkey, min(i) first from rows group by 1"


@query(
    f"""with rows as (select *, row_number() over (order by l_orderkey, l_linenumber) i from lineitem), firsts as ({_FIRSTS})
    select l_orderkey, l_linenumber, l_suppkey from rows where i < coalesce((select first from firsts order by first offset 25 limit 1), 9223372036854775807)"""
)
def prefix_by_distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return ordered.prefix_by_keys(lines, ["l_orderkey", "l_linenumber"], "l_suppkey", 25)


@query("select o_orderkey, o_totalprice, row_number() over (order by o_totalprice, o_orderkey) - 1 place from orders")
def global_place(spark: SparkSession, d: str) -> DataFrame:
    return ordered.indexed(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], "place").withColumn("place", F.col("place").cast("long"))


@query("select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by doc_id) k from documents) where k = 1")
def first_seen(spark: SparkSession, d: str) -> DataFrame:
    return ordered.first_seen(table(spark, d, "documents").select("lang", "doc_id"), "lang", [F.asc("doc_id")])


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, value desc nulls last, event_id desc) k from events) where k = 1")
def latest_artifact(spark: SparkSession, d: str) -> DataFrame:
    return ordered.latest_artifact(table(spark, d, "events"), ["user_id"], "event_id", "ts", "value")


@query("select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 120")
def paged(spark: SparkSession, d: str) -> DataFrame:
    """The first two pages of 60."""
    return ordered.page(table(spark, d, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.asc("p_partkey")], 60, 2)


@query("select * from (select o_orderkey, o_orderstatus from orders where o_orderdate < timestamp '1997-01-01' and o_orderkey not in (select o_orderkey from orders where o_orderpriority like '1%')) union all select o_orderkey, 'new' from orders where o_orderpriority like '1%'")
def upsert_manifest(spark: SparkSession, d: str) -> DataFrame:
    """New rows replace old ones of their key; keys only in either side stay."""
    o = table(spark, d, "orders")
    old = o.where(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")).select("o_orderkey", "o_orderstatus")
    new = o.where(F.col("o_orderpriority").startswith("1")).select("o_orderkey", F.lit("new").alias("o_orderstatus"))
    return joins.upsert(old, new, "o_orderkey")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return joins.unseen(table(spark, d, "customer").select("c_custkey"), orders, "c_custkey")


@query("select s_suppkey, s_name from supplier where s_suppkey in (select l_suppkey from lineitem where l_returnflag = 'R' and l_quantity = 50)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity = 50").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, d, "supplier").join(lines, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


@query(
    """select p.paper_id, p.figure_index, p.panel_label, f.label figure_label, f.caption from panels p left join (
        select * from (select paper_id, f."index" figure_index, f.label, f.caption, row_number() over (partition by paper_id, f."index" order by loaded_at desc, f.label desc nulls last, f.caption desc nulls last) k
            from (select paper_id, loaded_at, unnest(figures) f from papers)) where k = 1) f using (paper_id, figure_index)"""
)
def figure_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Left join of panels with exploded figures; of repeated figures the latest counts."""
    figures = table(spark, d, "papers").select("paper_id", "loaded_at", F.inline("figures")).select("paper_id", F.col("index").alias("figure_index"), F.col("label").alias("figure_label"), "caption", "loaded_at")
    panels = table(spark, d, "panels").select("paper_id", "figure_index", "panel_label")
    order = [F.desc("loaded_at"), F.desc_nulls_last("figure_label"), F.desc_nulls_last("caption")]
    return joins.lookup(panels, figures, ["paper_id", "figure_index"], order).drop("loaded_at")


@query(
    """select c_custkey, case when s.k is not null then s.bal else c_acctbal end c_acctbal, c_mktsegment, s.cnt from customer left join (
        select o_custkey k, count(*) filter (o_orderstatus = 'F') cnt, case when count(*) > 12 then round(max(o_totalprice), 2) end bal from orders group by 1) s on k = c_custkey"""
)
def overlay_join(spark: SparkSession, d: str) -> DataFrame:
    """The right side goes before the left where the key is found, even with null."""
    left = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    right = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("cnt"), F.when(F.count("*") > 12, F.round(F.max("o_totalprice"), 2)).alias("c_acctbal"))
    return joins.overlay(left, right, ["c_custkey"])


_ITEMS = "(select p_partkey id, p_brand paper, p_type kind, p_retailprice score from part)"


@query(
    f"""select id, related_id, rank from (
        select a.id, b.id related_id, row_number() over (partition by a.id order by (coalesce(a.paper = b.paper, false)) desc, b.score desc, b.id) rank
        from {_ITEMS} a join {_ITEMS} b on a.id <> b.id and (a.paper = b.paper or a.kind = b.kind)) where rank <= 6"""
)
def related_items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("paper"), F.col("p_type").alias("kind"), F.col("p_retailprice").alias("score"))
    return joins.related(items, "id", "paper", "kind", "score", 6).withColumn("rank", F.col("rank").cast("long"))


@query("select n_name model, r_name mode, case when n_regionkey = r_regionkey then 'own' else 'other' end status from nation, region")
def matrix(spark: SparkSession, d: str) -> DataFrame:
    pairs = joins.matrix(table(spark, d, "nation"), table(spark, d, "region"))
    return pairs.select(F.col("n_name").alias("model"), F.col("r_name").alias("mode"), F.when(F.col("n_regionkey") == F.col("r_regionkey"), "own").otherwise("other").alias("status"))


@query(
    """select c.nation, c.c_custkey, s.s_suppkey from (select c_nationkey nation, c_custkey, row_number() over (partition by c_nationkey order by c_acctbal, c_custkey) k from customer) c
    join (select s_nationkey nation, s_suppkey, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) k from supplier) s using (nation, k)"""
)
def zip_join(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal")
    right = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    out = joins.zip_in_order(left, right, ["nation"], [F.asc("c_acctbal"), F.asc("c_custkey")], [F.desc("s_acctbal"), F.asc("s_suppkey")])
    return out.select("nation", "c_custkey", "s_suppkey")


_MARKS = """(select distinct paper_id, figure_index, b[1] x0, b[2] y0, b[3] x1, b[4] y1 from (select *, from_json(nullif(bbox_xyxy, ''), '["INTEGER"]') b from panels) where len(b) = 4)"""


@query(
    f"""select paper_id, figure_index, x0, y0, x1, y1, ox, oy from (select p.*, o.x0 ox, o.y0 oy, row_number() over (partition by p.paper_id, p.figure_index, p.x0, p.y0, p.x1, p.y1
        order by abs(p.x0 - o.x0) * 0.65 + abs(p.y0 - o.y0), o.x0, o.y0) k from {_MARKS} p join (select distinct paper_id, figure_index, x0, y0 from {_MARKS}) o on o.paper_id = p.paper_id and o.figure_index = p.figure_index
        where (o.x0, o.y0) <> (p.x0, p.y0) and abs(p.x0 - o.x0) * 0.65 + abs(p.y0 - o.y0) <= 400) where k = 1"""
)
def cost_argmin(spark: SparkSession, d: str) -> DataFrame:
    """For each box the other corner of its figure of least cost; a cost too high is no match."""
    b = table(spark, d, "panels").select("paper_id", "figure_index", parsed(F.col("bbox_xyxy")).alias("b")).where("b is not null and paper_id is not null and figure_index is not null")
    boxes = b.select("paper_id", "figure_index", *[F.col("b")[i].cast("int").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]).distinct()
    corners = boxes.select("paper_id", "figure_index", F.col("x0").alias("ox"), F.col("y0").alias("oy")).distinct()
    gap = F.abs(F.col("x0") - F.col("ox")) * 0.65 + F.abs(F.col("y0") - F.col("oy"))
    other = (F.col("ox") != F.col("x0")) | (F.col("oy") != F.col("y0"))
    points = boxes.withColumn("box", F.struct("x0", "y0", "x1", "y1"))
    out = joins.nearest_in_group(points, corners, ["paper_id", "figure_index"], "box", F.when(other & (gap <= 400), gap), [F.asc("ox"), F.asc("oy")])
    return out.drop("box", "cost")


@query("select event_type, count(*) added from (select distinct event_type, user_id from events where ts >= timestamp '2024-01-15' except select event_type, user_id from events where ts < timestamp '2024-01-15') group by 1")
def state_union(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers new to a state, counted by kind."""
    e = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("identifier"), "ts")
    before, after = e.where("ts < timestamp '2024-01-15'"), e.where("ts >= timestamp '2024-01-15'")
    return identifiers.merged(before.select("kind", "identifier").distinct(), after.select("kind", "identifier"))[1].withColumnRenamed("kind", "event_type")


@query("select a.panel_id, count(*) changed from (select distinct panel_id, subject, subtype from samples) a group by 1 having count(*) > 1")
def changed_records(spark: SparkSession, d: str) -> DataFrame:
    """Records exported with differing contents, found by hashes of their contents."""
    s = table(spark, d, "samples").select("panel_id", stable_hash(F.col("subject"), F.col("subtype")).alias("signature")).distinct()
    return s.groupBy("panel_id").agg(F.count("*").alias("changed")).where("changed > 1")


@query("select doc_id, sha256(text) signature from documents where text is not null")
def text_signatures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("signature"))


@query("select subject, topic, max(run) run from (select regexp_extract(relative_path, '([^/]+)/([^/]+)/(run_[^/]+)', 1) subject, regexp_extract(relative_path, '([^/]+)/([^/]+)/(run_[^/]+)', 2) topic, regexp_extract(relative_path, '([^/]+)/([^/]+)/(run_[^/]+)', 3) run from panels) where run <> '' group by 1, 2")
def newest_runs(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "panels").select(manifests.run_parts(F.col("relative_path")).alias("p")).select("p.*").where("run is not null")
    return ordered.newest(parts, ["subject", "topic"], "run")
