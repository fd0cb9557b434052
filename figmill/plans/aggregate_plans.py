"""Statistics, breakdowns, histograms and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from figmill.operators import aggregates as A
from figmill.plans.registry import query
from figmill.sources.tables import table

DIGITS = 6


def _rounded(columns: list[Column], names: list[str]) -> list[Column]:
    """Floats rounded, as the order of a sum changes their last bits."""
    return [F.round(c, DIGITS).alias(n) for c, n in zip(columns, names, strict=True)]


def _group_stats(df: DataFrame, group: list[str], column: str) -> DataFrame:
    out = A.group_stats(df, group, column)
    return out.select(*group, "count", "null_count", *_rounded([F.col(c) for c in ("mean", "median", "std")], ["mean", "median", "std"]))


def _stats_sql(c: str) -> str:
    return f'count({c}) "count", count(*) - count({c}) null_count, round(avg({c}), 6) mean, round(median({c}), 6) median, round(stddev_pop({c}), 6) std'


def _plain(spark: SparkSession, d: str) -> DataFrame:
    """Scores with NaN as null, which means over them need."""
    s = F.col("overall_quality_score")
    return table(spark, d, "qwen_panel_scoring").withColumn("overall_quality_score", F.when(~F.isnan(s), s))


_PLAIN = "(select * replace (case when not isnan(overall_quality_score) then overall_quality_score end as overall_quality_score) from qwen_panel_scoring)"


@query(f"select l_returnflag, {_stats_sql('l_extendedprice')} from lineitem group by 1")
def stats_by_key(spark: SparkSession, d: str) -> DataFrame:
    return _group_stats(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query(f"select category, data_subtype, {_stats_sql('overall_quality_score')} from {_PLAIN} group by 1, 2")
def stats_by_two_keys(spark: SparkSession, d: str) -> DataFrame:
    return _group_stats(_plain(spark, d), ["category", "data_subtype"], "overall_quality_score")


_SETS = [("o_orderpriority",), ("o_orderstatus",), ("c_mktsegment",), ("l_returnflag",), ("l_linestatus",), ("o_orderstatus", "l_returnflag"), ("c_mktsegment", "l_linestatus")]


def _breakdown_sql(keys: tuple[str, ...], source: str, measures: str) -> str:
    label = " || ' / ' || ".join(f"coalesce(nullif({k}::varchar, ''), 'unknown')" for k in keys)
    return f"select '{'_x_'.join(keys)}' breakdown, {label} label, {measures} from {source} group by {label}"


_LINES = "(select * from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)"
_MEASURES = "count(*) rows, round(avg(case when l_returnflag = 'R' then 1.0 else 0.0 end), 6) returned, round(avg(l_discount), 6) discount"


@query(" union all ".join(_breakdown_sql(k, _LINES, _MEASURES) for k in _SETS))
def breakdowns_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Seven breakdowns in one pass."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = lines.select(*sorted({k for s in _SETS for k in s}), "l_discount")
    measures = [F.count("*").alias("rows"), F.round(A.rate(F.col("l_returnflag") == "R"), DIGITS).alias("returned"), F.round(F.avg("l_discount"), DIGITS).alias("discount")]
    return A.breakdowns(lines, _SETS, measures)


_SAMPLE_SETS = [("subject",), ("subtype",), ("complexity_level",), ("subject", "complexity_level"), ("subtype", "complexity_level")]


@query(" union all ".join(_breakdown_sql(k, "samples", "count(*) samples, round(avg(refine_complexity_score), 6) complexity") for k in _SAMPLE_SETS))
def sample_breakdowns(spark: SparkSession, d: str) -> DataFrame:
    return A.breakdowns(table(spark, d, "samples"), _SAMPLE_SETS, [F.count("*").alias("samples"), F.round(F.avg("refine_complexity_score"), DIGITS).alias("complexity")])


@query(f"select {_stats_sql('m')} from (select avg(l_extendedprice) m from lineitem group by l_shipdate)")
def macro_average(spark: SparkSession, d: str) -> DataFrame:
    """Mean of daily means, each day counting once."""
    out = A.macro(table(spark, d, "lineitem"), "l_shipdate", F.col("l_extendedprice"))
    return out.select("count", "null_count", *_rounded([F.col("mean"), F.col("median"), F.col("std")], ["mean", "median", "std"]))


_EDGES = [0.0, 25.0, 35.0, 45.0, 55.0, 65.0, 75.0, 101.0]


def _bins_sql(value: str, source: str, edges: list[float]) -> str:
    bins = ", ".join(f"({a}::double, {b}::double)" for a, b in zip(edges, edges[1:], strict=False))
    return f"select b.low, b.high, count(v) n from (values {bins}) b(low, high) left join (select {value} v from {source} where {value} is not null and not isnan({value}::double)) s on v >= b.low and v < b.high group by 1, 2"


@query(_bins_sql("p_size * 2.5", "part", _EDGES))
def histogram_zero_bins(spark: SparkSession, d: str) -> DataFrame:
    return A.histogram(table(spark, d, "part"), F.col("p_size") * 2.5, _EDGES)


@query(_bins_sql("refine_complexity_score", "samples", [1.0, 3.0, 5.0, 7.0, 9.0, 10.01]))
def complexity_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Scores below the first edge fall in no bin."""
    return A.histogram(table(spark, d, "samples"), F.col("refine_complexity_score"), [1.0, 3.0, 5.0, 7.0, 9.0, 10.01])


def _quantile_sql(c: str) -> str:
    return f"min({c}) min, round(quantile_cont({c}, 0.25), 6) p25, round(quantile_cont({c}, 0.5), 6) median, round(quantile_cont({c}, 0.75), 6) p75, max({c}) max"


@query(f"select l_linestatus, {_quantile_sql('l_quantity')} from lineitem group by 1")
def linear_quantiles(spark: SparkSession, d: str) -> DataFrame:
    points = {"min": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "max": 1.0}
    out = A.group_quantiles(table(spark, d, "lineitem"), ["l_linestatus"], "l_quantity", points)
    return out.select("l_linestatus", "min", *_rounded([F.col(c) for c in ("p25", "median", "p75")], ["p25", "median", "p75"]), "max")


@query(
    """select value, n, row_number() over (order by try_cast(value as double) is null, try_cast(value as double), value) place from (
        select value, count(*) n from (select unnest([event_type, (event_id % 7)::varchar]) value from events) where value is not null and value <> '' group by 1)"""
)
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    """Numbers come first in numeric order, then texts."""
    both = table(spark, d, "events").select(F.explode(F.array("event_type", (F.col("event_id") % 7).cast("string"))).alias("value"))
    return A.value_counts(both, "value").withColumn("place", F.col("place").cast("long"))


@query("select p_brand, count(*) n from part group by 1 order by n desc, p_brand limit 20")
def top_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.top_counts(table(spark, d, "part"), "p_brand", 20)


_CUSTOMERS = "customer join nation on c_nationkey = n_nationkey"


@query(
    f"""select n_name, count(*) customers, count(*) filter (c_acctbal > 0) positive, count(distinct c_mktsegment) segments, round(avg(c_acctbal), 6) balance from {_CUSTOMERS} group by 1"""
)
def group_rollup(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("customers"), F.count_if(F.col("c_acctbal") > 0).alias("positive"), F.count_distinct("c_mktsegment").alias("segments"), F.round(F.avg("c_acctbal"), DIGITS).alias("balance"))


@query(
    """select r_name, n_name, count(*) suppliers, round(min(s_acctbal), 6) low, round(max(s_acctbal), 6) high, (2 - grouping(r_name) - grouping(n_name))::int "level"
    from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup(r_name, n_name)"""
)
def level_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Nation, region and whole in one pass."""
    joined = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return A.levels(joined, ["r_name", "n_name"], [F.count("*").alias("suppliers"), F.round(F.min("s_acctbal"), DIGITS).alias("low"), F.round(F.max("s_acctbal"), DIGITS).alias("high")])


@query("select metric, value, count(*) n from (select unnest(['l_returnflag', 'l_linestatus', 'l_linenumber']) metric, unnest([l_returnflag, l_linestatus, l_linenumber::varchar]) value from lineitem) where value is not null group by 1, 2")
def melt_distributions(spark: SparkSession, d: str) -> DataFrame:
    return A.melt(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query(
    """select journal, count(*) panels, count(distinct paper_id) papers, min(nullif(publication_date, '')) first_date, max(nullif(publication_date, '')) last_date,
    count(*) filter (panel_caption is not null) captioned from panels where coalesce(journal, '') <> '' group by 1"""
)
def journal_summary(spark: SparkSession, d: str) -> DataFrame:
    """Dates are texts that may be partial, so they are compared as texts and empty ones left out."""
    date = F.nullif("publication_date", F.lit(""))
    return table(spark, d, "panels").where(F.coalesce("journal", F.lit("")) != "").groupBy("journal").agg(F.count("*").alias("panels"), F.count_distinct("paper_id").alias("papers"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count("panel_caption").alias("captioned"))


@query(
    """select panel_id, scored_at, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a is not null)::int + (b is not null)::int + (c is not null)::int, 0), 6) mean from (
        select panel_id, scored_at, clarity_integrity_score a, data_purity_score b, aesthetic_score c from qwen_panel_scoring)"""
)
def row_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the scores of a row that are there."""
    s = table(spark, d, "qwen_panel_scoring")
    return s.select("panel_id", "scored_at", F.round(A.row_mean(F.col("clarity_integrity_score"), F.col("data_purity_score"), F.col("aesthetic_score")), DIGITS).alias("mean"))


@query("select count(*) total, round(avg(is_good_quality::int), 6) good, round(avg(case when xy_label_applicable then (xy_label_complete = 'yes')::int end), 6) labelled from qwen_panel_scoring")
def conditional_rates(spark: SparkSession, d: str) -> DataFrame:
    """The second rate is over the rows it applies to only, null if there are none."""
    labelled = F.avg(F.when(F.col("xy_label_applicable"), (F.col("xy_label_complete") == "yes").cast("double")))
    return table(spark, d, "qwen_panel_scoring").agg(F.count("*").alias("total"), F.round(F.avg(F.col("is_good_quality").cast("double")), DIGITS).alias("good"), F.round(labelled, DIGITS).alias("labelled"))
