"""Queries of code checks, evaluations and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figmill.functions import code, jsonx
from figmill.operators import evaluation as E
from figmill.operators.ordered import indexed
from figmill.plans.registry import query
from figmill.sources.tables import Stage, table


#: What lines of Python plotting code have; prose that has it by chance only adds rows.
_CODE = r"(?m)^\s*(?:import |from [\w.]+ import |def )|\b(?:ax|plt)\.\w|\bfig\.savefig"


def _codes(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, code and whether it looks like code, of each document text, wherever it was found.

    A text found as code is code as it stands, whatever it looks like; of others it is the code in them.
    """
    as_code = F.col("section").eqNullSafe("code")
    docs = table(spark, d, "documents").where("text is not null").withColumn("c", jsonx.code_in(F.col("text")))
    return docs.select("doc_id", F.when(as_code, F.col("text")).otherwise(F.col("c.code")).alias("text"), (as_code | (F.col("c.strategy") != "plain") | F.col("text").rlike(_CODE)).alias("coded"))


@query()
def code_compiles(spark: SparkSession, d: str) -> DataFrame:
    """Whether the code in each document text is Python; nothing is run."""
    return _codes(spark, d).select("doc_id", code.syntax_error("text").alias("e")).select("doc_id", F.col("e.error").alias("error"))


@query()
def code_similarity(spark: SparkSession, d: str) -> DataFrame:
    """How alike each code is to the one before it by id; texts without code are not compared."""
    docs = Stage(_codes(spark, d).where("coded").select("doc_id", "text")).df
    placed = Stage(indexed(docs, ["doc_id"], "place")).df
    before = placed.select((F.col("place") + 1).alias("place"), F.col("text").alias("before"))
    return placed.join(before, "place").select("doc_id", code.code_similarity("before", "text").alias("similarity"))


@query("select count(*) n, count(distinct row(panel_id, caption)) signatures from samples where panel_id is not null and caption is not null")
def cached_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Rows and distinct inputs of an evaluation of which the first half is kept from an earlier run."""
    s = table(spark, d, "samples").where("panel_id is not null and caption is not null").select("panel_id", "caption")
    kept = E.evaluated(s.where(F.pmod(F.hash("panel_id"), F.lit(2)) == 0), ["panel_id", "caption"], "mock", "r")
    done = E.evaluated(s, ["panel_id", "caption"], "mock", "r", kept)
    return E.signed(s, ["panel_id", "caption"], "r").join(done, "signature").agg(F.count("*").alias("n"), F.count_distinct("signature").alias("signatures"))


@query("select c_custkey, (select min(o.c_custkey) from customer o where o.c_nationkey = c.c_nationkey and o.c_custkey <> c.c_custkey) exemplar from customer c")
def exemplars(spark: SparkSession, d: str) -> DataFrame:
    return E.exemplars(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey").select("c_custkey", "exemplar")


@query("select category, count(*) filter (short_reason is not null) complete, count(*) filter (short_reason is not null and has_foreign_overlap) problems, round(count(*) filter (short_reason is not null and has_foreign_overlap) / nullif(count(*) filter (short_reason is not null), 0), 6) rate from qwen_panel_scoring group by 1")
def problem_rates(spark: SparkSession, d: str) -> DataFrame:
    out = E.problem_rates(table(spark, d, "qwen_panel_scoring"), ["category"], F.col("short_reason").isNotNull(), F.col("has_foreign_overlap"))
    return out.withColumn("rate", F.round("rate", 6))


@query(
    """select panel_id, scored_at, case when not ok then 0 else greatest(0, least(100, a * 10)) end fidelity, round(case when not ok then 0 when a is null and b is null then null
    else (coalesce(greatest(0, least(100, a * 10)), 0) + coalesce(greatest(0, least(100, b * 10)), 0)) / ((a is not null)::int + (b is not null)::int) end, 6) mean_score
    from (select panel_id, scored_at, aesthetic_score a, clarity_integrity_score b, coalesce(is_complete_panel, false) and not coalesce(has_foreign_overlap, false) ok from qwen_panel_scoring)"""
)
def judged_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores that count 0 where a row is not valid, and the mean of those there are."""
    s = table(spark, d, "qwen_panel_scoring")
    valid = F.coalesce("is_complete_panel", F.lit(False)) & ~F.coalesce("has_foreign_overlap", F.lit(False))
    out = E.judged(s, valid, {"fidelity": (F.col("aesthetic_score"), 10.0), "clarity": (F.col("clarity_integrity_score"), 10.0)})
    return out.select("panel_id", "scored_at", "fidelity", F.round("mean_score", 6).alias("mean_score"))
