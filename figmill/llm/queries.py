"""The pN queries over the tables of a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figmill.llm import bpe, caps, common, cutoff, mix, pack, spam, splits, topn
from figmill.sources.tables import Stage, table

PANELS_PER_ARTICLE = 16
TOP = 12
CAPACITY = 2048


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.misplaced(table(spark, d, "samples"), table(spark, d, "panels"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    t = {n: table(spark, d, n) for n in ("panels", "samples", "mix_targets", "split_targets")}
    return splits.article_splits(t["panels"], t["samples"], t["mix_targets"], t["split_targets"])


def p1_split_report(spark: SparkSession, d: str) -> DataFrame:
    """Of each split, whether its share is within 5 per mille of its target, and how many of its articles are torn."""
    report = splits.split_report(Stage(p1_splits(spark, d)).df, table(spark, d, "panels"), table(spark, d, "split_targets"))
    return report.select("split_name", (F.abs("gap_permille") <= 5).alias("near"), "torn")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    _, removed = caps.capped_articles(table(spark, d, "panels"), table(spark, d, "qwen_panel_scoring"), PANELS_PER_ARTICLE)
    return removed.select("panel_id")


def p2_kept(spark: SparkSession, d: str) -> DataFrame:
    kept, _ = caps.capped_articles(table(spark, d, "panels"), table(spark, d, "qwen_panel_scoring"), PANELS_PER_ARTICLE)
    return kept.select("panel_id", "score")


def p2_nested(spark: SparkSession, d: str) -> DataFrame:
    """At most 6 panels of an id, 16 of an article and a tenth of all of a journal."""
    return caps.capped_journals(table(spark, d, "panels"), table(spark, d, "qwen_panel_scoring"), 6, PANELS_PER_ARTICLE, 0.1)


def _draw(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets")
    return mix.draw(Stage(common.labelled(table(spark, d, "samples"), targets)).df, targets)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _draw(spark, d)[1].where("gap > 0").select("quota_no")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return _draw(spark, d)[1]


def p3_needs(spark: SparkSession, d: str) -> DataFrame:
    """What each quota needs and how many records match it: the part of the report that has one right answer."""
    return _draw(spark, d)[1].select("quota_no", "needed", "available")


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return _draw(spark, d)[0]


def _scored(spark: SparkSession, d: str, column: str, targets: str) -> DataFrame:
    """panel_id, the known name in ``column`` and score of each record that has both."""
    names = common.known_names(table(spark, d, targets), column)
    recs = common.records(table(spark, d, "samples"), [column]).select("panel_id", common.to_known(F.col(column), names).alias(column))
    return recs.where(F.col(column).isNotNull()).join(common.panel_scores(table(spark, d, "qwen_panel_scoring")), "panel_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_per_group(_scored(spark, d, "subtype", "mix_targets"), "subtype", "score", "panel_id", TOP).select("subtype", "panel_id")


def p4_skips(spark: SparkSession, d: str) -> DataFrame:
    """How many row groups p4_found's method reads and skips, with row groups small enough for these tables to have many."""
    return topn.skips(_scored(spark, d, "subtype", "mix_targets"), "subtype", "score", "panel_id", TOP, row_group_bytes=1 << 14)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    scored = Stage(_scored(spark, d, "subject", "keep_targets")).df
    cuts = Stage(cutoff.cutoffs(scored, table(spark, d, "keep_targets"), "subject", 0.0, 10.0)).df
    return cutoff.at_or_above(scored, cuts, "subject").select("subject", "panel_id")


def p5_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cutoffs(_scored(spark, d, "subject", "keep_targets"), table(spark, d, "keep_targets"), "subject", 0.0, 10.0)


def p5_closest(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cutoffs(_scored(spark, d, "subject", "keep_targets"), table(spark, d, "keep_targets"), "subject", 0.0, 10.0, "closest")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    tokens = p6_ids(spark, d).select("doc_id", F.size("ids").alias("tokens"))
    return pack.pack(Stage(tokens).df, "doc_id", "tokens", CAPACITY)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """How many containers there are, and how few there could be at best."""
    packed = p7_packed(spark, d)
    total = F.sum(F.col("tokens").cast("long"))
    return packed.agg((F.max("container_id") + 1).alias("containers"), total.alias("tokens"), F.ceil(total / CAPACITY).alias("least"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.stuffed_pages(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        *(p1_found, p1_splits, p1_split_report, p2_found, p2_kept, p2_nested, p3_found, p3_report, p3_needs, p3_sample, p4_found, p4_skips, p5_found, p5_cutoffs, p5_closest),
        *(p6_ids, p7_packed, p7_report, p8_found),
    )
}
