"""Capping the records of dominant contributors by nested caps, best records first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figmill.llm import common as C
from figmill.llm.splits import articles
from figmill.sources.tables import Stage


def capped(df: DataFrame, group: str, cap: int, order: list[Column]) -> DataFrame:
    """The ``cap`` best rows of each group. Spark limits each group before the shuffle, so a hot group sends at most
    ``cap`` rows from each task. Rows with a null group are one group."""
    rank = "__rank"
    while rank in df.columns:
        rank += "_"
    return df.withColumn(rank, F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col(rank) <= cap).drop(rank)


def nested_caps(df: DataFrame, levels: list[tuple[str, int | float]], order: list[Column]) -> DataFrame:
    """Rows kept under caps on nested groups (a laminar matroid), innermost level first.

    The greedy choice by ``order``, one ranked window pass a level, is optimal as the groups of each level lie within
    those of the next. ``order`` must be total for a defined result. A cap is a number of rows (below 1 it keeps nothing) or, as a float,
    a share of all rows of ``df``, rounded down.
    """
    rows = df.count() if any(isinstance(cap, float) for _, cap in levels) else 0
    for group, cap in levels:
        df = capped(df, group, int(cap * rows + 1e-9) if isinstance(cap, float) else cap, order)
    return df


def scored_panels(panels: DataFrame, scores: DataFrame) -> DataFrame:
    """panel_id, key, score of each panel of panels with a score; key is one entity its rows name."""
    ids = panels.select(C.panel_id().alias("panel_id"), C.row_keys()[0].alias("key")).where("panel_id is not null")
    return ids.groupBy("panel_id").agg(F.min("key").alias("key")).join(C.panel_scores(scores), "panel_id")


def capped_articles(panels: DataFrame, scores: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) panels of at most ``cap`` an article: first within the id a row names, then within the article."""
    labels, _ = articles(panels)
    scored = Stage(scored_panels(panels, scores)).df
    order = [F.desc("score"), F.asc("panel_id")]
    within_key = nested_caps(scored, [("key", cap)], order)
    with_article = within_key.join(labels.select(F.col("entity").alias("key"), F.col("label").alias("article")), "key")
    kept = Stage(nested_caps(with_article, [("article", cap)], order)).df
    return kept, scored.join(kept.select("panel_id"), "panel_id", "left_anti")


def capped_journals(panels: DataFrame, scores: DataFrame, per_id: int, per_article: int, journal_share: float) -> DataFrame:
    """panel_id, score of the panels kept under three nested caps: within the text before __fig, within the article, and within the journal.

    An article counts to the journal of smallest name that its rows give, all articles without one to one journal
    of their own. The journal's cap is a share of all scored panels.
    """
    labels, _ = articles(panels)
    scored = scored_panels(panels, scores)
    journal = F.nullif(F.trim("journal"), F.lit(""))
    named = panels.select(C.row_keys()[0].alias("entity"), journal.alias("journal")).where("journal is not null").groupBy("entity").agg(F.min("journal").alias("journal"))
    of_article = labels.join(named, "entity", "left").groupBy("label").agg(F.min("journal").alias("journal"))
    placed = labels.join(of_article, "label").select(F.col("entity").alias("key"), F.col("label").alias("article"), F.coalesce("journal", F.lit("")).alias("journal"))
    rows = Stage(scored.join(placed, "key").withColumn("prefix", C.before_fig(F.col("panel_id")))).df
    levels = [("prefix", per_id), ("article", per_article), ("journal", journal_share)]
    return nested_caps(rows, levels, [F.desc("score"), F.asc("panel_id")]).select("panel_id", "score")
