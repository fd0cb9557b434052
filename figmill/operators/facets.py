"""Faceted search over a catalogue: filters, orders, pages, facet counts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figmill.functions import text

PAGE = 60


@dataclass(frozen=True)
class Search:
    """What a user asks for; defaults filter nothing. equal: column to wanted value, "all" for any."""

    q: str = ""
    least_score: float = 0.0
    state: str = "all"
    most_rounds: int | None = None
    equal: dict[str, str] = field(default_factory=dict)
    order: str = "quality"
    pages: int = 1


@dataclass(frozen=True)
class Catalogue:
    """Which columns of the items play which part."""

    id: str
    score: str
    texts: list[str]
    weights: dict[str, int]
    orders: dict[str, list[Column]]
    passed: str | None = None
    rounds: str | None = None


def conditions(c: Catalogue, s: Search, without: str | None = None) -> list[Column]:
    out = [F.coalesce(F.col(c.score), F.lit(0.0)) >= s.least_score] if s.least_score else []
    if s.q.strip():
        out.append(text.search_text(*[F.col(x) for x in c.texts]).contains(s.q.strip().lower()))
    if c.passed and s.state in ("passed", "open"):
        passed = F.coalesce(F.col(c.passed), F.lit(False))
        out.append(passed if s.state == "passed" else ~passed)
    if c.rounds and s.most_rounds is not None:
        out.append(F.coalesce(F.col(c.rounds), F.lit(0)) <= s.most_rounds)
    return out + [F.col(k) == v for k, v in s.equal.items() if v != "all" and k != without]


def filtered(df: DataFrame, c: Catalogue, s: Search, without: str | None = None) -> DataFrame:
    for condition in conditions(c, s, without):
        df = df.where(condition)
    return df


def searched(df: DataFrame, c: Catalogue, s: Search) -> DataFrame:
    """The first pages of the items found, in order. A query in order of relevance sorts by its weights; ids break ties."""
    found = filtered(df, c, s)
    order = c.orders.get(s.order, [F.desc_nulls_last(c.score)])
    if s.order == "relevance" and s.q.strip():
        found = found.withColumn("relevance", text.relevance(s.q, [(F.col(k), w) for k, w in c.weights.items()]))
        order = [F.desc("relevance"), F.desc_nulls_last(c.score)]
    return found.orderBy(*order, c.id).limit(PAGE * s.pages)


def facet(df: DataFrame, c: Catalogue, s: Search, column: str) -> DataFrame:
    """Counts of a column's values under all filters but its own; most frequent first, then by name."""
    return filtered(df, c, s, without=column).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def totals(df: DataFrame, c: Catalogue, kind: str, journal: str) -> DataFrame:
    return df.agg(F.count("*").alias("items"), F.count_distinct(kind).alias("kinds"), F.count_distinct(journal).alias("journals"), F.avg(c.score).alias("score"))
