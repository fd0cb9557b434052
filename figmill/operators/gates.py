"""Gates that collect every reason a row fails, and routes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figmill.functions.casts import general_format


@dataclass(frozen=True)
class Rule:
    """A reason and when it holds; a null condition counts as false."""

    reason: str
    fails: Column


def reasons(rules: list[Rule]) -> Column:
    """The reasons that hold, in the order of the rules; empty for a row that passes."""
    return F.array_compact(F.array(*[F.when(r.fails, F.lit(r.reason)) for r in rules]))


def below(values: dict[str, Column], least: dict[str, float]) -> Column:
    """name=value<threshold=least of every value below its threshold or missing, joined by ;, or null."""
    shown = []
    for name, low in least.items():
        text = F.concat(F.lit(f"{name}="), F.coalesce(general_format(values[name]), F.lit("missing")), F.lit("<threshold="), general_format(F.lit(float(low))))
        shown.append(F.when(values[name].isNull() | (values[name] < low), text))
    return F.nullif(F.array_join(F.array_compact(F.array(*shown)), ";"), F.lit(""))


def reaches(values: dict[str, Column], least: dict[str, float]) -> Column:
    """Whether no value is missing or below its threshold: that ``below`` is null, without its text."""
    ok = [v.isNotNull() & ~(v < least[name]) for name, v in values.items()]
    return F.coalesce(F.least(*ok) if len(ok) > 1 else ok[0], F.lit(False))


def gated(df: DataFrame, rules: list[Rule], column: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """(passed, rejected); the rejected have their reasons. Together they are the input."""
    marked = df.withColumn(column, reasons(rules))
    return marked.where(F.size(column) == 0).drop(column), marked.where(F.size(column) > 0)


def reason_counts(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """reason, n: rows that fail by each reason; a row with several counts for each of them."""
    return df.select(F.explode(reasons(rules)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def route(branches: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first branch whose condition holds."""
    out = None
    for name, condition in branches:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def within(column: str, allowed: list | None) -> Column:
    """IN the list; no list or an empty one filters nothing."""
    return F.col(column).isin(allowed) if allowed else F.lit(True)


def missing_of(required: list[str], present: Column) -> Column:
    """The required names that ``present`` (an array, null counts as empty) lacks."""
    return F.array_except(F.array(*map(F.lit, required)), F.coalesce(present, F.array().cast("array<string>")))


def small_list(df: DataFrame, column: str, most: int = 10_000) -> list:
    """Rows of the distinct values of a column, nulls aside, for use as a literal; more than ``most`` are an error, never cut."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column}: more than {most} values; join them instead")
    return rows
