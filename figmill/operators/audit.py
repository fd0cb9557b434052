"""Findings in the lines of code texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rule: category, severity, and a pattern of lower-case text. Rules are data of the caller; the first that matches a line counts.
Rule = tuple[str, str, str]


def rule_of(line: Column, rules: list[Rule]) -> Column:
    """Struct of category and severity of the first rule that matches; null if none does."""
    out = None
    for category, severity, pattern in rules:
        hit, value = F.lower(line).rlike(pattern), F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def findings(df: DataFrame, id_column: str, code: str, rules: list[Rule], most: int = 80, width: int = 240) -> DataFrame:
    """id, line, category, severity, text of the first ``most`` lines of each text that match a rule."""
    lines = F.transform(F.split(code, r"\r\n|\n|\r"), lambda x, i: F.struct((i + 1).alias("line"), F.left(F.trim(x), F.lit(width)).alias("text"), rule_of(x, rules).alias("rule")))
    hits = F.slice(F.filter(lines, lambda x: x["rule"].isNotNull()), 1, most)
    return df.select(id_column, F.inline(hits)).select(id_column, "line", F.col("rule.category").alias("category"), F.col("rule.severity").alias("severity"), "text")


def finding_counts(found: DataFrame, id_column: str, categories: list[str]) -> DataFrame:
    """Findings of each of ``categories`` for each text that has any."""
    return found.groupBy(id_column).agg(*[F.count_if(F.col("category") == c).alias(c) for c in categories])
