"""Mining identifiers from texts and records, and the state of what was seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figmill.functions import ids


def found_in(c: Column) -> Column:
    """Array of (kind, identifier) that a text holds; a panel id also names its article."""
    panel = ids.panel_id_in(c)
    pairs = [("doi", ids.doi(c)), ("pmcid", ids.pmcid(c)), ("panel_id", panel), ("doi", ids.doi_of_slug(panel)), ("doi", ids.doi_of_slug(c))]
    return F.array_distinct(F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("identifier")) for k, v in pairs]), lambda p: p["identifier"] != ""))


def mined(df: DataFrame, columns: list[str]) -> DataFrame:
    """kind, identifier of all that the columns hold, each once."""
    every = F.flatten(F.array(*[found_in(F.col(c).cast("string")) for c in columns]))
    return df.select(F.explode(every).alias("x")).select("x.*").distinct()


def mined_json(df: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """kind, identifier of JSON texts at any depth: values of the known keys, and bare texts of lists."""
    quoted = r'"((?:[^"\\]|\\.)*)"'
    keyed = F.regexp_extract_all(body, F.lit(rf'"(?:{"|".join(keys)})"\s*:\s*{quoted}'), F.lit(1))
    bare = F.regexp_extract_all(body, F.lit(rf'(?:[\[,])\s*{quoted}\s*(?=[,\]])'), F.lit(1))
    values = df.select(F.explode(F.concat(keyed, bare)).alias("value")).select(F.regexp_replace("value", r"\\/", "/").alias("value"))
    return mined(values, ["value"])


def merged(state: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state with the found identifiers, count of new ones by kind)."""
    new = found.select("kind", "identifier").distinct().join(state, ["kind", "identifier"], "left_anti")
    return state.select("kind", "identifier").unionByName(new).distinct(), new.groupBy("kind").agg(F.count("*").alias("added"))


def excluded(df: DataFrame, state: DataFrame, kind: str, column: Column) -> DataFrame:
    """Rows whose identifier is not in the state; both sides are in their normal form, so letter case does not matter."""
    seen = state.where(F.col("kind") == kind).select(F.lower("identifier").alias("__seen")).distinct()
    return df.withColumn("__seen", F.lower(column)).join(seen, "__seen", "left_anti").drop("__seen")


def run_summary(papers: DataFrame, run: str) -> DataFrame:
    """Rows, distinct DOIs and distinct PMCIDs of each run."""
    doi, pmc = F.nullif(ids.doi(F.col("doi")), F.lit("")), F.nullif(ids.pmcid(F.col("pmcid")), F.lit(""))
    return papers.groupBy(run).agg(F.count("*").alias("papers"), F.count_distinct(doi).alias("dois"), F.count_distinct(pmc).alias("pmcids"))
