"""Calls of external functions in Arrow batches, with results kept by signature, and reports of runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figmill.functions.jsonx import stable_hash
from figmill.operators.arrays import total
from figmill.operators.joins import skew_lookup

#: Functions from a batch to a batch, by name; a caller may add its own.
BACKENDS: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}


def backend(name: str) -> Callable:
    def add(f: Callable) -> Callable:
        BACKENDS[name] = f
        return f

    return add


@backend("mock")
def _mock(batch: pd.DataFrame) -> pd.DataFrame:
    """A result that depends on nothing but the row's signature."""
    return pd.DataFrame({"signature": batch["signature"], "result": "mock:" + batch["signature"].str[:8], "error": None})


def signed(df: DataFrame, columns: list[str], run: str) -> DataFrame:
    """``df`` with the signature of each row's inputs and of the run."""
    return df.withColumn("signature", stable_hash(F.lit(run).alias("run"), *[F.col(c) for c in columns]))


def evaluated(df: DataFrame, columns: list[str], name: str, run: str, cache: DataFrame | None = None, batch: int = 64) -> DataFrame:
    """signature, result, error of the distinct inputs of ``df``: kept results are taken, only the others are computed.

    A batch that fails is tried row by row; a row that fails has its error and a null result, and never ends the job.
    """
    call = BACKENDS[name]
    inputs = signed(df, columns, run).select("signature", *columns).dropDuplicates(["signature"])

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            return call(rows)[["signature", "result", "error"]]
        except Exception as e:  # noqa: BLE001 - any failure of a backend is data here
            if len(rows) > 1:
                return pd.concat([one(rows.iloc[i : i + 1]) for i in range(len(rows))])
            return pd.DataFrame({"signature": rows["signature"], "result": [None], "error": [str(e)[:500]]})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                yield one(pdf.iloc[i : i + batch])

    schema = "signature string, result string, error string"
    if cache is None:
        return inputs.mapInPandas(work, schema)
    fit = cache.where("result is not null").select("signature", "result", "error").dropDuplicates(["signature"])
    new = inputs.join(fit, "signature", "left_anti").mapInPandas(work, schema)
    return fit.join(inputs.select("signature"), "signature", "left_semi").unionByName(new)


def resume_reasons(kept: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``kept`` with the reasons why a result can't be used again; null checks count as failing."""
    return kept.withColumn("reasons", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])))


def judged(df: DataFrame, valid: Column, scores: dict[str, tuple[Column, float]]) -> DataFrame:
    """``df`` with each score times its factor, within 0 to 100, 0 where invalid, and the mean of those there are."""
    made = {n: F.when(~valid, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), c * k))) for n, (c, k) in scores.items()}
    values = F.array_compact(F.array(*made.values()))
    return df.select("*", *[c.alias(n) for n, c in made.items()], F.when(F.size(values) > 0, total(values) / F.size(values)).alias("mean_score"))


def problem_rates(audits: DataFrame, group: list[str], complete: Column, problem: Column) -> DataFrame:
    """complete, problems and their rate of each group; the rate of a group without complete rows is null."""
    counts = audits.groupBy(*group).agg(F.count_if(complete).alias("complete"), F.count_if(complete & problem).alias("problems"))
    return counts.withColumn("rate", F.try_divide("problems", "complete"))


def exemplars(df: DataFrame, group: str, id_column: str) -> DataFrame:
    """For each row the first other id of its group, or null: the least id, or for that one the second."""
    # Two distinct ids a group are all that is needed; each task sends no more, and look-ups split hot groups off.
    ids = df.where(F.col(group).isNotNull() & F.col(id_column).isNotNull()).select(group, id_column).distinct()
    ids = ids.withColumn("__rank", F.row_number().over(W.partitionBy(group).orderBy(id_column))).where("__rank <= 2")
    two = ids.groupBy(group).agg(F.min(id_column).alias("__first"), F.max(F.when(F.col("__rank") == 2, F.col(id_column))).alias("__second"))
    rows = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("__rows"))
    own = skew_lookup(df.where(F.col(group).isNotNull()), rows.join(two, group, "left"), group, "__rows")
    exemplar = F.when(F.col(id_column) == F.col("__first"), F.col("__second")).otherwise(F.col("__first"))
    alone = df.where(F.col(group).isNull()).withColumn("exemplar", F.lit(None).cast(df.schema[id_column].dataType))
    return own.withColumn("exemplar", exemplar).drop("__first", "__second").unionByName(alone)


def leaderboard(runs: DataFrame, summaries: DataFrame, key: str, metrics: list[str], label: str = "") -> DataFrame:
    """Run logs with minutes and the means of their summaries; runs without a summary keep nulls."""
    chosen = runs.where(F.col(key).contains(label)) if label else runs
    means = summaries.select(key, *[F.round(F.get_json_object("summary", f"$.{m}.mean").try_cast("double"), 4).alias(m) for m in metrics])
    return chosen.join(means, key, "left").withColumn("minutes", F.round(F.col("elapsed_seconds") / 60, 4))
