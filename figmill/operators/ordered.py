"""Operators that depend on the order of rows, without putting all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figmill.operators.joins import one_per_key
from figmill.sources.tables import Stage


def indexed(df: DataFrame, order: list[str | Column], column: str = "index") -> DataFrame:
    """``df`` with the place of each row from 0 in the ascending order of the columns ``order``.

    Rows are range partitioned and written once, so that places hold; each partition is numbered by itself and
    shifted by what comes before, of which there is one count a partition. Rows equal in ``order`` may fall either way.
    """
    parts = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    stage = Stage(parts).df
    sizes = stage.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    within = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return stage.withColumn("__at", within).join(F.broadcast(starts), "__part").withColumn(column, F.col("__at") + F.col("__start")).drop("__part", "__at", "__start")


def shard(df: DataFrame, order: list[str], shards: int, index: int) -> DataFrame:
    """Every ``shards``-th row from ``index`` in order; the shards are disjoint and together the input."""
    if not 0 <= index < shards:
        raise ValueError("shard index")
    return indexed(df, order, "__i").where(F.col("__i") % shards == index).drop("__i")


def prefix_by_keys(df: DataFrame, order: list[str], key: str, most: int) -> DataFrame:
    """Rows in order up to the first of the (most + 1)-th distinct key; later rows are lost even of keys seen.

    0 keeps all rows. Only the first place of each key is aggregated, and only most + 1 of them are sorted; rows are
    filtered where they are, neither sorted nor written. ``order`` should be total: of rows equal to the first lost one, all are lost.
    """
    if most < 1:
        return df
    place = F.struct(*order)
    firsts = df.groupBy(key).agg(F.min(place).alias("__place")).orderBy("__place").limit(most + 1)
    cut = firsts.agg(F.when(F.count("*") > most, F.max("__place")).alias("__cut"))  # one row
    return df.crossJoin(F.broadcast(cut)).where(F.col("__cut").isNull() | (place < F.col("__cut"))).drop("__cut")


def by_priority(df: DataFrame, key: str, priority: str, run: str) -> DataFrame:
    """Of each key the row of highest priority, then latest run."""
    return one_per_key(df, [key], [F.desc(priority), F.desc(run)])


def first_seen(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return one_per_key(df, [key], order)


def page(df: DataFrame, order: list[Column], size: int, number: int = 1) -> DataFrame:
    """The first ``number`` pages in order."""
    return df.orderBy(*order).limit(size * number)


def newest(df: DataFrame, group: list[str], run: str) -> DataFrame:
    """The greatest run name of each group."""
    return df.groupBy(*group).agg(F.max(run).alias(run))


def latest_artifact(df: DataFrame, group: list[str], path: str, modified: str, size: str) -> DataFrame:
    """The path last modified in each group, the larger file on a tie."""
    return df.groupBy(*group).agg(F.max_by(path, F.struct(modified, size, path)).alias(path))
