"""Look-ups, anti and semi joins, upserts and joins by a condition, each as equi-joins where they can be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``; Spark limits each group before the shuffle."""
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def lookup(left: DataFrame, right: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Left join with one right row for each key, the first by ``order``; rows keep their number."""
    return left.join(one_per_key(right, keys, order), keys, "left")


def overlay(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join where a right column goes before a left column of the same name, if the key was found, even when null."""
    marked = right.withColumn("__found", F.lit(True))
    shared = [c for c in right.columns if c in left.columns and c not in keys]
    renamed = marked.select(*keys, "__found", *[F.col(c).alias(f"__r_{c}" if c in shared else c) for c in right.columns if c not in keys])
    joined = left.join(renamed, keys, "left")
    merged = [F.when(F.col("__found"), F.col(f"__r_{c}")).otherwise(F.col(c)).alias(c) if c in shared else F.col(c) for c in left.columns]
    return joined.select(*merged, *[c for c in right.columns if c not in left.columns])


def broadcast_if_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else unchanged: then Spark joins by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def skew_lookup(left: DataFrame, right: DataFrame, key: str, rows: str, hot_share: float = 0.01) -> DataFrame:
    """Inner join of ``left`` with ``right``, which is unique by ``key`` and has in ``rows`` how many left rows share it.

    Keys with over ``hot_share`` of all rows, of which there are at most 1 / hot_share, are broadcast; only the rest
    is shuffled, so no task gets a hot key's rows.
    """
    total = right.agg(F.coalesce(F.sum(rows), F.lit(0)).alias("n")).first()["n"]
    limit = max(1, int(total * hot_share))
    hot = right.where(F.col(rows) > limit).drop(rows)
    cold = right.where(F.col(rows) <= limit).drop(rows)
    if not right.where(F.col(rows) > limit).limit(1).count():
        return left.join(cold, key)
    return left.join(F.broadcast(hot), key).unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; a new row replaces the old one of its key. Null keys never match, so all their rows stay."""
    kept = old.join(new.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the seen ones; a null key is never seen."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def related(items: DataFrame, id_column: str, paper: str, kind: str, score: str, most: int) -> DataFrame:
    """id, related_id, rank: for each item up to ``most`` others of its paper or kind, those of its paper first, then by score, then id.

    The OR of two equalities would be a nested loop over all pairs. Candidates of a group are instead its ``most`` + 1
    best, which is all that any member can need, so no group is ever joined with itself as a whole.
    """
    order = [F.desc(score), F.asc(id_column)]
    columns = [F.col(id_column).alias("related_id"), F.col(score).alias("related_score")]

    def best(column: str, first: int) -> DataFrame:
        rank = F.row_number().over(W.partitionBy(column).orderBy(*order))
        some = items.where(F.col(column).isNotNull()).withColumn("__rank", rank).where(F.col("__rank") <= most + 1)
        top = some.select(F.col(column).alias("__key"), *columns).groupBy("__key").agg(F.collect_list(F.struct("related_id", "related_score")).alias("__top"))
        rows = items.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__key")).agg(F.count("*").alias("__rows"))
        mine = skew_lookup(items.select(F.col(id_column), F.col(column).alias("__key")), top.join(rows, "__key"), "__key", "__rows")
        return mine.select(id_column, F.inline("__top")).withColumn("__first", F.lit(first))

    both = best(paper, 1).unionByName(best(kind, 0)).where(F.col("related_id") != F.col(id_column))
    both = both.groupBy(id_column, "related_id").agg(F.max("related_score").alias("related_score"), F.max("__first").alias("__first"))
    rank = F.row_number().over(W.partitionBy(id_column).orderBy(F.desc("__first"), F.desc("related_score"), "related_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= most).select(id_column, "related_id", "rank")


def matrix(left: DataFrame, right: DataFrame, most: int = 1_000_000) -> DataFrame:
    """All pairs of two small dimension tables; more than ``most`` pairs are an error."""
    if left.count() * right.count() > most:
        raise ValueError("a matrix is of two small tables")
    return left.crossJoin(F.broadcast(right))


def nearest_in_group(points: DataFrame, boxes: DataFrame, group: list[str], point_id: str, cost: Column, tie: list[Column]) -> DataFrame:
    """For each point the box of its group of least ``cost``; boxes whose cost is null are no match.

    cost is over the columns of both tables; pairs are formed within a group (a figure) only.
    """
    scored = points.join(boxes, group).withColumn("cost", cost).where(F.col("cost").isNotNull())
    return one_per_key(scored, [*group, point_id], [F.asc("cost"), *tie])


def zip_in_order(left: DataFrame, right: DataFrame, group: list[str], left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """The n-th left row of each group with its n-th right row; what is left over, and rows of null groups, have no row.

    Rows are range partitioned by group and order and numbered there, so that a large group is spread over many tasks.
    """
    from figmill.operators.ordered import indexed  # which uses this module

    def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
        rows = indexed(df, [*group, *order], "__i")
        starts = rows.groupBy(*group).agg(F.min("__i").alias("__start"))
        return rows.join(broadcast_if_small(starts), group).withColumn("__n", F.col("__i") - F.col("__start")).drop("__i", "__start")

    return numbered(left, left_order).join(numbered(right, right_order), [*group, "__n"]).drop("__n")
