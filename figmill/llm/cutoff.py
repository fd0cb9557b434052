"""Score cutoffs that keep a target fraction of each source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figmill.llm import common as C

BUCKETS = 1024


def cutoffs(scored: DataFrame, targets: DataFrame, group: str, low: float, high: float, rule: str = "at_least") -> DataFrame:
    """group, cutoff, kept, scored: the cutoff of each group of ``targets`` (group, keep_permille).

    scored: (group, score), scores within low and high. rule ``at_least``: the greatest score at or above which at
    least the target share lies; ``closest``: the score whose kept share is nearest to the target, the higher on a
    tie. Distinct scores are counted before any window. Cumulative sums run over at most BUCKETS equal score ranges
    of each group, then over the distinct scores of the one range (or two) that hold the cutoff. Groups without scores have no row. A
    target of 0 gives the greatest score under ``at_least``.
    """
    if rule not in ("at_least", "closest"):
        raise ValueError(rule)
    bucket = F.least(F.lit(BUCKETS - 1), F.floor((F.col("score") - low) / (high - low) * BUCKETS).cast("int"))
    counts = scored.where(F.col(group).isNotNull() & F.col("score").isNotNull()).groupBy(group, "score").agg(F.count("*").alias("n"))
    counts = counts.join(C.broadcast_if_small(targets.select(group, "keep_permille")), group).withColumn("bucket", bucket)
    sums = counts.groupBy(group, "bucket").agg(F.sum("n").alias("n"), F.first("keep_permille").alias("keep"))
    down = W.partitionBy(group).orderBy(F.desc("bucket"))
    sums = sums.select(group, "bucket", "n", "keep", F.sum("n").over(down).alias("upto"), F.sum("n").over(W.partitionBy(group)).alias("total"), F.lag("bucket").over(down).alias("above"))
    reached = sums.where((F.col("upto") * 1000 >= F.col("keep") * F.col("total")) & ((F.col("upto") - F.col("n")) * 1000 < F.greatest(F.col("keep"), F.lit(1)) * F.col("total")))
    at = reached.groupBy(group).agg(F.max_by(F.struct("bucket", "above", "n", "upto", "total", "keep"), "bucket").alias("at")).select(group, "at.*")
    at = at.select(group, F.col("upto") - F.col("n"), "total", "keep", F.explode(F.array_compact(F.array("bucket", *["above"] * (rule == "closest")))).alias("bucket"), F.col("bucket").alias("main")).toDF(group, "before", "total", "keep", "bucket", "main")
    near = counts.select(group, "score", "n", "bucket").join(at, [group, "bucket"])
    main = F.col("bucket") == F.col("main")
    down = W.partitionBy(group, "bucket").orderBy(F.desc("score"))
    up = W.partitionBy(group, "bucket").orderBy(F.asc("score")).rowsBetween(W.unboundedPreceding, -1)
    kept = F.when(main, F.col("before") + F.sum("n").over(down)).otherwise(F.col("before") - F.coalesce(F.sum("n").over(up), F.lit(0)))
    near = near.select(group, "score", "total", "keep", kept.alias("kept"))
    if rule == "at_least":
        best = F.max_by(F.struct("score", "kept", "total"), "score")
        near = near.where(F.col("kept") * 1000 >= F.col("keep") * F.col("total"))
    else:
        gap = F.abs(F.col("kept") * 1000 - F.col("keep") * F.col("total"))
        best = F.min_by(F.struct("score", "kept", "total"), F.struct(gap, -F.col("score")))
    return near.groupBy(group).agg(best.alias("best")).select(group, F.col("best.score").alias("cutoff"), F.col("best.kept").alias("kept"), F.col("best.total").alias("scored"))


def at_or_above(scored: DataFrame, cuts: DataFrame, group: str) -> DataFrame:
    """The rows of ``scored`` at or above their group's cutoff; groups without a cutoff keep none."""
    return scored.join(C.broadcast_if_small(cuts.select(group, "cutoff")), group).where(F.col("score") >= F.col("cutoff")).drop("cutoff")
