"""Filling containers of fixed capacity with items by best-two-fit.

Sizes are whole numbers up to the capacity, so the plan is made on their histogram, a table of at most ``capacity``
rows: a pattern of sizes is found once and used for as many containers as the counts allow. Items are then numbered
within their size and take the slots of the patterns; no item but its size ever reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figmill.sources.tables import Stage

ROWS_PER_BLOCK = 500_000


def _largest(left: np.ndarray, most: int) -> int:
    """The largest size of at most ``most`` that is left, or 0."""
    found = np.flatnonzero(left[: most + 1]) if most > 0 else []
    return int(found[-1]) if len(found) else 0


def _pair(left: np.ndarray, gap: int) -> tuple[int, int]:
    """The two sizes left with the greatest sum within ``gap``, the larger first; (0, 0) if there are none."""
    have = np.flatnonzero(left[: gap + 1])
    have = have[have > 0]
    if not len(have):
        return 0, 0
    at = np.searchsorted(have, gap - have, side="right") - 1
    at = np.where((at >= 0) & (have[np.maximum(at, 0)] == have) & (left[have] < 2), at - 1, at)
    sums = np.where(at >= 0, have + have[np.maximum(at, 0)], -1)
    k = int(np.argmax(sums))
    return (0, 0) if sums[k] < 0 else (max(int(have[k]), int(have[at[k]])), min(int(have[k]), int(have[at[k]])))


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(size to number, containers) of each pattern; together they use every item of ``counts`` once.

    A container takes the largest size that fits until none does. Then its smallest item gives way to two items left
    whose sum fills the gap it leaves more tightly, if there are such.
    """
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    out = []
    while (s := _largest(left, capacity)) > 0:
        items, gap = [], capacity
        while s:
            items.append(s)
            left[s] -= 1
            gap -= s
            s = _largest(left, gap)
        if gap and len(items) > 1:
            a, b = _pair(left, gap + items[-1])
            if a + b > items[-1]:
                left[items.pop()] += 1
                items += [a, b]
                left[a] -= 1
                left[b] -= 1
        number: dict[int, int] = {}
        for x in items:
            number[x] = number.get(x, 0) + 1
        more = min(int(left[x]) // n for x, n in number.items())
        for x, n in number.items():
            left[x] -= n * more
        out.append((number, more + 1))
    return out


def pack(items: DataFrame, id_column: str, size: str, capacity: int) -> DataFrame:
    """container_id, id, piece, size of every item of ``items`` with a size above 0.

    An item above the capacity is cut into full pieces and a rest; every other item is whole, as piece 0. Items whose
    size is null or below 1 take no room and have no row. Containers are numbered from 0. The same items give the
    same containers in every run.
    """
    if capacity < 1:
        raise ValueError("capacity")
    spark = items.sparkSession
    whole = items.where(F.col(size) > 0).select(F.col(id_column).alias("id"), F.col(size).cast("long").alias("all"))
    cut = whole.select("id", "all", F.explode(F.sequence(F.lit(0), F.ceil(F.col("all") / capacity).cast("int") - 1)).alias("piece"))
    cut = Stage(cut.select("id", "piece", F.least(F.lit(capacity), F.col("all") - F.col("piece") * capacity).cast("int").alias("size"))).df
    counts = {r["size"]: r["n"] for r in cut.groupBy("size").agg(F.count("*").alias("n")).collect()}
    used: dict[int, int] = dict.fromkeys(counts, 0)
    slots, base = [], 0
    for number, containers in patterns(counts, capacity):
        for x, n in number.items():
            for _ in range(n):
                slots.append((x, used[x], used[x] + containers, base))
                used[x] += containers
        base += containers
    slot_table = spark.createDataFrame(slots, "size int, low long, high long, base long")
    block = F.pmod(F.xxhash64("id", "piece"), F.lit(1 + sum(counts.values()) // ROWS_PER_BLOCK))
    blocks = cut.withColumn("block", block)
    starts = blocks.groupBy("size", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("size").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    starts = starts.select("size", "block", F.coalesce(before, F.lit(0)).alias("start"))
    ranked = blocks.withColumn("rank", F.row_number().over(W.partitionBy("size", "block").orderBy("id", "piece")) - 1)
    ranked = ranked.join(starts, ["size", "block"]).withColumn("rank", F.col("rank") + F.col("start"))
    placed = ranked.join(F.broadcast(slot_table), "size").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select((F.col("base") + F.col("rank") - F.col("low")).alias("container_id"), F.col("id").alias(id_column), "piece", F.col("size").alias(size))
