"""Statistics, breakdowns, histograms and value counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figmill.operators.joins import skew_lookup
from figmill.operators.ordered import indexed


def stats(c: Column, prefix: str = "") -> list[Column]:
    """count, null_count, mean, median and population deviation (0 for one value, null for none).

    The median holds a group's distinct values in one task; ``group_stats`` is for groups too large for that.
    """
    return [
        F.count(c).alias(f"{prefix}count"),
        F.count_if(c.isNull()).alias(f"{prefix}null_count"),
        F.avg(c).alias(f"{prefix}mean"),
        F.median(c).alias(f"{prefix}median"),
        F.stddev_pop(c).alias(f"{prefix}std"),
    ]


def quantiles(c: Column) -> list[Column]:
    """min, p25, median, p75 and max by linear interpolation, for groups whose distinct values fit a task (else ``group_quantiles``)."""
    return [F.min(c).alias("min"), *[F.percentile(c, F.lit(q)).alias(n) for n, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))], F.max(c).alias("max")]


def group_quantiles(df: DataFrame, group: list[str], column: str, points: dict[str, float], ranges: int = 200) -> DataFrame:
    """group and one column for each of ``points`` (name to share): exact quantiles by linear interpolation, for groups of any size.

    Distinct values are counted before any shuffle. Each group is divided in ``ranges`` of about as many rows (by an approximate
    summary that costs a bounded memory); the ranges are counted, and only those that hold a wanted place are sorted, so no task
    sees all values of a group. Null values count nowhere; a group without values has no row; null group keys are a group.
    """
    v = F.col(column).cast("double")
    rows = df.where(v.isNotNull()).select(F.struct(*group).alias("__key"), v.alias("__v"))
    values = rows.groupBy("__key", "__v").agg(F.count("*").alias("__n"))
    cuts = rows.groupBy("__key").agg(F.percentile_approx("__v", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("__cuts"), F.count("*").alias("__total"))
    if cuts.limit(100_001).count() <= 100_000:
        ranged = values.join(F.broadcast(cuts), "__key")
    else:
        ranged = skew_lookup(values, cuts.join(values.groupBy("__key").agg(F.count("*").alias("__rows")), "__key"), "__key", "__rows")
    ranged = ranged.select("__key", "__v", "__n", "__total", F.size(F.filter("__cuts", lambda c: c < F.col("__v"))).alias("__range"))
    sums = ranged.groupBy("__key", "__range").agg(F.sum("__n").alias("__n"), F.first("__total").alias("__total"))
    sums = sums.withColumn("__upto", F.sum("__n").over(W.partitionBy("__key").orderBy("__range")))
    each = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(q).cast("double").alias("q")) for name, q in points.items()])
    place = F.col("p.q") * (F.col("__total") - 1)
    wanted = sums.select("*", F.explode(each).alias("p")).select("*", F.explode(F.array(F.floor(place), F.ceil(place))).alias("__rank"), F.col("p.name").alias("__name"), (place - F.floor(place)).alias("__part"))
    wanted = wanted.where((F.col("__rank") >= F.col("__upto") - F.col("__n")) & (F.col("__rank") < F.col("__upto")))
    wanted = wanted.select("__key", "__range", "__rank", "__name", "__part", (F.col("__upto") - F.col("__n")).alias("__before"))
    near = ranged.join(wanted.select("__key", "__range").distinct(), ["__key", "__range"], "left_semi")
    near = near.withColumn("__to", F.sum("__n").over(W.partitionBy("__key", "__range").orderBy("__v")))
    found = wanted.join(near.select("__key", "__range", "__v", "__n", "__to"), ["__key", "__range"])
    inside = F.col("__rank") - F.col("__before")
    found = found.where((inside >= F.col("__to") - F.col("__n")) & (inside < F.col("__to")))
    one = found.groupBy("__key", "__name").agg((F.min("__v") + (F.max("__v") - F.min("__v")) * F.max("__part")).alias("__q"))
    out = one.groupBy("__key").agg(*[F.max(F.when(F.col("__name") == name, F.col("__q"))).alias(name) for name in points])
    return out.select("__key.*", *points)


def group_stats(df: DataFrame, group: list[str], column: str) -> DataFrame:
    """group and the columns of ``stats`` for groups of any size: as stats(), with the median by ``group_quantiles``."""
    count, nulls, mean, _, std = stats(F.col(column))
    plain = df.groupBy(F.struct(*group).alias("__key")).agg(count, nulls, mean, std)
    middle = group_quantiles(df, group, column, {"median": 0.5}).select(F.struct(*group).alias("__key"), "median")
    return plain.join(middle, "__key", "left").select("__key.*", "count", "null_count", "mean", "median", "std")


def rate(c: Column) -> Column:
    """Share of true values; 0 for no rows; null counts as false."""
    return F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0))


def known_key(c: Column) -> Column:
    """The value as text; null, empty, 0 and false are unknown."""
    text = c.cast("string")
    return F.when(text.isNull() | text.isin("", "0", "0.0", "false"), "unknown").otherwise(text)


def breakdowns(df: DataFrame, key_sets: list[tuple[str, ...]], measures: list[Column]) -> DataFrame:
    """breakdown, label and measures for each set of keys, in one pass of grouping sets.

    label joins the keys by " / "; missing keys are unknown.
    """
    keys = sorted({k for s in key_sets for k in s})
    named = df.select("*", *[known_key(F.col(k)).alias(f"__k_{k}") for k in keys])
    sets = [[F.col(f"__k_{k}") for k in s] for s in key_sets]
    ids = F.grouping_id(*[f"__k_{k}" for k in keys])
    out = named.groupingSets(sets, *[F.col(f"__k_{k}") for k in keys]).agg(ids.alias("__id"), *measures)
    name, label = None, None
    for s in key_sets:
        code = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
        here = F.col("__id") == code
        text = F.concat_ws(" / ", *[F.col(f"__k_{k}") for k in s])
        name = F.when(here, "_x_".join(s)) if name is None else name.when(here, "_x_".join(s))
        label = F.when(here, text) if label is None else label.when(here, text)
    drop = ["__id", *[f"__k_{k}" for k in keys]]
    return out.withColumn("breakdown", name).withColumn("label", label).drop(*drop)


def macro(df: DataFrame, key: str, value: Column) -> DataFrame:
    """Statistics of the group means, each group counting once."""
    means = df.groupBy(known_key(F.col(key)).alias("key")).agg(F.avg(value).alias("mean"))
    return means.agg(*stats(F.col("mean")))


def histogram(df: DataFrame, value: Column, edges: list[float], group: list[str] = ()) -> DataFrame:
    """low, high, n of the half-open bins between edges; empty bins have 0. Values outside fall in none, as do null and NaN."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, low double, high double")
    index = sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0)) - 1
    found = df.where(value.isNotNull() & ~F.isnan(value)).groupBy(*group, index.alias("bin")).agg(F.count("*").alias("n"))
    frame = df.select(*group).distinct().crossJoin(F.broadcast(bins)) if group else bins
    return frame.join(found, [*group, "bin"], "left").select(*group, "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, n, place: numbers first in their order, then texts; null and empty are left out.

    place is from 1 over the distinct values, which are counted before and numbered by partition.
    """
    text = F.col(column).cast("string")
    counts = df.where(text.isNotNull() & (text != "")).groupBy(text.alias("value")).agg(F.count("*").alias("n"))
    number = F.col("value").try_cast("double")
    placed = indexed(counts.withColumn("__text", number.isNull()).withColumn("__number", number), ["__text", "__number", "value"], "place")
    return placed.select("value", "n", (F.col("place") + 1).alias("place"))


def top_counts(df: DataFrame, column: str, most: int) -> DataFrame:
    """The most frequent values, ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(most)


def melt(df: DataFrame, columns: list[str]) -> DataFrame:
    """metric, value, n: the value counts of several columns in one table; nulls are left out."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    return long.select("x.*").where("value is not null").groupBy("metric", "value").agg(F.count("*").alias("n"))


def levels(df: DataFrame, keys: list[str], measures: list[Column]) -> DataFrame:
    """Measures at every prefix of the keys: all of them, fewer, and the whole; level is how many keys hold."""
    out = df.rollup(*keys).agg(F.grouping_id().alias("__id"), *measures)
    level = F.lit(len(keys)) - F.bit_count(F.col("__id"))
    return out.withColumn("level", level.cast("int")).drop("__id")


def row_mean(*columns: Column) -> Column:
    """Mean of the columns that are not null; null if all are."""
    values = F.array_compact(F.array(*columns))
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))
