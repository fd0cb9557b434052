"""Samples that match target category proportions, and a report of what the records could not fill."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figmill.operators.joins import broadcast_if_small
from figmill.sources.tables import Stage

CATEGORIES = ["subject", "subtype", "complexity_level"]
#: Cells are combinations of known names and null, so their number is bounded by the lists of names, not by the rows.
MAX_CELLS = 1_000_000
RANK_BUCKETS = 4096


def _matches(cell: tuple, quota: tuple) -> bool:
    return all(q is None or q == c for c, q in zip(cell, quota, strict=True))


def rake(counts: np.ndarray, margins: list[tuple[list[np.ndarray], list[float]]], size: float, rounds: int = 200) -> np.ndarray:
    """Expected rows of each cell by iterative proportional fitting, at most ``counts`` a cell.

    margins: for each category margin the member masks of its quotas and their shares of ``size``; cells in no quota
    of a margin share what is left of 1.
    """
    take = counts * min(1.0, size / max(counts.sum(), 1))
    for _ in range(rounds):
        was = take.copy()
        for masks, shares in margins:
            rest = ~np.any(masks, axis=0) if masks else np.ones(len(counts), bool)
            for mask, share in [*zip(masks, shares, strict=True), (rest, max(0.0, 1 - sum(shares)))]:
                for _ in range(8):  # a full cell leaves its share to the others of its quota
                    free = mask & (take < counts) & (take > 0)
                    lack = share * size - take[mask].sum()
                    if lack > 0 and free.any():
                        take[free] *= 1 + lack / take[free].sum()
                        take = np.minimum(take, counts)
                    else:
                        break
                if lack < 0:
                    take[mask] *= share * size / take[mask].sum()
        if np.abs(take - was).max(initial=0) < 1e-9:
            break
    return take


class Draw:
    """The cells, quotas and raked weights of one draw, all on the driver: their number is bounded by the lists of names."""

    def __init__(self, cells: dict[tuple, int], quotas: list[dict], records: int):
        self.keys = sorted(cells, key=lambda c: tuple((x is not None, x or "") for x in c))
        self.counts = np.array([cells[k] for k in self.keys], float)
        self.size = quotas[0]["size_permille"] * records // 1000 if quotas else 0
        self.masks = [np.array([_matches(k, tuple(q[c] for c in CATEGORIES)) for k in self.keys], bool) for q in quotas]
        self.needs = [min(max(q["min_rows"], q["target_permille"] * self.size // 1000), int(self.counts[m].sum())) for q, m in zip(quotas, self.masks, strict=True)]
        by_margin: dict[tuple, list[int]] = {}
        for i, q in enumerate(quotas):
            by_margin.setdefault(tuple(q[c] is not None for c in CATEGORIES), []).append(i)
        margins = [([self.masks[i] for i in ids], [quotas[i]["target_permille"] / 1000 for i in ids]) for ids in by_margin.values()]
        self.wish = rake(self.counts, margins, self.size) if self.keys else self.counts

    def weights(self) -> dict[tuple, float]:
        """Rate of the exponential key of each cell's records: with it, a record is drawn with the raked probability, wish / count."""
        share = np.clip(self.wish / np.maximum(self.counts, 1), 0, 1 - 1e-9)
        return {k: float(-math.log1p(-p)) for k, p in zip(self.keys, share, strict=True) if p > 0}

    def repaired(self, drawn: dict[tuple, int]) -> dict[tuple, int]:
        """Rows of each cell after the drawn ones are repaired to every quota's minimum.

        A quota needs the greater of min_rows and floor(target_permille * size / 1000) rows, as far as there are so
        many. Where it has fewer, rows of its fullest-remaining cells are added and, if no quota falls below its need
        by it, taken from others, so that the size stays; where that is impossible the needs count more than the size.
        """
        take = np.array([drawn.get(k, 0) for k in self.keys], float)
        for mask, need in zip(self.masks, self.needs, strict=True):
            while (lack := need - int(take[mask].sum())) > 0:
                room = np.where(mask, self.counts - take, 0)
                i = int(np.argmax(room))
                take[i] += min(lack, math.ceil(room[i] / 2), room[i])
        for i in np.argsort(-take, kind="stable"):  # give back what the repair added beyond the size
            spare = min([take[i], take.sum() - self.size, *(take[m].sum() - n for m, n in zip(self.masks, self.needs, strict=True) if m[i])])
            take[i] -= max(0, int(spare))
        return {k: int(t) for k, t in zip(self.keys, take, strict=True) if t > 0}


def take_by_key(rows: DataFrame, plan: DataFrame, strata: list[str], key: str, tie: str) -> DataFrame:
    """Of each stratum the ``take`` rows of greatest ``key`` in [0, 1), then smallest ``tie``; plan: (strata, take).

    Keys are first counted in RANK_BUCKETS equal ranges; only rows of the range that holds the last row taken are
    ranked, so that a stratum with a third of all rows is never sorted in one task.
    """
    bucket = F.least(F.lit(RANK_BUCKETS - 1), F.floor(F.col(key) * RANK_BUCKETS).cast("int"))
    rows = rows.withColumn("__bucket", bucket)
    counts = rows.groupBy(*strata, "__bucket").agg(F.count("*").alias("__n"))
    down = W.partitionBy(*strata).orderBy(F.desc("__bucket"))
    counts = counts.withColumn("__upto", F.sum("__n").over(down)).join(plan, strata)
    edge = F.max(F.when(F.col("__upto") >= F.col("take"), F.struct("__bucket", (F.col("take") - F.col("__upto") + F.col("__n")).alias("left"))))
    edges = counts.groupBy(*strata).agg(edge.alias("__edge"))
    edges = edges.select(*strata, F.coalesce(F.col("__edge.__bucket"), F.lit(-1)).alias("__at"), F.coalesce(F.col("__edge.left"), F.lit(0)).alias("__left"))
    rows = rows.join(broadcast_if_small(edges), strata).where(F.col("__bucket") >= F.col("__at"))
    ranked = rows.where(F.col("__bucket") == F.col("__at")).withColumn("__rank", F.row_number().over(W.partitionBy(*strata).orderBy(F.desc(key), tie)))
    return rows.where(F.col("__bucket") > F.col("__at")).drop("__bucket", "__at", "__left").unionByName(ranked.where("__rank <= __left").drop("__bucket", "__at", "__left", "__rank"))


def draw(labelled: DataFrame, quotas: DataFrame, id_column: str = "panel_id", seed: str = "") -> tuple[DataFrame, DataFrame]:
    """(sample, report) of each draw of ``quotas`` from ``labelled`` (id, categories).

    sample: draw_name, id. report: quota_no, draw_name, needed, available, drawn, gap, where available counts the
    records that name every non-null category of the quota, and gap is what is missing from needed. Records whose
    labels are null match only quotas that leave these categories open.

    Every record has an exponential key -ln(u) / weight in every draw, with u from a hash of ``seed``, its id and the draw and the
    raked weight of its cell; the records of least keys, as many as the draw's size, are drawn. Then minimums are repaired: a cell gives
    or takes the records next in the order of their keys. The same seed gives the same draw. The counts of cells, at most
    MAX_CELLS, are planned on the driver; records stay distributed.
    """
    spark = labelled.sparkSession
    cells = labelled.groupBy(*CATEGORIES).agg(F.count("*").alias("n")).limit(MAX_CELLS + 1).collect()
    if len(cells) > MAX_CELLS:
        raise ValueError("too many cells: labels must be known names")
    counts = {tuple(r[c] for c in CATEGORIES): r["n"] for r in cells}
    records = sum(counts.values())
    by_draw: dict[str, list[dict]] = {}
    for q in quotas.orderBy("quota_no").collect():
        by_draw.setdefault(q["draw_name"], []).append(q.asDict())
    draws = {name: Draw(counts, qs, records) for name, qs in sorted(by_draw.items())}
    code = ["draw_name", "c0", "c1", "c2"]
    coded = lambda cell: [x or "\0" for x in cell]  # noqa: E731  # no known name has this character
    at = lambda what: f"draw_name string, c0 string, c1 string, c2 string, {what}"
    weights = spark.createDataFrame([(name, *coded(cell), w) for name, d in draws.items() for cell, w in d.weights().items()], at("weight double"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_column, "draw_name"), 11) / F.lit(float(1 << 53))
    names = F.array(*[F.lit(x) for x in draws]) if draws else F.array().cast("array<string>")
    entries = labelled.select(id_column, *[F.coalesce(F.col(c), F.lit("\0")).alias(f"c{i}") for i, c in enumerate(CATEGORIES)], F.explode(names).alias("draw_name"))
    # 1 / (1 + key) has the order of keys turned round and lies in 0 to 1, as take_by_key wants it. Cells of no weight come last.
    key = -F.log(F.greatest(u, F.lit(1e-300))) / F.col("weight")
    entries = entries.join(broadcast_if_small(weights), code, "left").select(id_column, *code, F.coalesce(1 / (1 + key), F.lit(0.0)).alias("__key"))
    entries = Stage(entries).df
    sizes = spark.createDataFrame([(name, d.size) for name, d in draws.items()], "draw_name string, take long")
    first = take_by_key(entries.where("__key > 0"), sizes, ["draw_name"], "__key", id_column)
    drawn: dict[str, dict[tuple, int]] = {}
    for r in first.groupBy(*code).agg(F.count("*").alias("n")).collect():  # cells of draws, as bounded as the weights
        drawn.setdefault(r["draw_name"], {})[tuple(None if r[c] == "\0" else r[c] for c in code[1:])] = r["n"]
    plan = [(name, *coded(cell), t) for name, d in draws.items() for cell, t in d.repaired(drawn.get(name, {})).items()]
    sample = Stage(take_by_key(entries, spark.createDataFrame(plan, at("take long")), code, "__key", id_column)).df
    taken = sample.groupBy(*code).agg(F.count("*").alias("drawn"))
    every = [(name, *coded(cell), n) for name in draws for cell, n in counts.items()]
    every = spark.createDataFrame(every, at("available long"))
    patterns = F.array(*[F.struct(*[F.lit("\1").alias(f"k{i}") if b >> i & 1 else F.col(f"c{i}").alias(f"k{i}") for i in range(3)]) for b in range(8)])
    sums = every.join(broadcast_if_small(taken), code, "left").select("draw_name", "available", F.coalesce("drawn", F.lit(0)).alias("drawn"), F.explode(patterns).alias("k"))
    sums = sums.groupBy("draw_name", "k").agg(F.sum("available").alias("available"), F.sum("drawn").alias("drawn"))
    sums = sums.select("draw_name", "k.*", "available", "drawn")
    size = F.floor(F.col("size_permille").cast("long") * records / 1000).cast("long")
    needed = F.greatest(F.col("min_rows").cast("long"), F.floor(F.col("target_permille").cast("long") * size / 1000).cast("long"))
    asked = quotas.select("quota_no", "draw_name", *[F.coalesce(F.col(c), F.lit("\1")).alias(f"k{i}") for i, c in enumerate(CATEGORIES)], needed.alias("needed"))
    report = asked.join(sums, ["draw_name", "k0", "k1", "k2"], "left")
    report = report.select("quota_no", "draw_name", "needed", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("drawn", F.lit(0)).alias("drawn"))
    return sample.select("draw_name", id_column), report.withColumn("gap", F.greatest(F.lit(0), F.col("needed") - F.col("drawn")))
