"""Top N items of every group, read from row groups in descending maximum score with statistics-guided skipping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figmill.llm.caps import capped
from figmill.operators.joins import broadcast_if_small
from figmill.sources.tables import Stage

FOOTERS = "name string, path string, starts array<long>"
ROWS = "g string, score double, id string"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def _footers(batches):
    """The first row of each row group of the files named in ``path``."""
    import pandas as pd
    import pyarrow.parquet as pq

    for pdf in batches:
        out = []
        for uri in pdf["path"]:
            fs, path = _fs(uri)
            meta, starts = pq.ParquetFile(path, filesystem=fs).metadata, [0]
            for k in range(meta.num_row_groups):
                starts.append(starts[-1] + meta.row_group(k).num_rows)
            out.append((uri.rsplit("/", 1)[-1], uri, starts[:-1]))
        yield pd.DataFrame(out, columns=["name", "path", "starts"])


def _read(n: int):
    """Reads the row groups named in ``path`` and ``row_group``: of each batch the first ``n`` distinct rows of a group, as rows are in order."""

    def run(batches):
        import pyarrow.parquet as pq

        for pdf in batches:
            for uri, part in pdf.groupby("path"):
                fs, path = _fs(uri)
                file = pq.ParquetFile(path, filesystem=fs)
                for k in sorted(part["row_group"]):
                    for batch in file.iter_batches(row_groups=[k], columns=["g", "score", "id"]):
                        rows = batch.to_pandas()[["g", "score", "id"]].drop_duplicates()
                        yield rows.groupby("g", sort=False).head(n)

    return run


@dataclass
class Clustered:
    """Rows (g, score, id) in files, and for each row group the rows and maximum of every group in it: (path, row_group, g, n, most)."""

    stage: Stage
    index: DataFrame


def cluster(rows: DataFrame, group: str, score: str, id_column: str, row_group_bytes: int = 8 << 20) -> Clustered:
    """Files clustered by group, each by descending score, and their index.

    Spark rebalances the files by size, so that a group with a third of all rows is spread over many of them. As the best rows of
    all groups of a file are in its first row groups, the others are skipped even where a row group holds many groups. The index is made from the
    columns of group and score alone; it can be kept for any later N. Rows with a null group, score or id and NaN scores have no
    place in an order and are left out.
    """
    usable = rows.select(F.col(group).alias("g"), F.col(score).cast("double").alias("score"), F.col(id_column).alias("id"))
    usable = usable.where("g is not null and score is not null and not isnan(score) and id is not null")
    ordered = usable.hint("rebalance", "g").sortWithinPartitions(F.desc("score"), "id")
    stage = Stage(ordered, {"parquet.block.size": str(row_group_bytes), "parquet.block.size.row.check.min": "100"})
    spark = rows.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(stage.path).select("path")
    footers = Stage(files.mapInPandas(_footers, FOOTERS)).df
    placed = stage.df.select("g", "score", F.col("_metadata.file_name").alias("name"), F.col("_metadata.row_index").alias("at"))
    placed = placed.join(broadcast_if_small(footers), "name").withColumn("row_group", F.size(F.filter("starts", lambda x: x <= F.col("at"))) - 1)
    index = placed.groupBy("path", "row_group", "g").agg(F.count("*").alias("n"), F.max("score").alias("most"))
    return Clustered(stage, Stage(index).df)


def waves(data: Clustered, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(best, first, later): the first row groups read, the n best rows of each group in them, and the row groups still to be read.

    First, for each group, come the row groups of its highest maxima until n rows are covered. Then the n-th score of every group is known,
    and a row group is skipped if its maximum of every group in it is strictly below that group's n-th score.
    """
    before = F.sum("n").over(W.partitionBy("g").orderBy(F.desc("most"), "path", "row_group").rowsBetween(W.unboundedPreceding, -1))
    first = Stage(data.index.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < n).select("path", "row_group").distinct()).df
    best = Stage(capped(_rows(first, n).distinct(), "g", n, _order())).df
    nth = best.groupBy("g").agg(F.when(F.count("*") >= n, F.min("score")).alias("nth"))
    later = data.index.join(nth, "g", "left").where(F.col("nth").isNull() | (F.col("most") >= F.col("nth")))
    later = later.select("path", "row_group").distinct().join(first, ["path", "row_group"], "left_anti")
    return best, first, later


def _order() -> list[Column]:
    return [F.desc("score"), F.asc("id")]


def _rows(which: DataFrame, n: int) -> DataFrame:
    return which.repartition("path", "row_group").mapInPandas(_read(n), ROWS)


def top_per_group(rows: DataFrame, group: str, score: str, id_column: str, n: int, row_group_bytes: int = 8 << 20) -> DataFrame:
    """group, score, id of the ``n`` rows of each group with the highest score, then the smallest id.

    Rows are clustered and read in two waves of row groups, all others skipped; the result is exact. Rows that ``cluster`` leaves out have no
    place; equal rows count once.
    """
    best, _, later = waves(cluster(rows, group, score, id_column, row_group_bytes), n)
    merged = capped(best.unionByName(_rows(later, n)).distinct(), "g", n, _order())
    return merged.select(F.col("g").alias(group), F.col("score").alias(score), F.col("id").alias(id_column))


def skips(rows: DataFrame, group: str, score: str, id_column: str, n: int, row_group_bytes: int = 8 << 20) -> DataFrame:
    """row_groups, first, later, skipped: how many row groups there are, are read in each wave, and are not read."""
    data = cluster(rows, group, score, id_column, row_group_bytes)
    _, first, later = waves(data, n)
    counts = data.index.agg(F.count_distinct("path", "row_group").alias("row_groups")).crossJoin(first.agg(F.count("*").alias("first"))).crossJoin(later.agg(F.count("*").alias("later")))
    return counts.withColumn("skipped", F.col("row_groups") - F.col("first") - F.col("later"))
