"""The parquet tables of a data directory, and tables kept between stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Set only where a local session names no shared folder, which is so in tests.
_LOCAL_DIR: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as stored; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset and Spark runs in one process.

    On a cluster an unset folder is an error, as a machine's own folder would lose rows unseen.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append("file://" + tempfile.mkdtemp(prefix="figmill-"))
    return _LOCAL_DIR[0]


class Stage:
    """A table written to the shared folder: it cuts lineage and survives the loss of executors.

    ``drop`` removes it early; what is left goes when the driver's JVM ends.
    """

    def __init__(self, df: DataFrame, options: dict[str, str] | None = None):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/figmill/{uuid.uuid4().hex}"
        self._spark = spark
        df.write.options(**(options or {})).parquet(self.path)
        jvm = spark.sparkContext._jvm
        self._hadoop_path = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._hadoop_path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        self._fs.delete(self._hadoop_path, True)
