"""Session and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", **extra: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    conf = {
        "spark.master": f"local[{cores}]",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | extra
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only a local master may go without the setting; it then gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="seqloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Stage:
    """Named tables of one job in the shared folder: written once, read often.

    Writing a table cuts the lineage of an iterative job, and survives the loss of
    executors. A table can be dropped as soon as a later one replaces it; what is left
    goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/seqloom-{name}-{uuid.uuid4().hex[:12]}"
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)

    def save(self, df: DataFrame, table: str) -> DataFrame:
        path = f"{self.root}/{table}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: str) -> None:
        for table in tables:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
            self._fs.delete(path, True)
