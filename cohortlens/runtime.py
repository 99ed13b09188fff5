"""Where intermediate tables go, and how they are let go again."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    It is what the session names in ``spark.checkpoint.dir``, else the checkpoint folder that has been set. Only in
    local mode, where both are one machine, a temporary folder is taken if neither is there; elsewhere that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_before = spark.sparkContext.getCheckpointDir()
    if not set_before:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        set_before = spark.sparkContext.getCheckpointDir()
    return set_before.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A written table survives the loss of any executor. Once a table is written, the shuffle files of the steps
    before it are no longer needed; ``keep`` asks the driver to collect its garbage, upon which Spark's cleaner
    deletes them. What a lazily returned result still reads stays in the folder after the job.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, label: str, tidy: bool = True) -> DataFrame:
        """Writes df under label and returns the written table; ``tidy`` false leaves the garbage to a later call."""
        path = f"{self.base}/{label}"
        df.write.option("compression", "zstd").parquet(path)
        schema = df.schema
        del df
        if tidy:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *labels: str) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for label in labels:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{label}")
            path.getFileSystem(conf).delete(path, True)


def with_fields(schema: StructType, ddl: str) -> StructType:
    """A new schema with more fields at its end."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
