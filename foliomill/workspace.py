"""Written intermediates in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a new one of this machine in local mode (tests); on a cluster that is an error."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if not base:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = given.get() if given.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="foliomill-")
        spark.sparkContext.setCheckpointDir(base)
    return base


class Workspace:
    """Written intermediates of one job, in the shared folder.

    A written table cuts lineage: a lost executor costs its running tasks, not the stages before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self, *names: str) -> None:
        """Delete intermediates that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
