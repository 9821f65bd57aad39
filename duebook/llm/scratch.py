"""Tables a job writes for itself in the shared folder, and drops once the next one is written."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from duebook.session import fresh_dir


class Scratch:
    """Tables by name in one folder of the shared one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, fresh_dir(spark, name)

    def put(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        """Write a table and read it back, so that nothing before it is computed again."""
        path = f"{self.folder}/{name}"
        df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more, and let Spark free the shuffle files of finished plans."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        gc.collect()
        self.spark._jvm.System.gc()
