"""Folders per micro-batch: a batch run again after a failure overwrites its own and leaves the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id:012d}"


def write_batch(rows: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Write a batch's rows and read them back from its folder."""
    folder = batch_folder(path, batch_id)
    rows.write.mode("overwrite").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def read_batches(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of all batches."""
    reader = spark.read if schema is None else spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())]))
    return reader.parquet(path).drop("batch")


def stream_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of the batches as a stream."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path)
