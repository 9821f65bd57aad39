"""Identity of uploaded files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duebook.session import write_and_read
from duebook.sources.invoice_csv import path_exists

ONE_GIB = 1 << 30
CHUNK = 8192
# What a file counts for beside its bytes when files are dealt out to tasks; Spark's 4 MB leaves 32 files to a task.
_OPEN_COST = ("spark.sql.files.openCostInBytes", "65536")


def opened(path: str):
    """(file system, place in it) of a path as Spark writes it, in a task."""
    from pyarrow import fs

    uri = "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
    return fs.FileSystem.from_uri(uri)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = []
        for path in batch.column(0).to_pylist():
            system, place = opened(path)
            digest = hashlib.sha256()
            with system.open_input_stream(place) as stream:
                while chunk := stream.read(CHUNK):
                    digest.update(chunk)
            hashes.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes)], names=["file_path", "length", "file_hash"])


FILES = "file_path string, length long, modified_at timestamp, file_hash string"


def file_fingerprints(spark: SparkSession, path: str | list[str], whole_up_to: int = ONE_GIB) -> DataFrame:
    """file_path, length and file_hash (SHA-256 of the bytes) of every file.

    The hash is that of the content at every size. Files up to ``whole_up_to`` bytes are read as one
    value; larger ones, which a row can't hold, are read in their task in chunks of 8 KiB. The files are read when
    this is called, and the result is a stored table: small files share a task by the thousand (``_OPEN_COST``).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = [F.col("path").alias("file_path"), F.col("length")]
    small = files.filter(F.col("length") <= whole_up_to).select(*named, F.sha2("content", 256).alias("file_hash"))
    large = files.filter(F.col("length") > whole_up_to).select(*named)
    streamed = large.mapInArrow(_streamed, "file_path string, length long, file_hash string")
    before = spark.conf.get(_OPEN_COST[0])
    spark.conf.set(*_OPEN_COST)
    try:
        return write_and_read(small.unionByName(streamed), "fingerprints")
    finally:
        spark.conf.set(_OPEN_COST[0], before)


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """file_path, length and modified_at of every file, out of the listing alone: no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("file_path"), "length", F.col("modificationTime").alias("modified_at"))


def known_fingerprints(spark: SparkSession, path: str, manifest: str) -> DataFrame:
    """The fingerprints of all files, of which only new and changed ones are read.

    ``manifest`` is a table of files met before, with length, time and hash; a file is new unless it's there
    with the same length and time, and is added to it. The paths of new files are the only ones the driver holds.
    """
    schema = spark.createDataFrame([], FILES).schema
    known = spark.read.schema(schema).parquet(manifest) if path_exists(spark, manifest) else spark.createDataFrame([], schema)
    seen = ["file_path", "length", "modified_at"]
    listed = write_and_read(listed_files(spark, path), "listed")
    fresh = write_and_read(listed.join(known.select(*seen), seen, "left_anti"), "fresh")
    paths = [row["file_path"] for row in fresh.select("file_path").collect()]
    if paths:
        hashed = file_fingerprints(spark, paths).select("file_path", "file_hash")
        fresh.join(hashed, "file_path").select(*schema.fieldNames()).write.mode("append").parquet(manifest)
        known = spark.read.schema(schema).parquet(manifest)
    return listed.join(known.select(*seen, "file_hash").distinct(), seen).select("file_path", "length", "file_hash")
