"""E-mail log and exports as files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from duebook.schemas import EMAIL_LOG
from duebook.sources.fingerprints import opened

_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def append_email_log(rows: DataFrame, path: str) -> None:
    """Append to the JSON-lines log; text is written as it is, not escaped."""
    rows.select(*EMAIL_LOG.fieldNames()).write.mode("append").option("timestampFormat", _TIME).json(path)


def replace_email_log(rows: DataFrame, path: str, as_read: bool = False) -> None:
    """Write the log of whole jobs, one folder per job_id, in place of what those jobs had.

    ``as_read`` is for rows just read out of one folder per job: they make no more files than they come from, unshuffled.
    """
    rows = rows.select("job_id", *EMAIL_LOG.fieldNames())
    rows = rows if as_read else rows.hint("rebalance", "job_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
        "timestampFormat", _TIME
    ).partitionBy("job_id").json(path)


def read_email_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as written by either function."""
    return spark.read.schema(EMAIL_LOG).json(path).select(*EMAIL_LOG.fieldNames())


def export_csv(view: DataFrame, path: str) -> None:
    """Write a view with a header and without row numbers, as one folder of part files. Blanks around values stay."""
    view.write.mode("overwrite").option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_text_files(rows: DataFrame, path: str, key: str, text: str) -> None:
    """A file ``<key>=<value>.txt`` for each value of a key: the texts of its rows, each with a line end.

    Each task writes its files straight into one folder of its own. Spark's writer would make a folder for every file,
    which the driver then moves and each reader has to list.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = f"{path}/part={TaskContext.get().partitionId()}"
        system, place = opened(folder)
        system.create_dir(place, recursive=True)
        last, stream, n = None, None, 0
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = "__HIVE_DEFAULT_PARTITION__" if name is None else str(name)
                if name != last:
                    if stream:
                        stream.close()
                    last, stream, n = name, system.open_output_stream(f"{place}/{key}={name}.txt"), n + 1
                stream.write((value or "").encode() + b"\n")
        if stream:
            stream.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows.select(key, text).repartition(key).sortWithinPartitions(key).mapInArrow(write, "n long").agg({"n": "sum"}).collect()
