"""Tables kept between runs, on plain Parquet folders."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """An empty table that the planner knows to be empty, so joins with it and tasks to read it fall away."""
    nothing = [F.lit(None).cast(field.dataType).alias(field.name) for field in schema.fields]
    return spark.range(1).select(*nothing).filter(F.lit(False))


def clear_jobs(spark: SparkSession, path: str, jobs: list, by: str = "job_id") -> None:
    """Remove the folders of some jobs from a table kept in one folder per job."""
    for job in jobs:
        folder, fs = _file_system(spark, f"{path}/{by}={job}")
        fs.delete(folder, True)


class SnapshotTable:
    """A table rewritten as a whole: each version in a folder of its own.

    A version counts once Spark has marked its folder as complete, so a run that dies halfway
    leaves the version before it in force, and no folder being read is written to. The last
    ``keep`` versions stay, for those who still read them; older ones are removed.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keep: int = 3):
        self.spark, self.path, self.schema, self.keep = spark, path.rstrip("/"), schema, keep

    def versions(self) -> list[int]:
        folder, fs = _file_system(self.spark, self.path)
        if not fs.exists(folder):
            return []
        complete = []
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            done, _ = _file_system(self.spark, f"{self.path}/{name}/_SUCCESS")
            if name.startswith("v") and name[1:].isdigit() and fs.exists(done):
                complete.append(int(name[1:]))
        return sorted(complete)

    def read(self) -> DataFrame:
        versions = self.versions()
        if not versions:
            return no_rows(self.spark, self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{versions[-1]}")

    def write(self, rows: DataFrame) -> int:
        versions = self.versions()
        version = versions[-1] + 1 if versions else 1
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(
            f"{self.path}/v{version}"
        )
        for old in versions[: max(0, len(versions) + 1 - self.keep)]:
            folder, fs = _file_system(self.spark, f"{self.path}/v{old}")
            fs.delete(folder, True)
        return version


class PartitionedTable:
    """An append-mostly table in one folder per job.

    ``replace`` overwrites just the jobs it holds, so running a job again changes nothing. Rows
    are spread with a rebalance hint: a job with most of the rows is split over many files, and
    small jobs do not end up as one file per task.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, by: str = "job_id"):
        self.spark, self.path, self.schema, self.by = spark, path, schema, by

    def read(self, only: list | None = None) -> DataFrame:
        """All rows, or those of some jobs, of which only the folders are read."""
        folder, fs = _file_system(self.spark, self.path)
        if not fs.exists(folder):
            return no_rows(self.spark, self.schema)
        rows = self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.fieldNames())
        return rows if only is None else rows.filter(F.col(self.by).isin(*only))

    def clear(self, jobs: list) -> None:
        """Remove all rows of some jobs."""
        clear_jobs(self.spark, self.path, jobs, self.by)

    def replace(self, rows: DataFrame) -> None:
        rows.select(*self.schema.fieldNames()).hint("rebalance", self.by).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(self.by).parquet(self.path)

    def append(self, rows: DataFrame, as_read: bool = False) -> None:
        """``as_read`` is for rows just read out of one folder per job: they make no more files than they come from, unshuffled."""
        rows = rows.select(*self.schema.fieldNames())
        rows = rows if as_read else rows.hint("rebalance", self.by)
        rows.write.mode("append").partitionBy(self.by).parquet(self.path)


class ConcurrentUpdate(RuntimeError):
    """Another writer has put its version in first."""


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small file in place unless there is one by that name; false if there is.

    It's written beside it and moved, which the file system refuses if the name is taken, so of several
    writers one succeeds and no reader finds half a file.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    target, fs = _file_system(spark, path)
    target = target.makeQualified(fs.getUri(), fs.getWorkingDirectory())
    beside = jvm.org.apache.hadoop.fs.Path(f"{target.toString()}.{uuid.uuid4().hex}")
    stream = fs.create(beside, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(kind, 1)
    how[0] = kind.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    try:
        context.rename(beside, target, how)
    except Py4JJavaError as refused:
        fs.delete(beside, False)
        if "FileAlreadyExistsException" not in refused.java_exception.toString():
            raise
        return False
    return True


def read_small(spark: SparkSession, path: str) -> str:
    file, fs = _file_system(spark, path)
    stream = fs.open(file)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class KeyedTable:
    """A table in parts by a hash of its key, of which an update writes only the parts it touches.

    A version is a small file that names the folder of each part; it's put in place by ``create_once``
    after the parts are written. So a writer that dies leaves the version before it in force, and of two that
    start from one version the second is refused and works its change out again on the new one. Folders that
    none of the last ``keep`` versions names are removed.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: list[str], parts: int = 64, keep: int = 3):
        self.spark, self.path, self.schema, self.key, self.parts, self.keep = spark, path.rstrip("/"), schema, key, parts, keep

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int")

    def versions(self) -> list[int]:
        folder, fs = _file_system(self.spark, f"{self.path}/versions")
        if not fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        return sorted(int(name) for name in names if name.isdigit())

    def folders(self, version: int) -> dict[int, str]:
        """The folder of each part that has rows in a version."""
        if not version:
            return {}
        listed = json.loads(read_small(self.spark, f"{self.path}/versions/{version}"))
        if listed["parts"] != self.parts:
            raise ValueError(f"the table has {listed['parts']} parts, not {self.parts}")
        return {int(part): name for part, name in listed["folders"].items()}

    def _read(self, folders: dict[int, str], only: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{name}/part={part}" for part, name in folders.items() if only is None or part in only]
        if not paths:
            return no_rows(self.spark, self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        versions = self.versions()
        return self._read(self.folders(versions[-1] if versions else 0))

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
        """Replace the rows of the parts that ``keys`` fall into by what ``change`` makes of them; the parts written.

        ``change`` must only add or alter rows with these keys. It may be called again, on the rows that another
        writer has left.
        """
        touched = sorted(row[0] for row in keys.select(self.part()).distinct().collect())
        if not touched:
            return 0
        for _ in range(tries):
            versions = self.versions()
            base = versions[-1] if versions else 0
            folders = self.folders(base)
            name = f"{base + 1}-{uuid.uuid4().hex}"
            rows = change(self._read(folders, touched)).select(*self.schema.fieldNames())
            rows.withColumn("part", self.part()).hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.path}/data/{name}")
            folder, fs = _file_system(self.spark, f"{self.path}/data/{name}")
            written = [status.getPath().getName() for status in fs.listStatus(folder)]
            written = {int(part.split("=")[1]) for part in written if part.startswith("part=")}
            if not written <= set(touched):
                raise ValueError("the change has rows of other keys")
            folders = {part: at for part, at in folders.items() if part not in touched} | dict.fromkeys(written, name)
            listed = {"parts": self.parts, "folders": folders}
            if create_once(self.spark, f"{self.path}/versions/{base + 1}", json.dumps(listed)):
                self._clean([*versions, base + 1])
                return len(touched)
            fs.delete(folder, True)
        raise ConcurrentUpdate(f"{self.path}: another writer was first {tries} times")

    def _clean(self, versions: list[int]) -> None:
        old = versions[: -self.keep]
        if not old:
            return
        used = {name for version in versions[-self.keep :] for name in self.folders(version).values()}
        gone = {name for version in old for name in self.folders(version).values()} - used
        for place in [*(f"data/{name}" for name in gone), *(f"versions/{version}" for version in old)]:
            folder, fs = _file_system(self.spark, f"{self.path}/{place}")
            fs.delete(folder, True)
