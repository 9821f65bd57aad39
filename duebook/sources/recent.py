"""Rows in folders by time, so that the newest pages open only the newest folders."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duebook.session import write_and_read
from duebook.sources.tables import _file_system, no_rows


@dataclass(frozen=True)
class Folder:
    """The ``width`` spans that end with ``last``; those of rows without a time have no number."""

    last: int | None
    width: int = 1

    @property
    def name(self) -> str:
        if self.last is None:
            return "__HIVE_DEFAULT_PARTITION__"
        return str(self.last) if self.width == 1 else f"{self.last}x{self.width}"

    @classmethod
    def named(cls, name: str) -> Folder:
        last, _, width = name.partition("x")
        return cls(int(last), int(width or 1)) if last.lstrip("-").isdigit() else cls(None)


class RecentTable:
    """An append-only table in folders by spans of ``seconds`` of its time column.

    An append makes one folder per span, or per 4, 16, 64... spans if it would make more than ``most_folders`` otherwise, so
    the number of files doesn't grow with the time it spreads over. The folders are named by the spans they hold,
    so a reader finds the newest by their names and never lists or opens what lies further back than it
    needs. Inside a folder rows are dealt evenly and sorted by time. Rows without a time have a folder of
    their own, the last one to be read.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, seconds: int = 86400, time: str = "created_at", most_folders: int = 1000
    ):
        if seconds < 1:
            raise ValueError("seconds must be at least 1")
        self.spark, self.path, self.schema, self.seconds, self.time = spark, path.rstrip("/"), schema, seconds, time
        self.most_folders = most_folders

    def _span(self, time: Column) -> Column:
        return F.floor(F.unix_seconds(time.cast("timestamp")) / self.seconds)

    def _width(self, rows: DataFrame) -> int:
        """How many spans go into a folder; only the time column is read, and the number of folders is estimated."""
        widths = [4**k for k in range(24)]
        spans = rows.select(self._span(F.col(self.time)).alias("_span")).distinct()
        found = spans.agg(*[F.approx_count_distinct(F.floor(F.col("_span") / w)) for w in widths]).first()
        return next((w for w, n in zip(widths, found, strict=True) if n <= self.most_folders), widths[-1])

    def append(self, rows: DataFrame) -> None:
        rows = write_and_read(rows.select(*self.schema.fieldNames()), "recent-rows")
        width = self._width(rows)
        last = F.floor(self._span(F.col(self.time)) / width) * width + width - 1
        name = last.cast("string") if width == 1 else F.concat(last.cast("string"), F.lit(f"x{width}"))
        rows = rows.withColumn("_span", name)
        rows.hint("rebalance", "_span").sortWithinPartitions("_span", F.col(self.time).desc()).write.mode(
            "append"
        ).partitionBy("_span").parquet(self.path)

    def folders(self) -> list[Folder]:
        """The folders, those that end last first, that of the rows without a time last."""
        folder, fs = _file_system(self.spark, self.path)
        if not fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        found = [Folder.named(name.removeprefix("_span=")) for name in names if name.startswith("_span=")]
        return sorted(found, key=lambda one: (one.last is not None, one.last or 0, one.width), reverse=True)

    def spans(self) -> list[int | None]:
        """Numbers of the last spans of the folders, newest first, that of the rows without a time last."""
        return [one.last for one in self.folders()]

    def _read(self, folders: list[Folder]) -> DataFrame:
        if not folders:
            return no_rows(self.spark, self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/_span={one.name}" for one in folders))

    def read(self) -> DataFrame:
        return self._read(self.folders())

    def newest(
        self, rows: int, view: Callable[[DataFrame], DataFrame] = lambda table: table, at: dt.datetime | None = None
    ) -> DataFrame:
        """``view`` of the newest folders, as many as give it ``rows`` rows, or of all.

        ``at`` leaves out folders after that time. The number of folders read doubles until it's enough, so
        at most about twice what is needed is read, however long the history. Only rows later than all folders that
        are left count, as a wide folder may reach back behind the next ones. The newest ``rows`` rows of the
        view are among those returned; sort and cut them.
        """
        folders = self.folders()
        if at is not None:
            until = self.spark.range(1).select(self._span(F.lit(at))).first()[0]
            folders = [one for one in folders if one.last is None or one.last - one.width < until]
        take = 1
        while True:
            some = self._read(folders[:take])
            found = view(some)
            if take >= len(folders):
                return found
            left = folders[take].last
            later = some if left is None else some.filter(self._span(F.col(self.time)) > left)
            if view(later).limit(rows).count() >= rows:
                return found
            take *= 2
