"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000


@dataclass(frozen=True)
class HotKeys:
    """Keys with more rows than one task should get, each with the parts to cut it into (``_parts``)."""

    table: DataFrame


def find_hot_keys(
    rows: DataFrame, key: list[str], rows_per_task: int = ROWS_PER_TASK, fraction: float = 0.01
) -> HotKeys | None:
    """Estimate from a sample which keys are too large; None if there are none.

    Only the key columns are read. A key has to have ``rows_per_task`` rows, so there are at most as
    many as the table has such shares; the estimate decides how rows are spread, never which there are.
    """
    counts = rows.select(*key).sample(fraction, seed=7).groupBy(*key).agg(F.count("*").alias("_n"))
    found = counts.filter(F.col("_n") >= rows_per_task * fraction).collect()
    if not found:
        return None
    parts = [(*r[:-1], 1 + int(r["_n"] / fraction / rows_per_task)) for r in found]
    schema = rows.select(*key, F.lit(0).alias("_parts")).schema
    return HotKeys(rows.sparkSession.createDataFrame(parts, schema))


def spread_join(left: DataFrame, right: DataFrame, key: list[str], hot: HotKeys | None) -> DataFrame:
    """Left outer join to a right side with one row per key.

    Rows of a hot key are cut into parts by their content and the partition they are read in, and
    the one right row of such a key is repeated for each part. Both tell the same part when a lost
    task is run again.
    """
    if hot is None:
        return left.join(right, key, "left")
    content = F.xxhash64(*left.columns) + F.spark_partition_id()
    parts = F.coalesce("_parts", F.lit(1))
    cut = left.join(hot.table, key, "left").withColumn("_part", F.pmod(content, parts).cast("int"))
    copies = right.join(hot.table, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return cut.drop("_parts").join(copies.drop("_parts"), [*key, "_part"], "left").drop("_part")
