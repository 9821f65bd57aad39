"""Batch numbers and dispatch order over very uneven stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duebook import fixed_values as fv
from duebook.session import write_and_read

_GROUP = ["job_id", "stage_key"]


def assign_batches(
    staged: DataFrame,
    order_by: tuple[str, ...] = ("invoice_no",),
    size: int = fv.BATCH_SIZE,
    order_is_unique: bool = False,
) -> DataFrame:
    """Add ``batch_id``, ``batch_position`` and ``dispatch_position``.

    Inside each job and stage, rows in ``order_by`` order are cut into batches of ``size`` named
    ``{stage}_{n}``. A job's stages go out in the order in which their first rows appear.

    One stage can hold most rows, and one order key can be shared by many rows, so no window runs
    over a stage. Rows get a number of their own, are split into sorted ranges and numbered inside
    their range; the place where a range starts inside its stage comes from the counts of the
    ranges before it. Pass slim rows: every column given is shuffled.
    """
    order = list(order_by)
    rows = staged
    if not order_is_unique:
        rows = write_and_read(rows.withColumn("_row", F.monotonically_increasing_id()), "batch-rows")
        order.append("_row")
    ranges = write_and_read(
        rows.repartitionByRange(*_GROUP, *order)
        .sortWithinPartitions(*_GROUP, *order)
        .withColumn("_slot", F.monotonically_increasing_id()),
        "batch-ranges",
    ).withColumn("_range", F.shiftright("_slot", 33))

    runs = ranges.groupBy(*_GROUP, "_range").agg(
        F.min("_slot").alias("_first_slot"),
        F.count("*").alias("_rows"),
        F.min(F.struct(*order)).alias("_first_row"),
    )
    earlier = W.partitionBy(*_GROUP).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))

    stages = runs.groupBy(*_GROUP).agg(
        F.sum("_rows").alias("_stage_rows"), F.min("_first_row").alias("_seen")
    )
    seen_before = W.partitionBy("job_id").orderBy("_seen").rowsBetween(W.unboundedPreceding, -1)
    stages = stages.select(
        *_GROUP,
        F.coalesce(F.sum("_stage_rows").over(seen_before), F.lit(0)).alias("_stage_before"),
    )
    starts = runs.join(stages, _GROUP).select(
        *_GROUP,
        "_range",
        (F.col("_before") - F.col("_first_slot")).alias("_shift"),
        "_stage_before",
    )

    place = F.col("_slot") + F.col("_shift")
    batch = F.floor(place / F.lit(size)).cast("long") + 1
    return ranges.join(starts, [*_GROUP, "_range"]).select(
        *staged.columns,
        F.concat_ws("_", "stage_key", batch.cast("string")).alias("batch_id"),
        (place % size + 1).cast("int").alias("batch_position"),
        (F.col("_stage_before") + place + 1).alias("dispatch_position"),
    )


def stage_order(staged: DataFrame, order_by: tuple[str, ...] = ("invoice_no",)) -> DataFrame:
    """Per job: its stages, numbered in the order in which they first appear."""
    first = staged.groupBy(*_GROUP).agg(F.min(F.struct(*order_by)).alias("_seen"))
    place = F.row_number().over(W.partitionBy("job_id").orderBy("_seen", "stage_key"))
    return first.select(*_GROUP, place.alias("stage_position"))
