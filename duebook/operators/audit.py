"""First-wins append to the audit table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

AUDIT_KEY = ["job_id", "invoice_no", "send_status", "retry_count"]


def first_per_key(rows: DataFrame, order_by: list[str | Column], key: list[str] = AUDIT_KEY) -> DataFrame:
    """The earliest row of every key.

    Written as ``row_number() = 1``, which Spark also applies before the shuffle: each task hands
    on one row per key, however many rows share it.
    """
    place = F.row_number().over(W.partitionBy(*key).orderBy(*order_by))
    return rows.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")


def oldest_first(rows: DataFrame) -> list[Column]:
    """Earliest row first; rows of one time in an order that a task run again finds too."""
    return [F.col("created_at"), F.xxhash64(*rows.columns), *[F.col(c) for c in rows.columns]]


def same_key(left: DataFrame, right: DataFrame, key: list[str]) -> Column:
    """Equality on all key columns; two nulls are equal, so a rerun adds nothing."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in key])


def key_counts(rows: DataFrame, existing: DataFrame | None = None, key: list[str] = AUDIT_KEY) -> Row:
    """How many keys of ``rows`` the table has (``known``) or not (``fresh``), and how many fresh ones several rows share (``repeated``).

    Two nulls are equal. Only the key columns are read, and counts are combined before the shuffle.
    """
    marked = rows.select(*key, F.lit(False).alias("_old"))
    if existing is not None:
        marked = marked.unionByName(existing.select(*key, F.lit(True).alias("_old")))
    per_key = marked.groupBy(*key).agg(F.count_if(~F.col("_old")).alias("_n"), F.bool_or("_old").alias("_known"))
    known = F.col("_known")
    return per_key.filter(F.col("_n") > 0).agg(
        F.count_if(known).alias("known"),
        F.count_if(~known).alias("fresh"),
        F.count_if(~known & (F.col("_n") > 1)).alias("repeated"),
    ).first()


def append_new(
    table, rows: DataFrame, jobs: list, attempt_column: str | None = None, by_job: bool = False
) -> None:
    """Append the ``new_audit_rows`` of some jobs to a stored table.

    The keys are counted first. Whole rows are only shuffled for a key that comes twice or is there already, and
    nothing is written if there is nothing new. ``by_job`` says that the rows are read out of one folder per job.
    """
    existing = table.read(jobs)
    counts = key_counts(rows, existing, _audit_key(attempt_column))
    if counts["fresh"]:
        as_read = by_job and not counts["repeated"] and not counts["known"]
        table.append(new_audit_rows(rows, existing, attempt_column=attempt_column, counts=counts), as_read)


def _audit_key(attempt_column: str | None) -> list[str]:
    return AUDIT_KEY + ([attempt_column] if attempt_column else [])


def new_audit_rows(
    rows: DataFrame,
    existing: DataFrame,
    order_by: list[str | Column] | None = None,
    attempt_column: str | None = None,
    counts: Row | None = None,
) -> DataFrame:
    """Rows to append: the first of each key, unless the key is in the table already.

    ``attempt_column`` joins the key where a row per retry is wanted; without it a second failure
    with the same retry count is dropped. ``counts``, the ``key_counts`` of both, leaves out the steps they need not.
    """
    key = _audit_key(attempt_column)
    first = rows
    if counts is None or counts["repeated"]:
        first = first_per_key(rows, order_by or oldest_first(rows), key)
    if counts is not None and not counts["known"]:
        return first
    known = existing.select(*key)
    return first.join(known, same_key(first, known, key), "left_anti")


def append_audit(
    rows: DataFrame, existing: DataFrame, order_by: list[str | Column] | None = None
) -> DataFrame:
    """The audit table after the append."""
    return existing.unionByName(new_audit_rows(rows, existing, order_by))


def audit_of_job(audit: DataFrame, job_id: int, order_by: tuple[str, ...] = ("created_at", "invoice_no")) -> DataFrame:
    return audit.filter(F.col("job_id") == job_id).orderBy(*order_by)
