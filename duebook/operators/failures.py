"""The queue of failed invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook import fixed_values as fv
from duebook.operators.audit import first_per_key
from duebook.operators.validation import KEY
from duebook.schemas import FAILED, INVOICE_STATE


def upsert_failures(
    queue: DataFrame, new: DataFrame, order_by: list[str | Column] | None = None, one_each: bool = False
) -> DataFrame:
    """The queue after new failures: a new entry replaces the old one but for ``created_at``.

    Of several new entries for one invoice the latest stays (``order_by`` names the newest first). ``one_each`` says
    that there are no such, so none are looked for.
    """
    latest = new if one_each else first_per_key(new, order_by or newest_first(new), KEY)
    marked = latest.select(
        *KEY, F.struct(*[c for c in FAILED.fieldNames() if c not in KEY]).alias("_new")
    )
    merged = queue.join(marked, KEY, "full_outer")
    replaced = F.col("_new").isNotNull()
    return merged.select(
        *KEY,
        *[
            F.when(replaced, F.col("_new")[c]).otherwise(F.col(c)).alias(c)
            for c in FAILED.fieldNames()
            if c not in {*KEY, "created_at"}
        ],
        F.coalesce("created_at", F.col("_new.created_at")).alias("created_at"),
    ).select(*FAILED.fieldNames())


def newest_first(rows: DataFrame) -> list[Column]:
    """Latest change first; rows of one time in an order that a task run again finds too."""
    return [F.col("updated_at").desc(), F.xxhash64(*rows.columns), *[F.col(c) for c in rows.columns]]


def resolve_settled(queue: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The queue with the entries resolved whose invoice has an outcome that is neither failed nor waiting.

    An invoice number with several outcomes is settled if none of them is failed or waiting.
    """
    open_ = F.col("send_status").isin("failed", "pending")
    settled = outcomes.groupBy(*KEY).agg(F.count_if(open_).alias("_open")).filter(F.col("_open") == 0)
    rows = queue.join(settled.withColumn("_settled", F.lit(True)).drop("_open"), KEY, "left")
    ends = F.coalesce("_settled", F.lit(False)) & (F.col("status") == "pending")
    changes = {
        "status": F.when(ends, F.lit("resolved")).otherwise(F.col("status")),
        "updated_at": F.when(ends, now).otherwise(F.col("updated_at")),
    }
    return rows.select(*[changes.get(c, F.col(c)).alias(c) for c in FAILED.fieldNames()])


def closed_keys(queue: DataFrame, outcomes: DataFrame, jobs: list) -> DataFrame:
    """Keys of pending entries of some jobs whose invoice has no failed or waiting outcome.

    Those are invoices that were settled, and those that a rerun of the job has quarantined or no longer holds.
    """
    pending = queue.filter((F.col("status") == "pending") & F.col("job_id").isin(*jobs)).select(*KEY)
    still = outcomes.filter(F.col("send_status").isin("failed", "pending")).select(*KEY)
    return pending.join(still, KEY, "left_anti")


def close_entries(queue: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """The queue with the pending entries of ``keys`` resolved."""
    closed = keys.select(*KEY).distinct().withColumn("_closed", F.lit(True))
    rows = queue.join(closed, KEY, "left")
    ends = F.col("_closed").isNotNull() & (F.col("status") == "pending")
    changes = {
        "status": F.when(ends, F.lit("resolved")).otherwise(F.col("status")),
        "updated_at": F.when(ends, now).otherwise(F.col("updated_at")),
    }
    return rows.select(*[changes.get(c, F.col(c)).alias(c) for c in FAILED.fieldNames()])


def due_failures(queue: DataFrame, now: Column, limit: int | None = fv.RETRY_BATCH) -> DataFrame:
    """Pending entries whose time has come, oldest first, permanent errors included.

    ``limit=None`` takes all of them, unordered.
    """
    due = queue.filter((F.col("status") == "pending") & (F.col("next_retry_at") <= now))
    return due if limit is None else due.orderBy("next_retry_at", *KEY).limit(limit)


def latest_failures(queue: DataFrame, limit: int = 500) -> DataFrame:
    return queue.orderBy(F.col("updated_at").desc(), *KEY).limit(limit)


def read_states(queue: DataFrame) -> DataFrame:
    """Decode the stored state into ``state``; ``payload_error`` marks the unreadable ones."""
    state = F.from_json("invoice_state_json", INVOICE_STATE, {"mode": "PERMISSIVE"})
    return queue.withColumn("state", state).withColumn(
        "payload_error",
        F.col("state").isNull()
        | F.col("state.invoice").isNull()
        | F.col("state.invoice.invoice_no").isNull(),
    )


def split_states(queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable entries, entries that would stay pending for ever)."""
    read = read_states(queue)
    return read.filter(~F.col("payload_error")), read.filter("payload_error")
