"""One retry cycle over the queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook.functions.dates import days_overdue, parse_due_date
from duebook.functions.errors import next_retry_at
from duebook.operators.normalize import stage_for
from duebook.operators.validation import KEY
from duebook.schemas import FAILED, stage_table


def apply_results(queue: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """The queue after a cycle. ``results`` holds job_id, invoice_no, send_status, send_error.

    Anything but ``failed`` resolves the entry, an escalation too. A failure counts one more retry
    and either waits again or, at its limit, becomes permanent. Entries without a result stay.
    """
    one_each = results.groupBy(*KEY).agg(
        F.min(F.struct("send_status", "send_error")).alias("_result")
    )
    rows = queue.join(one_each, KEY, "left")
    tried = F.col("_result").isNotNull()
    failed = tried & (F.col("_result.send_status") == "failed")
    count = F.col("retry_count") + F.when(failed, F.lit(1)).otherwise(F.lit(0))
    spent = failed & (count >= F.col("max_retries"))
    changes = {
        "retry_count": count,
        "status": F.when(spent, F.lit("permanent_failure"))
        .when(failed, F.lit("pending"))
        .when(tried, F.lit("resolved"))
        .otherwise(F.col("status")),
        "next_retry_at": F.when(spent, F.lit(None).cast("timestamp"))
        .when(failed, next_retry_at(now, count))
        .otherwise(F.col("next_retry_at")),
        "error_message": F.when(failed, F.col("_result.send_error")).otherwise(
            F.col("error_message")
        ),
        "updated_at": F.when(tried, now).otherwise(F.col("updated_at")),
    }
    return rows.select(*[changes.get(c, F.col(c)).alias(c) for c in FAILED.fieldNames()])


def restored_invoices(
    readable: DataFrame, restage_at: Column | None = None, date_mode: str = "dayfirst"
) -> DataFrame:
    """Queue entries with decoded ``state`` as staged invoices, ready to be decided again.

    The stored days, stage and retry count are used as they are. ``restage_at`` works days and
    stage out anew for that date.
    """
    state, meta, invoice = F.col("state"), F.col("state.stage_meta"), F.col("state.invoice")
    rows = readable.select(
        "job_id",
        invoice["invoice_no"].alias("invoice_no"),
        invoice["client"].alias("client"),
        invoice["amount"].alias("amount"),
        invoice["amount"].cast("double").alias("amount_raw"),
        invoice["due_date"].alias("due_date_text"),
        invoice["contact_email"].alias("contact_email"),
        invoice["followup_count"].alias("followup_count"),
        state["retry_count"].alias("retry_count"),
        state["max_retries"].alias("max_retries"),
        state["payment_link"].alias("payment_link"),
        state["days_overdue"].alias("days_overdue"),
        state["stage_key"].alias("stage_key"),
        meta["followup_number"].alias("followup_number"),
        meta["tone"].alias("tone"),
        meta["key_message"].alias("key_message"),
        meta["cta"].alias("cta"),
        meta["escalation_required"].alias("escalation_required"),
        meta["subject_template"].alias("subject_template"),
    )
    if restage_at is None:
        return rows
    fresh = stage_table(readable.sparkSession)
    due = parse_due_date(F.col("due_date_text"), date_mode)
    rows = rows.drop(*[c for c in fresh.columns if c != "stage_key"])
    rows = rows.withColumn("days_overdue", days_overdue(due, restage_at))
    rows = rows.withColumn("stage_key", stage_for(F.col("days_overdue")))
    return rows.join(F.broadcast(fresh), "stage_key", "left")
