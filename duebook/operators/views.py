"""Filtered, paged and exported views of jobs, audit, e-mails and failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook import fixed_values as fv
from duebook.functions.text import short_time

EMAIL_TYPES = ["All", "Client emails", "Escalations", "No overdue"]


def jobs_view(jobs: DataFrame, statuses: list[str] | None = None, id_pattern: str = "") -> DataFrame:
    """Jobs by status (none chosen: all) and by a regular expression on the id."""
    if statuses:
        jobs = jobs.filter(F.col("status").isin(*statuses))
    if id_pattern.strip():
        jobs = jobs.filter(F.col("id").cast("string").rlike(id_pattern.strip()))
    return jobs


def audit_view(
    audit: DataFrame,
    pattern: str = "",
    statuses: list[str] | None = None,
    stages: list[str] | None = None,
) -> DataFrame:
    """Audit rows whose invoice number or client matches a pattern, whatever its case."""
    if pattern.strip():
        wanted = "(?i)" + pattern.strip()
        audit = audit.filter(F.col("invoice_no").rlike(wanted) | F.col("client").rlike(wanted))
    if statuses:
        audit = audit.filter(F.col("send_status").isin(*statuses))
    if stages:
        audit = audit.filter(F.col("stage_key").isin(*stages))
    return audit


def email_type() -> Column:
    stage = F.coalesce("stage_key", F.lit(""))
    return (
        F.when(stage == fv.STAGE_ESCALATION, F.lit("Escalations"))
        .when(stage == fv.STAGE_NOT_OVERDUE, F.lit("No overdue"))
        .otherwise(F.lit("Client emails"))
    )


def email_feed(audit: DataFrame, job_id: int | None = None, limit: int = 300) -> DataFrame:
    """The newest audit rows, of one job if given. Filters apply to what is left after this."""
    if job_id is not None:
        audit = audit.filter(F.col("job_id") == job_id)
    return audit.orderBy(F.col("created_at").desc(), "job_id", "invoice_no").limit(limit)


def email_view(feed: DataFrame, status: str = "All", kind: str = "All", search: str = "") -> DataFrame:
    """Feed rows by status, type and plain text in invoice number and client run together."""
    if kind not in EMAIL_TYPES:
        raise ValueError(f"kind must be one of {EMAIL_TYPES}")
    if status != "All":
        feed = feed.filter(F.col("send_status") == status)
    if kind != "All":
        feed = feed.filter(email_type() == kind)
    if search.strip():
        text = F.lower(
            F.concat(
                F.coalesce("invoice_no", F.lit("None")), F.coalesce("client", F.lit("None"))
            )
        )
        feed = feed.filter(text.contains(search.strip().lower()))
    return feed


def email_page(view: DataFrame, page_size: int = 20, pages: int = 1) -> DataFrame:
    """The first pages of a view, newest first, escalations ahead of the rest."""
    newest = [F.col("created_at").desc(), "job_id", "invoice_no"]
    shown = view.orderBy(*newest).limit(page_size * pages)
    return shown.orderBy(F.col("escalation_required").desc(), *newest)


def next_page(view: DataFrame, after: tuple | None, page_size: int = 20) -> DataFrame:
    """The page after the row (created_at, job_id, invoice_no), without reading past pages."""
    if after is not None:
        at, job, number = (F.lit(v) for v in after)
        same_time = F.col("created_at") == at
        view = view.filter(
            (F.col("created_at") < at)
            | (same_time & (F.col("job_id") > job))
            | (same_time & (F.col("job_id") == job) & (F.col("invoice_no") > number))
        )
    return view.orderBy(F.col("created_at").desc(), "job_id", "invoice_no").limit(page_size)


def failures_view(queue: DataFrame, statuses: list[str] | None = None, search: str = "") -> DataFrame:
    """Queue entries by status and by plain text in any column; times cut to seconds."""
    shown = queue.select(
        *[
            short_time(F.col(f.name)).alias(f.name) if f.dataType.typeName().startswith("timestamp") else f.name
            for f in queue.schema.fields
        ]
    )
    if statuses:
        shown = shown.filter(F.lower("status").isin(*statuses))
    if search.strip():
        text = F.concat_ws(
            " ", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in shown.columns]
        )
        shown = shown.filter(F.lower(text).contains(search.strip().lower()))
    return shown


def active_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.lower("status").isin("running", "queued"))


def filter_options(table: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column in order, for a filter box."""
    return (
        table.filter(F.col(column).isNotNull())
        .select(F.col(column).cast("string").alias("option"))
        .distinct()
        .orderBy("option")
    )


def preview(table: DataFrame, rows: int = 5, order_by: tuple[str, ...] = ()) -> DataFrame:
    """5 to 100 rows of a table: the first ones in an order, or any."""
    table = table.orderBy(*order_by) if order_by else table
    return table.limit(min(max(rows, 5), 100))


