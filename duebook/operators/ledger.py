"""Jobs: an event log folded into one row per job, and the ingest decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duebook.schemas import JOB_EVENTS, JOBS

COUNTERS = ["total_records", "processed_count", "sent_count", "escalated_count", "failed_count"]


def created_events(uploads: DataFrame, now: Column) -> DataFrame:
    """First event of new jobs. ``uploads`` holds job_id, file_path and file_hash."""
    return uploads.select(
        "job_id",
        F.lit(0).cast("long").alias("seq"),
        F.lit("queued").alias("status"),
        now.alias("at"),
        F.lit(None).cast("string").alias("error_message"),
        "file_path",
        "file_hash",
    )


def status_events(jobs: DataFrame, status: Column, seq: Column, now: Column, error: Column | None = None) -> DataFrame:
    """A status change for each given job; the error text is set anew by every change."""
    return jobs.select(
        "job_id",
        seq.cast("long").alias("seq"),
        status.alias("status"),
        now.alias("at"),
        (F.lit(None) if error is None else error).cast("string").alias("error_message"),
        F.lit(None).cast("string").alias("file_path"),
        F.lit(None).cast("string").alias("file_hash"),
    ).select(*JOB_EVENTS.fieldNames())


def fold_jobs(events: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """State of every job after all its events, with its counters if given."""
    jobs = events.groupBy("job_id").agg(
        F.max("file_path").alias("file_path"),
        F.max("file_hash").alias("file_hash"),
        F.max(F.struct("at", "seq", "status", "error_message")).alias("_last"),
        F.min("at").alias("created_at"),
        F.max(F.when(F.col("status") == "running", F.col("at"))).alias("started_at"),
        F.max(F.when(F.col("status").isin("completed", "failed"), F.col("at"))).alias("completed_at"),
    )
    jobs = jobs.withColumnRenamed("job_id", "id").withColumns(
        {"status": F.col("_last.status"), "error_message": F.col("_last.error_message")}
    )
    if metrics is None:
        counters = {c: F.lit(0).cast("long") for c in COUNTERS}
    else:
        jobs = jobs.join(metrics.select(F.col("job_id").alias("id"), *COUNTERS), "id", "left")
        counters = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in COUNTERS}
    return jobs.withColumns(counters).select(*JOBS.fieldNames())


def latest_job_by_hash(jobs: DataFrame) -> DataFrame:
    """The newest job of every file hash."""
    return (
        jobs.groupBy("file_hash")
        .agg(F.max(F.struct("id", "status")).alias("_job"))
        .select("file_hash", F.col("_job.id").alias("id"), F.col("_job.status").alias("status"))
    )


def ingest_decision(fingerprints: DataFrame, jobs: DataFrame, order_by: str | None = None) -> DataFrame:
    """``decision`` for each fingerprint: in_progress, cached or new, with the job found.

    Of several new copies of one content the first by ``order_by`` (by default ``file_path``, if
    there is one) is new; the others find it in progress and have no job yet.
    """
    status = F.col("_status")
    latest = latest_job_by_hash(jobs).select(
        "file_hash", F.col("id").alias("existing_job_id"), F.col("status").alias("_status")
    )
    decision = (
        F.when(status.isin("queued", "running"), F.lit("in_progress"))
        .when(status == "completed", F.lit("cached"))
        .otherwise(F.lit("new"))
    )
    decided = fingerprints.join(latest, "file_hash", "left").withColumn("decision", decision)
    order_by = order_by or ("file_path" if "file_path" in fingerprints.columns else None)
    if order_by:
        copy = F.row_number().over(W.partitionBy("file_hash").orderBy(order_by)) > 1
        decided = decided.withColumn("_copy", copy).withColumn(
            "decision", F.when((F.col("decision") == "new") & F.col("_copy"), F.lit("in_progress")).otherwise(F.col("decision"))
        ).drop("_copy")
    return decided.withColumn(
        "existing_job_id", F.when(F.col("decision") != "new", F.col("existing_job_id"))
    ).drop("_status")


def job_by_id(jobs: DataFrame, job_id: int) -> DataFrame:
    return jobs.filter(F.col("id") == job_id)


def job_by_hash(jobs: DataFrame, file_hash: str) -> DataFrame:
    return jobs.filter(F.col("file_hash") == file_hash).orderBy(F.col("id").desc()).limit(1)


def newest_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    return jobs.orderBy(F.col("id").desc()).limit(limit)
