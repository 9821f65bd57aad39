"""Counts and rates per job and over all jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook import fixed_values as fv
from duebook.functions.money import live_progress, mean_of, outcome_shares, percent


def counted(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def job_metrics(outcomes: DataFrame, loaded: DataFrame | None = None) -> DataFrame:
    """Counts and rates of each job. ``loaded`` may give job_id and total_records, the rows read.

    Invoices that wait for a draft or a result are not processed yet. ``escalated_count`` holds
    invoices not sent that need escalation.
    """
    status = F.col("send_status")
    metrics = outcomes.groupBy("job_id").agg(
        F.count("*").alias("_outcomes"),
        counted(status != "pending", "processed_count"),
        counted(status == "sent", "sent_count"),
        counted((status == "not_sent") & F.col("escalation_required"), "escalated_count"),
        counted(status == "failed", "failed_count"),
        counted(status == "not_sent", "not_sent_count"),
        F.sum(F.col("retry_count").cast("long")).alias("total_retries"),
    )
    if loaded is None:
        metrics = metrics.withColumnRenamed("_outcomes", "total_records")
    else:
        metrics = loaded.join(metrics.drop("_outcomes"), "job_id", "left").na.fill(0)
    return with_rates(metrics)


def with_rates(metrics: DataFrame) -> DataFrame:
    processed = F.col("processed_count")
    return metrics.withColumn("successful_count", processed - F.col("failed_count")).withColumns(
        {
            "success_rate": percent(F.col("successful_count"), processed, 2),
            "failure_rate": percent(F.col("failed_count"), processed, 2),
            "escalation_rate": percent(F.col("escalated_count"), processed, 2),
            "average_retries": mean_of(F.col("total_retries"), processed, 2),
        }
    )


def all_jobs_totals(jobs: DataFrame) -> DataFrame:
    """Totals over jobs. ``sent_rate`` is sent / records, other than a job's success rate."""
    totals = jobs.agg(
        F.count("*").alias("jobs"),
        *[
            F.coalesce(F.sum(name), F.lit(0)).alias(name)
            for name in (
                "total_records", "processed_count", "sent_count", "escalated_count", "failed_count"
            )
        ],
    )
    return totals.withColumn("sent_rate", percent(F.col("sent_count"), F.col("total_records"), 1))


def tone_histogram(audit: DataFrame) -> DataFrame:
    tone = F.coalesce(F.nullif(F.col("tone_used"), F.lit("")), F.lit(fv.TEXT_TONE_UNSPECIFIED))
    return (
        audit.groupBy(tone.alias("tone"))
        .agg(F.count("*").alias("emails"))
        .orderBy(F.col("emails").desc(), "tone")
    )


def audit_counters(view: DataFrame) -> DataFrame:
    status = F.col("send_status")
    return view.agg(
        F.count("*").alias("shown"), counted(status == "sent", "sent"), counted(status == "failed", "failed")
    )


def email_counters(view: DataFrame) -> DataFrame:
    status = F.col("send_status")
    return view.agg(
        F.count("*").alias("shown"),
        counted(status == "sent", "sent"),
        counted(status == "failed", "failed"),
        counted(F.col("escalation_required"), "escalated"),
    )


def failure_counters(queue: DataFrame) -> DataFrame:
    status = F.lower("status")
    return queue.agg(
        F.count("*").alias("total"),
        counted(status == "pending", "pending"),
        counted(status == "resolved", "resolved"),
        counted(status == "permanent_failure", "permanent"),
    )


def job_bars(jobs: DataFrame, newest: int = 15) -> DataFrame:
    """Outcomes of the newest jobs in a view, oldest first."""
    return (
        jobs.orderBy(F.col("id").desc())
        .limit(newest)
        .select(
            F.concat(F.lit("#"), F.col("id").cast("string")).alias("job"),
            "id",
            "sent_count",
            "escalated_count",
            "failed_count",
        )
        .orderBy("id")
    )


def with_progress(jobs: DataFrame) -> DataFrame:
    """Progress, success, live progress and outcome shares of every job."""
    total = F.col("total_records")
    return jobs.withColumns(
        {
            "progress": percent(F.col("processed_count"), total, 1),
            "success": percent(F.col("sent_count"), total, 1),
            "live": live_progress(F.col("processed_count"), total),
            **outcome_shares(
                total, F.col("sent_count"), F.col("escalated_count"), F.col("failed_count")
            ),
        }
    )
