"""A follow-up run: raw invoices in, audit, queue, e-mail log and metrics out."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duebook.operators.audit import append_new, key_counts
from duebook.operators.failures import close_entries, closed_keys, upsert_failures
from duebook.operators.metrics import job_metrics
from duebook.operators.normalize import normalize_invoices, split_faulty, split_marked, stage_invoices, with_faults
from duebook.operators.outcomes import (
    OUTCOME_COLUMNS,
    audit_rows,
    decide_outcomes,
    email_log_rows,
    queue_rows,
)
from duebook.operators.validation import KEY
from duebook.schemas import AUDIT, FAILED, JOB_EVENTS, METRICS, STAGE_COLUMNS
from duebook.sources.files import replace_email_log
from duebook.session import write_and_read
from duebook.sources.tables import KeyedTable, PartitionedTable, clear_jobs


@dataclass
class Store:
    """Where the tables of a deployment live."""

    spark: SparkSession
    root: str
    queue_parts: int = 16

    @property
    def audit(self) -> PartitionedTable:
        return PartitionedTable(self.spark, f"{self.root}/audit", AUDIT)

    @property
    def queue(self) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/failed_invoices", FAILED, KEY, self.queue_parts)

    def outcomes(self, schema: T.StructType) -> PartitionedTable:
        return PartitionedTable(self.spark, f"{self.root}/outcomes", schema)

    def quarantine(self, schema: T.StructType) -> PartitionedTable:
        return PartitionedTable(self.spark, f"{self.root}/quarantine", schema)

    @property
    def job_events(self) -> PartitionedTable:
        return PartitionedTable(self.spark, f"{self.root}/job_events", JOB_EVENTS)

    @property
    def metrics(self) -> PartitionedTable:
        return PartitionedTable(self.spark, f"{self.root}/metrics", METRICS)

    @property
    def email_log(self) -> str:
        return f"{self.root}/email_log"


def follow_up(
    raw: DataFrame,
    drafts: DataFrame,
    as_of: dt.date,
    send_results: DataFrame | None = None,
    attempts: DataFrame | None = None,
    date_mode: str = "dayfirst",
    on_bad_date: str = "quarantine",
) -> tuple[DataFrame, DataFrame]:
    """(outcomes, quarantined rows). Crowded invoice numbers are looked for while the plan is made."""
    good, faulty = split_faulty(normalize_invoices(raw, date_mode), on_bad_date)
    staged = stage_invoices(good, F.lit(as_of))
    return decide_outcomes(staged, drafts, send_results, attempts), faulty


def run_follow_up(
    store: Store,
    raw: DataFrame,
    drafts: DataFrame,
    as_of: dt.date,
    now: dt.datetime,
    send_results: DataFrame | None = None,
    attempts: DataFrame | None = None,
    date_mode: str = "dayfirst",
    on_bad_date: str = "quarantine",
) -> DataFrame:
    """Run the jobs in ``raw`` and write all their tables; returns the metrics per job.

    Dates, amounts and stages are read once: the staged rows are written, and all that follows reads those.
    Drafts, results and attempts are cut to the jobs of the run, a filter that reaches their scans.
    Outcomes are written once, one folder per job, and the other tables are made from the folders of
    the jobs in the run, so what earlier jobs left is not read. Running a job again replaces its
    outcomes, quarantine and e-mail log, also where it has no rows any more; audit rows are only
    ever added, the first of a key stays; queue entries of the jobs whose invoice no longer fails, is in
    quarantine now or has gone are resolved. Only the parts of the queue that hold such keys are written.
    """
    marked = stage_invoices(with_faults(normalize_invoices(raw, date_mode)), F.lit(as_of))
    marked = write_and_read(marked, "staged")
    loaded = write_and_read(marked.groupBy("job_id").agg(F.count("*").alias("total_records")), "loaded")
    jobs = [row["job_id"] for row in loaded.select("job_id").collect()]
    good, faulty = split_marked(marked, on_bad_date)

    def of_the_run(rows: DataFrame | None) -> DataFrame | None:
        return None if rows is None else rows.filter(F.col("job_id").isin(*jobs))

    outcomes = decide_outcomes(good, of_the_run(drafts), of_the_run(send_results), of_the_run(attempts))
    faulty = faulty.drop("days_overdue", *STAGE_COLUMNS)
    moment = F.lit(now.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    table = store.outcomes(outcomes.select(*OUTCOME_COLUMNS).schema)
    quarantine = store.quarantine(faulty.schema)
    table.clear(jobs)
    table.replace(outcomes)
    quarantine.clear(jobs)
    quarantine.replace(faulty)
    written = table.read(jobs)

    append_new(store.audit, audit_rows(written, moment), jobs, by_job=True)
    failed = write_and_read(queue_rows(written, moment), "failed")
    one_each = key_counts(failed, key=KEY)["repeated"] == 0
    closed = write_and_read(closed_keys(store.queue.read(), written, jobs), "closed")
    store.queue.rewrite(
        failed.select(*KEY).unionByName(closed),
        lambda rows: close_entries(upsert_failures(rows, failed, one_each=one_each), closed, moment),
    )
    clear_jobs(store.spark, store.email_log, jobs)
    replace_email_log(email_log_rows(written, moment, ("job_id",)), store.email_log, as_read=True)
    return job_metrics(written, loaded)
