"""A retry cycle: due queue entries are decided again and the queue is rewritten."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook import fixed_values as fv
from duebook.operators.audit import append_new
from duebook.operators.failures import due_failures, split_states
from duebook.operators.outcomes import audit_rows, decide_outcomes
from duebook.operators.retries import apply_results, restored_invoices
from duebook.operators.validation import KEY
from duebook.plans.followup import Store
from duebook.session import write_and_read


def retry_outcomes(
    due: DataFrame,
    drafts: DataFrame,
    send_results: DataFrame | None = None,
    attempts: DataFrame | None = None,
    restage_at: dt.date | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(outcomes of the due entries, entries whose stored state cannot be read)."""
    readable, broken = split_states(due)
    again = restored_invoices(readable, F.lit(restage_at) if restage_at else None)
    outcomes = decide_outcomes(
        again, drafts, send_results, attempts, revisions=fv.MAX_QUEUE_RETRIES
    )
    return outcomes, broken


def run_retry_cycle(
    store: Store,
    drafts: DataFrame,
    now: dt.datetime,
    send_results: DataFrame | None = None,
    attempts: DataFrame | None = None,
    limit: int | None = None,
    restage_at: dt.date | None = None,
    row_per_retry: bool = False,
) -> DataFrame:
    """Run one cycle and write audit and queue; returns the unreadable entries.

    Only the parts of the queue that hold settled entries are written. All due entries are tried; ``limit`` takes only the oldest ones, as a paced worker does.

    ``row_per_retry`` adds the time of the cycle to the audit key, so a second failure with the same retry
    count has a row of its own. Outcomes that still wait for a draft or a result leave their entry untouched. Metrics of the
    first run are not changed by retries.
    """
    moment = F.lit(now.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    queue = store.queue.read()
    due = due_failures(queue, moment, limit)
    outcomes, broken = retry_outcomes(due, drafts, send_results, attempts, restage_at)
    settled = write_and_read(outcomes.filter(F.col("send_status") != "pending"), "retry-outcomes")
    jobs = [row["job_id"] for row in settled.select("job_id").distinct().collect()]
    append_new(store.audit, audit_rows(settled, moment), jobs, "created_at" if row_per_retry else None)
    store.queue.rewrite(settled.select(*KEY), lambda rows: apply_results(rows, settled, moment))
    return broken
