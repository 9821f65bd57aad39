"""Uploads: from files in a folder to jobs in the ledger."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.operators.drafts import template_drafts
from duebook.operators.ledger import created_events, fold_jobs, ingest_decision, status_events
from duebook.operators.normalize import normalize_invoices, stage_invoices
from duebook.plans.followup import Store, run_follow_up
from duebook.session import write_and_read
from duebook.sources.claims import Claims
from duebook.sources.fingerprints import known_fingerprints
from duebook.sources.invoice_csv import read_mixed_csv, with_job_ids

NO_ROWS = "the invoice file has no rows"


def _bad_dates(n) -> F:
    return F.concat(n.cast("string"), F.lit(" invoices have an unreadable due date"))


def ledger(store: Store) -> DataFrame:
    """The jobs with their last status and the counters of their run."""
    metrics = store.metrics.read()
    return fold_jobs(store.job_events.read(), metrics)


def _checked(jobs: DataFrame, invoices: DataFrame, on_bad_date: str) -> DataFrame:
    """``job_id`` and the ``error`` that keeps the job from running; null if none does."""
    counts = invoices.groupBy("job_id").agg(
        F.count("*").alias("_rows"), F.count_if(F.col("due_date").isNull()).alias("_bad")
    )
    error = F.when(F.col("_rows").isNull(), F.lit(NO_ROWS))
    if on_bad_date == "fail":
        error = error.when(F.col("_bad") > 0, _bad_dates(F.col("_bad")))
    return jobs.join(counts, "job_id", "left").select("job_id", error.alias("error"))


def _claimed(decided: DataFrame, claims: Claims, last: int, now: dt.datetime) -> DataFrame:
    """The decisions with ``job_id`` of what this upload may run.

    New contents and those whose job is still on record as open are claimed one by one (the driver holds
    their hashes and numbers, no file). An open job whose claim has run out is ``resumed`` under its number; what
    another upload holds is in progress. A number is claimed like a content, so no two uploads give out the same.
    """
    spark = decided.sparkSession
    open_ = decided.filter("decision = 'new' OR existing_job_id IS NOT NULL AND decision = 'in_progress'")
    rows = open_.select("file_path", "file_hash", "decision", "existing_job_id").orderBy("file_path").collect()
    number, mine, seen = last, [], set()
    for row in rows:
        if row["file_hash"] in seen or not claims.take(row["file_hash"], row["file_path"], now):
            continue
        seen.add(row["file_hash"])
        if row["decision"] == "in_progress":
            mine.append((row["file_path"], "resumed", row["existing_job_id"]))
            continue
        number = claims.next_number(number)
        mine.append((row["file_path"], "new", number))
    taken = spark.createDataFrame(mine, "file_path string, _taken string, job_id long")
    decision = F.when(F.col("_taken").isNotNull(), F.col("_taken")).when(F.col("decision") == "new", F.lit("in_progress"))
    return decided.join(taken, "file_path", "left").withColumn("decision", F.coalesce(decision, F.col("decision"))).drop("_taken")


def _release(new: DataFrame, claims: Claims) -> None:
    for row in new.select("file_hash").collect():
        claims.release(row["file_hash"])


def run_uploads(
    store: Store,
    folder: str,
    as_of: dt.date,
    now: dt.datetime,
    drafts: Callable[[DataFrame], DataFrame] = template_drafts,
    send_results: Callable[[DataFrame], DataFrame] | None = None,
    date_mode: str = "dayfirst",
    on_bad_date: str = "quarantine",
    lease: dt.timedelta = dt.timedelta(hours=6),
) -> DataFrame:
    """Decide on every file of a folder, run the new ones as jobs and record them; returns the decisions.

    Only new and changed files are hashed, and only files that run are parsed. Two uploads at once run each
    content once; a job that is still open after its ``lease``, because its driver died, is resumed under its number.
    A content met before is cached or in progress and not run; so are further copies of a new one. A
    job without rows, or with unreadable dates under ``on_bad_date='fail'``, fails with a message and
    leaves no outcomes; the others run together. ``drafts`` and ``send_results`` are given the staged
    invoices. If the run itself breaks off, its jobs fail with that error and it is raised again.
    """
    spark = store.spark
    moment = F.lit(now.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    claims = Claims(spark, f"{store.root}/claims", lease)
    jobs = fold_jobs(store.job_events.read())
    last = jobs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    prints = known_fingerprints(spark, folder, f"{store.root}/files")
    decided = write_and_read(ingest_decision(prints, jobs, "file_path"), "prints")
    decided = write_and_read(_claimed(decided, claims, last, now), "decisions")
    new = decided.filter("decision IN ('new', 'resumed')")
    if new.isEmpty():
        return decided
    store.job_events.append(created_events(new.filter("decision = 'new'"), moment))
    store.job_events.append(status_events(new, F.lit("running"), F.lit(1), moment))

    paths = [row["file_path"] for row in new.select("file_path").collect()]
    raw = write_and_read(with_job_ids(read_mixed_csv(spark, paths), new), "uploaded")
    normalized = normalize_invoices(raw, date_mode)
    checked = write_and_read(_checked(new.select("job_id"), normalized, on_bad_date), "checked")
    able = checked.filter("error IS NULL").select("job_id")
    raw = raw.join(able, "job_id", "left_semi")
    staged = stage_invoices(normalize_invoices(raw, date_mode).filter("due_date IS NOT NULL"), F.lit(as_of))
    try:
        metrics = run_follow_up(
            store, raw, write_and_read(drafts(staged), "drafts"), as_of, now,
            send_results(staged) if send_results else None, date_mode=date_mode,
        )
        store.metrics.replace(metrics)
    except Exception as broken:
        store.job_events.append(
            status_events(checked, F.lit("failed"), F.lit(2), moment, F.coalesce("error", F.lit(str(broken)[:1000])))
        )
        _release(new, claims)
        raise
    ends = F.when(F.col("error").isNull(), F.lit("completed")).otherwise(F.lit("failed"))
    store.job_events.append(status_events(checked, ends, F.lit(2), moment, F.col("error")))
    _release(new, claims)
    return decided
