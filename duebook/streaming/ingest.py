"""Continuous ingest of invoice files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from duebook.operators.audit import AUDIT_KEY
from duebook.operators.normalize import normalize_invoices, split_faulty, stage_invoices
from duebook.operators.outcomes import audit_rows, decide_outcomes, email_log_rows, queue_rows
from duebook.sources.invoice_csv import header_schema
from duebook.streaming.batches import batch_folder, write_batch
from duebook.streaming.conflicts import first_of_all


def invoice_stream(spark: SparkSession, folder: str, columns: list[str], files_per_batch: int = 1000) -> DataFrame:
    """New invoice files of a folder, all with the same columns, as text."""
    return (
        spark.readStream.schema(header_schema(columns))
        .option("header", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(folder)
    )


SINKS = ("outcomes", "quarantine", "audit", "queue", "email_log")


def stream_follow_up(
    invoices: DataFrame,
    drafts: DataFrame,
    out: str,
    checkpoint: str,
    as_of: dt.date,
    now: dt.datetime,
    send_results: DataFrame | None = None,
    attempts: DataFrame | None = None,
    date_mode: str = "dayfirst",
) -> StreamingQuery:
    """Decide every arriving invoice and write where it ends up.

    Every invoice is in ``outcomes`` or ``quarantine``; audit rows, queue entries and the e-mail log
    are made from the outcomes as written. Each micro-batch owns one folder per sink and overwrites
    it, so a batch run again after a failure leaves the same rows. Ends when the files present have
    been read.
    """
    moment = F.lit(now.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")

    def settle(batch: DataFrame, batch_id: int) -> None:
        def write(rows: DataFrame, sink: str) -> str:
            folder = batch_folder(f"{out}/{sink}", batch_id)
            rows.write.mode("overwrite").parquet(folder)
            return folder

        good, faulty = split_faulty(normalize_invoices(batch, date_mode))
        decided = decide_outcomes(stage_invoices(good, F.lit(as_of)), drafts, send_results, attempts)
        outcomes = batch.sparkSession.read.schema(decided.schema).parquet(write(decided, "outcomes"))
        write(faulty, "quarantine")
        write(audit_rows(outcomes, moment), "audit")
        write(queue_rows(outcomes, moment), "queue")
        write(email_log_rows(outcomes, moment, ("job_id",)), "email_log")

    return (
        invoices.writeStream.foreachBatch(settle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_sink(spark: SparkSession, out: str, sink: str) -> DataFrame:
    """All rows a stream has written to one of its sinks."""
    if sink not in SINKS:
        raise ValueError(f"no such sink: {sink}")
    return spark.read.parquet(f"{out}/{sink}").drop("batch")


def stream_first_wins(rows: DataFrame, out: str, checkpoint: str, order_by: list[str]) -> StreamingQuery:
    """Append audit rows whose key has not been seen in this or any earlier batch.

    Exact however late a copy arrives: the keys seen are in the state store, so no batch reads what earlier ones
    have written. Keep it in the RocksDB store (``replay_settings``), which need not fit into memory.
    """
    return (
        first_of_all(rows, order_by).writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: write_batch(batch, out, batch_id) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def within_watermark(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """First-wins with bounded state: copies later than ``delay`` after the first come through.

    A key is forgotten once the watermark, ``delay`` behind the latest time seen in earlier batches, has passed the
    first row's time by ``delay``.
    """
    return rows.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(AUDIT_KEY)
