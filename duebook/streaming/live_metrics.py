"""Counts per job while rows still arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from duebook.operators.metrics import job_metrics
from duebook.sources.tables import PartitionedTable


def metrics_table(spark: SparkSession, out: str, outcomes: DataFrame) -> PartitionedTable:
    return PartitionedTable(spark, out, job_metrics(outcomes).schema)


def stream_metrics(outcomes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the table of metrics, one row per job, up to date after every micro-batch.

    Only the jobs that a micro-batch touches are written, each in place of its row before; a batch run again
    writes the same rows.
    """
    table = metrics_table(outcomes.sparkSession, out, outcomes)
    return (
        job_metrics(outcomes)
        .writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: table.replace(batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
