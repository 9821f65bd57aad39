"""Audit rows and queue entries whose rules reach over micro-batches, kept by keyed state.

The streams read outcomes and write changes: audit rows whose key was never seen, and every new state of a
queue entry. Neither reads what it has written, so a batch costs what it holds, however long the history.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from duebook.operators.audit import AUDIT_KEY
from duebook.operators.outcomes import WAITING, audit_rows, queue_rows
from duebook.operators.validation import KEY
from duebook.schemas import AUDIT, FAILED
from duebook.streaming.batches import read_batches, write_batch
from duebook.streaming.buckets import BUCKETS, by_key, in_buckets

CHANGES = T.StructType([*FAILED.fields, T.StructField("version", T.LongType())])
ENTRIES = T.StructType([T.StructField("entries", T.ArrayType(CHANGES))])
_OTHERS = [f.name for f in FAILED if f.name not in KEY]


def first_of_all(rows: DataFrame, order_by: list[str | Column], key: list[str] = AUDIT_KEY) -> DataFrame:
    """The first row to arrive for each key; two nulls are one key. Of one micro-batch the least by ``order_by`` counts.

    A streaming aggregate for output mode ``update``. Its state holds a key's row and the times of the first and the
    last micro-batch with that key; a key is new if both are the time of this one, also if the clock was set back.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    order = [*order, F.xxhash64(*rows.columns)]
    place = F.struct(*(c.alias(f"_{k}") for k, c in enumerate(order)))
    marked = rows.select(*key, F.struct(*rows.columns).alias("_row"), place.alias("_place"), F.current_timestamp().alias("_batch"))
    seen = marked.groupBy(*key).agg(
        F.min_by("_row", "_place").alias("_row"), F.min("_batch").alias("_first"), F.max("_batch").alias("_last")
    )
    now = F.current_timestamp()
    return seen.filter((F.col("_first") == now) & (F.col("_last") == now)).select("_row.*")


class QueueKeeper(StatefulProcessor):
    """One queue entry per key: a failure replaces it but for ``created_at``, another outcome resolves it if it waits."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getValueState("entries", ENTRIES)

    def _after(self, rows: list[Row], before: dict | None) -> dict | None:
        """The entry after a micro-batch's rows of its key; none if they change nothing."""
        newest, settled = None, None
        for row in rows:
            if row["failed"]:
                place = (-row["updated_at"].timestamp(), row["_tie"])
                newest = (place, row) if newest is None or place < newest[0] else newest
            else:
                settled = row["updated_at"] if settled is None else max(settled, row["updated_at"])
        version = before["version"] + 1 if before else 0
        if newest is not None:
            after = {c: newest[1][c] for c in FAILED.fieldNames()} | {"version": version}
            return after | {"created_at": before["created_at"]} if before else after
        if before and settled is not None and before["status"] == "pending":
            return before | {"status": "resolved", "updated_at": settled, "version": version}
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored, names = self.entries.get(), CHANGES.fieldNames()
        held = {(entry[0], entry[1]): tuple(entry) for entry in stored[0]} if stored is not None else {}
        changed = False
        for place, arrived in by_key(rows).items():
            before = held.get(place)
            after = self._after(arrived, dict(zip(names, before, strict=True)) if before else None)
            if after:
                changed = True
                held[place] = tuple(after[c] for c in names)
                yield Row(**{c: after[c] for c in names})
        if changed:
            self.entries.update((list(held.values()),))

    def close(self) -> None:
        pass


def queue_changes(outcomes: DataFrame, now: Column, buckets: int = BUCKETS) -> DataFrame:
    """Every change of a queue entry that the outcomes of an invoice bring about, with its ``version``.

    Waiting outcomes change nothing. An invoice number that fails and is sent in one micro-batch has failed.
    """
    failed = queue_rows(outcomes, now)
    failed = failed.select("*", F.lit(True).alias("failed"), F.xxhash64(*failed.columns).alias("_tie"))
    fine = outcomes.filter((F.col("send_status") != "failed") & ~F.col("outcome").isin(*WAITING))
    given = {"job_id": F.col("job_id"), "invoice_no": F.col("invoice_no"), "updated_at": now}
    fine = fine.select(
        *(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FAILED),
        F.lit(False).alias("failed"),
        F.lit(None).cast("long").alias("_tie"),
    )
    return in_buckets(failed.unionByName(fine), buckets).transformWithState(
        statefulProcessor=QueueKeeper(), outputStructType=CHANGES, outputMode="Append", timeMode="None"
    ).select(*CHANGES.fieldNames())


def _to_folder(rows: DataFrame, out: str, checkpoint: str, mode: str) -> StreamingQuery:
    return (
        rows.writeStream.outputMode(mode).foreachBatch(lambda batch, n: write_batch(batch, out, n) and None)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_audit(outcomes: DataFrame, out: str, checkpoint: str, now: Column) -> StreamingQuery:
    """Append the audit rows of arriving outcomes whose key no row before had."""
    return _to_folder(first_of_all(audit_rows(outcomes, now), ["created_at"]), out, checkpoint, "update")


def stream_queue(outcomes: DataFrame, out: str, checkpoint: str, now: Column) -> StreamingQuery:
    """Append the changes of queue entries that arriving outcomes bring about."""
    return _to_folder(queue_changes(outcomes, now), out, checkpoint, "append")


def read_audit(spark: SparkSession, out: str) -> DataFrame:
    return read_batches(spark, out, AUDIT)


def read_queue(spark: SparkSession, out: str) -> DataFrame:
    """The queue as of the last change of each entry."""
    rows = read_batches(spark, out, CHANGES)
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct(*_OTHERS), "version").alias("_last"))
    return last.select(*KEY, "_last.*").select(*FAILED.fieldNames())
