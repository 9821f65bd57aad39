"""The retry queue as streaming state, one entry per (job_id, invoice_no).

An entry's events depend on each other in order, so a key is one task's work; a batch holds few of
them per key. Entries are kept by bucket of their keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from duebook import fixed_values as fv
from duebook.operators.validation import KEY
from duebook.streaming.buckets import BUCKETS, by_key, in_buckets

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# kind is 'failure' (an invoice enters the queue) or 'result' (a retry ended). ``seq`` orders the
# events of one invoice; send_status and error_message belong to the event.
EVENTS = T.StructType(
    [
        T.StructField("job_id", T.LongType()),
        T.StructField("invoice_no", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("send_status", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("retry_count", T.IntegerType()),
        T.StructField("max_retries", T.IntegerType()),
    ]
)
STATE = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("retry_count", T.IntegerType()),
        T.StructField("max_retries", T.IntegerType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("next_retry_ms", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)
# The pending entries of a bucket of keys. ``told`` marks those whose waiting time has been reported, and
# ``timer`` is the earliest time of the others, for which the bucket has its one timer.
ENTRIES = T.StructType(
    [
        T.StructField(
            "entries",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("job_id", T.LongType()),
                        T.StructField("invoice_no", T.StringType()),
                        *STATE.fields,
                        T.StructField("told", T.BooleanType()),
                    ]
                )
            ),
        ),
        T.StructField("timer", T.LongType()),
    ]
)
CHANGES = T.StructType(
    [
        T.StructField("job_id", T.LongType()),
        T.StructField("invoice_no", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("change", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("retry_count", T.IntegerType()),
        T.StructField("max_retries", T.IntegerType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("next_retry_ms", T.LongType()),
    ]
)


def _due(at_ms: int, retry_count: int) -> int:
    return at_ms + 60_000 * min(fv.BACKOFF_CAP_MINUTES, 2 ** min(retry_count, 30))


class RetryMachine(StatefulProcessor):
    """Failures enter as pending with a timer, results settle or reschedule, timers report due.

    The state holds pending entries only: one that is resolved or has failed for good is handed on and
    forgotten, and later results of it change nothing. A changed entry waits anew, and each waiting time is
    reported once. A key's entries share a value and a timer with the others of its bucket.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getValueState("entries", ENTRIES)

    def _held(self) -> tuple[dict, int | None]:
        """The bucket's entries by key, each with whether it has been reported, and the time of its timer."""
        stored = self.entries.get()
        if stored is None:
            return {}, None
        return {(e[0], e[1]): (tuple(e[2:-1]), e[-1]) for e in stored[0]}, stored[1]

    def _keep(self, held: dict, timer: int | None) -> None:
        due = min((entry[4] for entry, told in held.values() if not told), default=None)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        if held:
            self.entries.update(([(*place, *entry, told) for place, (entry, told) in held.items()], due))
        else:
            self.entries.clear()

    def _row(self, key: tuple, change: str, entry: tuple) -> Row:
        status, retry_count, max_retries, error, due, seq = entry
        return Row(
            job_id=key[0], invoice_no=key[1], seq=seq, change=change, status=status,
            retry_count=retry_count, max_retries=max_retries, error_message=error, next_retry_ms=due,
        )

    def _next(self, entry: tuple | None, event) -> tuple | None:
        at = int(event.at.timestamp() * 1000)
        seq = int(event.seq)
        if event.kind == "failure":
            count = int(event.retry_count)
            return ("pending", count, int(event.max_retries), event.error_message, _due(at, count), seq)
        if entry is None:
            return None
        _, count, limit, error, due, _ = entry
        if event.send_status != "failed":
            return ("resolved", count, limit, error, due, seq)
        count += 1
        if count >= limit:
            return ("permanent_failure", count, limit, event.error_message, None, seq)
        return ("pending", count, limit, event.error_message, _due(at, count), seq)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, timer = self._held()
        changed = False
        for place, events in by_key(rows).items():
            before = after = held[place][0] if place in held else None
            for event in sorted(events, key=lambda event: event.seq):
                after = self._next(after, event) or after
            if after == before:
                continue
            changed = True
            if after[0] == "pending":
                held[place] = (after, False)
            else:
                held.pop(place, None)
            yield self._row(place, "state", after)
        if changed:
            self._keep(held, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, timer = self._held()
        now = timerValues.getCurrentProcessingTimeInMs()
        for place, (entry, told) in held.items():
            if not told and entry[4] <= now:
                held[place] = (entry, True)
                yield self._row(place, "due", entry)
        self._keep(held, None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer)

    def close(self) -> None:
        pass


def retry_changes(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """State after each micro-batch, and a ``due`` row when a waiting time ends.

    Needs the RocksDB state store. Timers follow the clock of the cluster, so how many due rows
    appear depends on when the stream runs; the state rows do not.
    """
    return (
        in_buckets(events.select(*EVENTS.fieldNames()), buckets)
        .transformWithState(
            statefulProcessor=RetryMachine(),
            outputStructType=CHANGES,
            outputMode="Update",
            timeMode="ProcessingTime",
        )
    )


def stream_retry_state(
    events: DataFrame, out: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Write every change to ``out``, one folder per micro-batch.

    ``every`` (such as ``1 minute``) keeps the stream running, and batches without events let the
    timers fire. Without it the stream ends when the input present is read; that needs
    ``spark.sql.streaming.noDataMicroBatches.enabled`` off, as timers ask for one more batch each
    time.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id:012d}")

    writer = (
        retry_changes(events)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    if every:
        return writer.trigger(processingTime=every).start()
    return writer.trigger(availableNow=True).start()


@contextmanager
def replay_settings(spark: SparkSession) -> Iterator[None]:
    """Session settings under which a replay of stored events runs and ends."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def current_state(changes: DataFrame) -> DataFrame:
    """The latest state of every entry out of the changes written."""
    fields = [c for c in CHANGES.fieldNames() if c not in {*KEY, "seq", "change"}]
    latest = changes.filter(F.col("change") == "state").groupBy(*KEY).agg(
        F.max_by(F.struct(*fields), "seq").alias("_state")
    )
    return latest.select(*KEY, "_state.*")


def stored_entries(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The entries in the state store of a stream that isn't running: those that are pending."""
    rows = spark.read.format("statestore").option("stateVarName", "entries").load(checkpoint)
    return rows.select(F.inline("value.entries")).drop("told")
