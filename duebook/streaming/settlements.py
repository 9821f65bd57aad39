"""Invoices that wait in streaming state until their drafts and results have arrived.

Three streams meet on (job_id, invoice_no): invoices in an e-mail stage, drafts, send results. Invoices
that need no e-mail and faulty ones pass by the state. The state of a bucket of keys is a list of the invoices that
wait and, beside it, the facts about them: one draft per revision and one send result of each key. An invoice
leaves the state, with its facts, once they settle it; what becomes of it is then worked out by the same
expressions as in a batch run. While no invoice of a key waits, its facts are only kept for a time
(``keep_facts``), so that a draft may be ahead of its invoice and a repeated invoice meets them too.

Of drafts for one revision, and of send results, the first to arrive counts, in one micro-batch the
least. The state asks of an invoice only whether it still waits; the texts it compares are prepared by
column expressions.

To and from the state machine, and in the state, an invoice, a draft and a send result are one JSON text each, made
and read by column expressions: a struct costs Python about a microsecond a field each time it is handed over. The machine
reads of them what it compares, and examines a draft once for an invoice that waits. In the state they are compressed blobs.
"""

from __future__ import annotations

import datetime as dt
import json
import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from duebook.functions.text import words_only
from duebook.operators.drafts import with_subject
from duebook.operators.normalize import normalize_invoices, stage_invoices, with_faults
from duebook.operators.outcomes import WAITING, decide_outcomes, email_log_rows, initial_route
from duebook.operators.validation import KEY, draft_marks, draft_text, invoice_marks
from duebook.schemas import DRAFT_FIELDS
from duebook.streaming.batches import read_batches, write_batch
from duebook.streaming.buckets import BUCKETS, by_key, in_buckets

DRAFT = T.StructType([T.StructField("revision", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in DRAFT_FIELDS]])
SEND = T.StructType(
    [T.StructField("success", T.BooleanType()), T.StructField("provider", T.StringType()), T.StructField("message", T.StringType())]
)
DRAFTS = T.ArrayType(DRAFT)
ASKED = T.StructType(
    [
        T.StructField("revisions", T.IntegerType()),
        T.StructField("recipient", T.StringType()),
        T.StructField("tone", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("values", T.ArrayType(T.StringType())),
    ]
)
MARKS = ("kind", "recipient", "tone", "subject", "text")
# The parts of a draft's text.
TEXT = ("greeting", "body", "closing")
SENDING = -1
# What the state machine is given, all texts, and what it hands on.
EVENT = [*KEY, "invoice", "asked", "draft", "marks", "send"]
HANDED = T.StructType([T.StructField(name, T.StringType()) for name in ("invoice", "drafts", "send")])
BLOB = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("blob", T.BinaryType())])
# Nulls are written out, so that a struct's values stand in their order; times keep their microseconds.
_WRITE = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_READ = {"mode": "FAILFAST", "maxStringLen": str(2**31 - 1), "timestampFormat": _WRITE["timestampFormat"]}


_decode = json.JSONDecoder().raw_decode


def parsed(text: str) -> dict:
    """The struct of a text of ``as_json``, which holds nothing around it; ``json.loads`` looks for that at each call."""
    return _decode(text)[0]


def as_json(value: Column) -> Column:
    """A struct as JSON."""
    return F.to_json(value, _WRITE)


def out_of_json(text: Column, kind: T.DataType) -> Column:
    """What ``as_json`` was given; a text that can't be read fails the job."""
    return F.from_json(text, kind, _READ)


def passes(asked: dict, marks: dict) -> bool:
    """Whether a whole draft is approved, told from the prepared texts of both sides."""
    return (
        marks["recipient"] == asked["recipient"]
        and all(asked[c] is None or marks[c] == asked[c] for c in ("tone", "subject"))
        and all(value is None or value in marks["text"] for value in asked["values"])
    )


def marks_of(known: tuple) -> dict:
    """The marks of a whole draft, with its text if they don't hold it."""
    marks = dict(zip(MARKS, known[2], strict=True))
    if marks["text"] is None:
        parts = parsed(known[1])
        marks["text"] = " ".join(parts[c] for c in TEXT if parts[c] is not None)
    return marks


def examine(asked: str, drafts: dict[int | None, tuple], send: str | tuple | None, at: int = 0) -> int | None:
    """Where an invoice waits: at the revision that isn't there yet or, once one is approved, ``SENDING``.

    None if these facts settle it. ``at`` is where it waited before, as revisions examined once stay as they were.
    """
    if at != SENDING:
        if at not in drafts:
            return at
        asks = parsed(asked)
        for revision in range(at, asks["revisions"]):
            known = drafts.get(revision)
            if known is None:
                return revision
            kind = known[2][0]
            if kind == "invalid":
                return None
            if kind == "whole" and passes(asks, marks_of(known)):
                break
        else:
            return None
    return SENDING if send is None else None


def _order(text: str) -> tuple:
    """Nulls first, then by value, field by field."""
    return tuple((x is not None, x if x is not None else 0) for x in parsed(text).values())


def packed(value) -> tuple[int, bytes]:
    """A value as one compressed blob behind its size: a state of texts costs memory and calls by its bytes."""
    whole = pickle.dumps(value, 5)
    return len(whole), pa.compress(whole, codec="zstd", asbytes=True)


def unpacked(size: int, blob: bytes):
    return pickle.loads(pa.decompress(blob, size, codec="zstd", asbytes=True))


class Packed:
    """A value of the state as one blob, which costs the same few calls however much is in it."""

    def __init__(self, state):
        self.state = state

    def get(self):
        stored = self.state.get()
        return unpacked(*stored) if stored else None

    def update(self, value) -> None:
        self.state.update(packed(value))

    def clear(self) -> None:
        self.state.clear()


class Settlements(StatefulProcessor):
    """Keeps invoices until their facts settle them, and hands both on together.

    State is kept by bucket of keys: the list of its waiting invoices, the facts of their keys, and the facts of
    other keys, each with the time it counts until. The latter are dropped when the bucket is next written, and all
    of them once nothing has come to the bucket for so long.

    A key's facts are (job_id, invoice_no, drafts, send, until), a draft is (revision, draft, marks). An invoice that waits
    is (asked, where it waits, invoice); an element of the list holds those that one micro-batch has added or left.
    """

    def __init__(self, waiting: T.StructType, keep_ms: int):
        self.waiting, self.keep_ms = waiting, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.invoices = handle.getListState("invoices", self.waiting)
        self.facts = Packed(handle.getValueState("facts", BLOB))
        self.kept = Packed(handle.getValueState("kept", BLOB, self.keep_ms))

    @staticmethod
    def _read(state) -> dict:
        """The facts of each key in one of the two values."""
        stored = state.get()
        return {known[:2]: known for known in stored[0]} if stored else {}

    @staticmethod
    def _write(state, known: dict) -> None:
        if known:
            state.update((list(known.values()),))
        else:
            state.clear()

    def _waiting(self) -> dict[tuple, list]:
        """The invoices that wait, by key."""
        found: dict[tuple, list] = {}
        for size, blob, _ in self.invoices.get():
            for place, *one in unpacked(size, blob):
                found.setdefault(place, []).append(tuple(one))
        return found

    @staticmethod
    def _element(ones: list[tuple]) -> tuple:
        """Invoices that wait, each behind its key, as an element of the list."""
        return *packed(ones), None

    @staticmethod
    def _arrivals(rows: list[tuple]) -> tuple[list, dict, str | tuple | None]:
        invoices, drafts, send = [], {}, None
        for row in rows:
            _, _, invoice, asked, draft, marks, sent = row
            if invoice is not None:
                invoices.append((asked, 0, invoice))
            elif draft is not None:
                read = parsed(marks)
                revision = read["revision"]
                least = drafts.get(revision)
                if least is None or _order(draft) < _order(least[1]):
                    drafts[revision] = (revision, draft, tuple(map(read.get, MARKS)))
            elif sent is not None:
                send = sent if send is None else min(send, sent, key=_order)
        return invoices, drafts, send

    def handleInputRows(self, key, rows, timerValues) -> Iterator[tuple]:
        now = timerValues.getCurrentProcessingTimeInMs()
        facts, kept = self._read(self.facts), self._read(self.kept)
        kept = {place: known for place, known in kept.items() if known[4] > now}
        waiting, added = None, []
        changed, news_of_waiting, news_of_kept = False, False, False
        for place, arrivals in by_key(rows).items():
            arrived, drafts, send = self._arrivals(arrivals)
            waits = place in facts
            stored = facts[place] if waits else kept.get(place)
            before = {known[0]: known for known in stored[2]} if stored else {}
            known = drafts | before
            if stored and stored[3]:
                send = stored[3]
            news = len(known) > len(before) or (send is not None and not (stored and stored[3]))

            if waits and news and waiting is None:
                waiting = self._waiting()
            earlier = waiting.get(place, []) if waits and news else []
            remaining, new = [], []
            for ones, left in ((earlier, remaining), (arrived, new)):
                for asked, before_at, invoice in ones:
                    at = examine(asked, known, send, before_at)
                    if at is None:
                        yield invoice, f"[{','.join(draft for _, draft, _ in known.values())}]", send
                    else:
                        left.append((asked, at, invoice))

            if remaining != earlier:
                changed = True
                waiting[place] = remaining
            added += [(place, *one) for one in new]
            still = bool(remaining or new) or (waits and not earlier)
            found = (*place, list(known.values()), send)
            if still and (news or not waits):
                facts[place] = (*found, None)
                news_of_waiting = True
                news_of_kept = kept.pop(place, None) is not None or news_of_kept
            elif not still:
                news_of_waiting = facts.pop(place, None) is not None or news_of_waiting
                if known or send is not None:
                    kept[place] = (*found, now + self.keep_ms)
                    news_of_kept = True

        if changed:
            left = [(place, *one) for place, ones in waiting.items() for one in ones] + added
            if left:
                self.invoices.put([self._element(left)])
            else:
                self.invoices.clear()
        elif added:
            self.invoices.appendList([self._element(added)])
        if news_of_waiting:
            self._write(self.facts, facts)
        if news_of_kept:
            self._write(self.kept, kept)

    def close(self) -> None:
        pass


class FramedSettlements(Settlements):
    """The same for rows that come and go as data frames, whose columns are handed over whole."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = (event for frame in rows for event in frame.iloc[:, : len(EVENT)].itertuples(index=False, name=None))
        found = list(super().handleInputRows(key, events, timerValues))
        if found:
            yield pd.DataFrame(found, columns=HANDED.fieldNames())


def _events(staged: DataFrame, drafts: DataFrame, sends: DataFrame, strict: bool) -> DataFrame:
    """The three streams as one, each row with one of ``invoice``, ``draft`` and ``send`` as JSON.

    What the rules read of a draft is in ``marks``, what they ask of an invoice in ``asked``. Only the text of
    whole words is put into the marks, as the plain one is a draft's parts.
    """
    asked = with_subject(staged.withColumn("invoice", F.struct(*staged.columns)))

    def event(rows: DataFrame, **given: Column) -> DataFrame:
        key = [F.col(name).cast("string") for name in KEY]
        return rows.select(*key, *((as_json(given[n]) if n in given else F.lit(None).cast("string")).alias(n) for n in EVENT[2:]))

    draft = F.struct(*DRAFT_FIELDS)
    read = draft_marks(draft)
    text = [words_only(draft_text(draft)).alias("text")] if strict else []
    marks = F.struct("revision", *(read[c].alias(c) for c in MARKS[:-1]), *text)
    return (
        event(asked, invoice=F.col("invoice"), asked=invoice_marks(strict).cast(ASKED))
        .union(event(drafts, draft=F.struct("revision", *DRAFT_FIELDS).cast(DRAFT), marks=marks))
        .union(event(sends, send=F.struct("success", "provider", "message").cast(SEND)))
    )


SINKS = ("settled", "outcomes", "quarantine", "email_log")


def stream_settlements(
    invoices: DataFrame,
    drafts: DataFrame,
    send_results: DataFrame,
    out: str,
    checkpoint: str,
    as_of: dt.date,
    now: dt.datetime,
    date_mode: str = "dayfirst",
    strict: bool = False,
    keep_facts: dt.timedelta = dt.timedelta(days=7),
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Settle invoices as their drafts and send results arrive, in any order; all three are streams.

    Every invoice is written once, to ``outcomes`` or ``quarantine``, in the micro-batch that settles it; those
    that still wait are in the state alone. Each micro-batch owns one folder per sink and overwrites it. Needs
    the RocksDB state store (``replay_settings``). Ends when the files present have been read.
    """
    moment = F.lit(now.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    marked = stage_invoices(with_faults(normalize_invoices(invoices, date_mode)), F.lit(as_of))
    good = F.size("faults") == 0
    staged = marked.filter(good).drop("faults")
    mailed = F.coalesce(initial_route() == "draft", F.lit(False))
    invoice = F.struct(*staged.columns).alias("invoice")
    shape = staged.select(invoice).schema["invoice"].dataType
    waiting = T.StructType([*BLOB.fields, T.StructField("invoice", shape)])
    keep_ms = int(keep_facts.total_seconds() * 1000)
    settled = in_buckets(_events(staged.filter(mailed), drafts, send_results, strict), buckets).transformWithStateInPandas(
        statefulProcessor=FramedSettlements(waiting, keep_ms), outputStructType=HANDED, outputMode="Append", timeMode="ProcessingTime"
    )
    kinds = {"invoice": shape, "drafts": DRAFTS, "send": SEND}
    quiet = marked.filter(~good | ~mailed)
    faults = F.when(F.size("faults") > 0, F.col("faults"))
    rows = settled.select(
        *(out_of_json(F.col(name), kind).alias(name) for name, kind in kinds.items()), F.lit(None).cast("array<string>").alias("faults")
    ).unionByName(
        quiet.select(invoice, F.lit(None).cast(DRAFTS).alias("drafts"), F.lit(None).cast(SEND).alias("send"), faults.alias("faults"))
    )

    def settle(batch: DataFrame, batch_id: int) -> None:
        kept = write_batch(batch, f"{out}/settled", batch_id)
        faulty = kept.filter("faults IS NOT NULL").select("invoice.*", "faults").drop(*_STAGE_ONLY)
        write_batch(faulty, f"{out}/quarantine", batch_id)
        good_rows = kept.filter("faults IS NULL")
        found = good_rows.select("invoice.job_id", "invoice.invoice_no", F.explode("drafts").alias("d")).select(*KEY, "d.*")
        sent = good_rows.filter("send IS NOT NULL").select("invoice.job_id", "invoice.invoice_no", "send.*")
        decided = decide_outcomes(good_rows.select("invoice.*"), found, sent, strict=strict)
        outcomes = write_batch(decided, f"{out}/outcomes", batch_id)
        if not outcomes.filter(F.col("outcome").isin(*WAITING)).isEmpty():
            raise RuntimeError(f"batch {batch_id} holds invoices that were handed on as settled but still wait")
        write_batch(email_log_rows(outcomes, moment, ("job_id",)), f"{out}/email_log", batch_id)

    return (
        rows.writeStream.outputMode("append").foreachBatch(settle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


_STAGE_ONLY = ("days_overdue", "stage_key", "followup_number", "tone", "key_message", "cta", "escalation_required", "subject_template")


def read_settled(spark: SparkSession, out: str, sink: str) -> DataFrame:
    """All rows written to one of the sinks."""
    if sink not in SINKS:
        raise ValueError(f"no such sink: {sink}")
    return read_batches(spark, f"{out}/{sink}")


def _texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The texts of the invoices in elements of the list."""
    for frame in frames:
        for size, blob in frame.itertuples(index=False, name=None):
            yield pd.DataFrame({"text": [one[3] for one in unpacked(size, blob)]})


def waiting_invoices(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The invoices that the state still holds, read from the store of a stream that isn't running.

    The store's own column ``invoice`` is always null; its type tells how to read the texts.
    """
    rows = spark.read.format("statestore").option("stateVarName", "invoices").load(checkpoint).select("list_element.*")
    texts = rows.select(*BLOB.fieldNames()).mapInPandas(_texts, "text string")
    return texts.select(out_of_json(F.col("text"), rows.schema["invoice"].dataType).alias("invoice")).select("invoice.*")
