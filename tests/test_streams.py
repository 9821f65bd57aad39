"""Streams whose rules reach over micro-batches: what the state holds, hands on and forgets."""

import datetime as dt
import json
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duebook.functions.text import words_only
from duebook.operators.drafts import template_drafts, with_subject
from duebook.operators.normalize import normalize_invoices, stage_invoices
from duebook.operators.outcomes import WAITING, decide_outcomes
from duebook.operators.validation import draft_marks, draft_text, invoice_marks, judge
from duebook.schemas import AUDIT, DRAFT_FIELDS, DRAFTS, SEND_RESULTS
from duebook.session import fresh_dir
from duebook.streaming import conflicts, ingest, live_metrics, retry_state, settlements
from duebook.streaming.batches import read_batches

TODAY, NOW = dt.date(2026, 5, 14), dt.datetime(2026, 5, 14, 13, 0)
COLUMNS = ["job_id", "invoice_number", "client_name", "recipient_email", "amount", "due_date"]


def invoice(number, days, client="Client"):
    due = (TODAY - dt.timedelta(days=days)).isoformat()
    return ("1", number, client, f"{number}@example.com".lower(), "10.00", due)


class Settling:
    def __init__(self, spark, keep_facts=dt.timedelta(days=7)):
        self.spark, self.keep_facts = spark, keep_facts
        self.arrivals, self.drafts, self.results, self.out, self.state = (fresh_dir(spark, "s") for _ in range(5))
        spark.createDataFrame([], ", ".join(f"{c} string" for c in COLUMNS)).write.option("header", True).csv(self.arrivals)
        spark.createDataFrame([], DRAFTS).write.parquet(self.drafts)
        spark.createDataFrame([], SEND_RESULTS).write.parquet(self.results)

    def run(self, invoices=(), drafts=None, results=()):
        if invoices:
            self.spark.createDataFrame(invoices, COLUMNS).write.mode("append").option("header", True).csv(self.arrivals)
        if drafts is not None:
            drafts.select(*(F.col(f.name).cast(f.dataType) for f in DRAFTS)).write.mode("append").parquet(self.drafts)
        if results:
            self.spark.createDataFrame(results, SEND_RESULTS).write.mode("append").parquet(self.results)
        with retry_state.replay_settings(self.spark):
            settlements.stream_settlements(
                ingest.invoice_stream(self.spark, self.arrivals, COLUMNS),
                self.spark.readStream.schema(DRAFTS).parquet(self.drafts),
                self.spark.readStream.schema(SEND_RESULTS).parquet(self.results),
                self.out, self.state, TODAY, NOW, "iso", keep_facts=self.keep_facts,
            ).awaitTermination()
            waiting = settlements.waiting_invoices(self.spark, self.state)
            waits = sorted(r.invoice_no for r in waiting.collect())
        settled = settlements.read_settled(self.spark, self.out, "outcomes")
        return sorted((r.invoice_no, r.outcome) for r in settled.collect()), waits


def good_drafts(spark, rows):
    staged = stage_invoices(normalize_invoices(spark.createDataFrame(rows, COLUMNS), "iso"), F.lit(TODAY))
    return template_drafts(staged)


def test_facts_may_come_before_and_after_their_invoice(spark):
    stream = Settling(spark)
    rows = [invoice("A", 5), invoice("B", 5), invoice("C", 0), invoice("D", 90), invoice("E", 12)]
    ready = good_drafts(spark, rows)
    assert stream.run(results=[(1, "A", True, "p", "")], drafts=ready.filter("invoice_no = 'A'")) == ([], [])
    done, waits = stream.run(invoices=rows)
    assert done == [("A", "sent"), ("C", "not_overdue"), ("D", "escalated_stage")] and waits == ["B", "E"]
    bad = ready.filter("invoice_no = 'B'").withColumn("subject", F.lit("other"))
    done, waits = stream.run(drafts=bad.union(ready.filter("invoice_no = 'E'").withColumn("recipient", F.lit("nobody"))))
    assert ("E", "attempt_failed") in done and waits == ["B"]
    more = [bad.withColumn("revision", F.lit(k)) for k in (1, 2)]
    done, waits = stream.run(drafts=more[0].union(more[1]))
    assert ("B", "escalated_draft") in done and waits == [] and len(done) == 5
    done, waits = stream.run(invoices=[invoice("A", 5)])  # a repeated invoice meets the facts kept of the first
    assert done.count(("A", "sent")) == 2 and waits == []


def test_the_least_of_copies_counts_as_in_a_batch(spark):
    stream = Settling(spark)
    rows = [invoice("A", 5), invoice("A", 5, "Twin"), invoice("B", 5)]
    ready = good_drafts(spark, rows[:1] + rows[2:])
    copies = ready.union(ready.withColumn("greeting", F.lit("Aa "))).union(ready.filter("invoice_no = 'B'"))
    results = [(1, "B", True, "p", ""), (1, "B", False, "p", "no"), (1, "A", True, "p", "")]
    stream.run(invoices=rows)
    done, waits = stream.run(drafts=copies, results=results)
    raw = spark.createDataFrame(rows, COLUMNS)
    staged = stage_invoices(normalize_invoices(raw, "iso"), F.lit(TODAY))
    batch = decide_outcomes(staged, copies, spark.createDataFrame(results, SEND_RESULTS))
    want = sorted((r.invoice_no, r.outcome) for r in batch.filter(~F.col("outcome").isin(*WAITING)).collect())
    assert done == want and waits == sorted(r.invoice_no for r in batch.filter(F.col("outcome").isin(*WAITING)).collect())


@pytest.mark.parametrize("strict", [False, True])
def test_marks_tell_what_the_rules_tell(spark, strict):
    rows = [invoice("A1", 5), invoice("A2", 20, "Two Words")]
    staged = with_subject(stage_invoices(normalize_invoices(spark.createDataFrame(rows, COLUMNS), "iso"), F.lit(TODAY)))
    ready = good_drafts(spark, rows)
    faults = {
        "none": {}, "recipient": {"recipient": F.lit("x@example.com")}, "case": {"recipient": F.concat(F.lit(" "), F.upper("recipient"))},
        "tone": {"tone": F.lit("Formal & Serious")}, "no tone": {"tone": F.lit("?")}, "subject": {"subject": F.lit("s")},
        "body": {"body": F.lit("b")}, "null": {"body": F.lit(None).cast("string")},
        "empty": {c: F.lit(None).cast("string") for c in DRAFT_FIELDS},
    }
    for columns in faults.values():
        changed = ready.withColumns(columns) if columns else ready
        both = staged.join(changed.select("invoice_no", F.struct(*DRAFT_FIELDS).alias("d")), "invoice_no")
        found = both.select(
            judge(F.col("d"), strict)["status"].alias("status"), invoice_marks(strict).alias("asked"),
            draft_marks(F.col("d")).alias("marks"),
            (words_only(draft_text(F.col("d"))) if strict else draft_text(F.col("d"))).alias("text"),
        )
        for row in found.collect():
            asked, marks = row.asked.asDict(), row.marks.asDict() | {"text": row.text}
            told = {"invalid": "invalid", "empty": "rejected"}.get(marks["kind"]) or ("approved" if settlements.passes(asked, marks) else "rejected")
            assert told == row.status


def audit_row(number, status, count, error, at=NOW):
    values = dict.fromkeys(AUDIT.fieldNames()) | {"job_id": 1, "invoice_no": number, "send_status": status, "retry_count": count, "error_message": error, "created_at": at}
    return tuple(values[c] for c in AUDIT.fieldNames())


def test_first_wins_reads_nothing_back(spark):
    source, out, state = (fresh_dir(spark, n) for n in ("in", "out", "state"))
    progress = []
    for k in range(4):
        rows = [audit_row(f"N{n}", "sent", 0, f"wave {k}") for n in range(k, k + 5)] * 2 + [audit_row(None, None, None, f"wave {k}")]
        spark.createDataFrame(rows, AUDIT).write.mode("append").parquet(source)
        with retry_state.replay_settings(spark):
            run = ingest.stream_first_wins(spark.readStream.schema(AUDIT).parquet(source), out, state, ["error_message"])
            run.awaitTermination()
            progress.append((run.lastProgress.numInputRows, run.lastProgress.stateOperators[0].numRowsTotal))
    kept = sorted((r.invoice_no or "", r.error_message) for r in read_batches(spark, out, AUDIT).collect())
    assert kept == sorted([("", "wave 0"), *[(f"N{n}", f"wave {max(0, n - 4)}") for n in range(8)]])
    assert [n for n, _ in progress] == [11] * 4 and progress[-1][1] == 9


EVENT = "job_id long, invoice_no string, seq long, kind string, at timestamp, send_status string, error_message string, retry_count int, max_retries int"


def test_settled_entries_leave_the_state(spark):
    source, out, state = (fresh_dir(spark, n) for n in ("in", "out", "state"))
    entered = [(1, n, 0, "failure", NOW, None, "e", 0, 2) for n in "abcd"]
    ended = [
        (1, "a", 1, "result", NOW, "sent", None, None, None),
        *[(1, "b", s, "result", NOW, "failed", "again", None, None) for s in (1, 2)],
        (1, "c", 1, "result", NOW, "failed", "again", None, None),
    ]
    late = [(1, "a", 5, "result", NOW, "failed", "late", None, None), (1, "b", 6, "failure", NOW, None, "new", 0, 2)]
    want = [{"a", "b", "c", "d"}, {"c", "d"}, {"b", "c", "d"}]
    for rows, held in zip((entered, ended, late), want, strict=True):
        spark.createDataFrame(rows, EVENT).write.mode("append").parquet(source)
        with retry_state.replay_settings(spark):
            retry_state.stream_retry_state(spark.readStream.schema(retry_state.EVENTS).parquet(source), out, state).awaitTermination()
            assert {r.invoice_no for r in retry_state.stored_entries(spark, state).collect()} == held
    now = {r.invoice_no: (r.status, r.retry_count) for r in retry_state.current_state(spark.read.schema(retry_state.CHANGES).parquet(out)).collect()}
    assert now == {"a": ("resolved", 0), "b": ("pending", 0), "c": ("pending", 1), "d": ("pending", 0)}


def test_only_touched_jobs_are_written(spark):
    source, out, state = (fresh_dir(spark, n) for n in ("in", "out", "state"))
    kind = "job_id long, invoice_no string, send_status string, escalation_required boolean, retry_count int"

    def files():
        return {(r.job_id, r.name) for r in spark.read.parquet(out).select("job_id", F.col("_metadata.file_name").alias("name")).collect()}

    seen = []
    for rows in ([(1, "a", "sent", False, 0), (2, "b", "failed", False, 0)], [(2, "c", "sent", False, 1)]):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(kind).parquet(source)
        live_metrics.stream_metrics(arriving, out, state).awaitTermination()
        seen.append(files())
    assert {j for j, _ in seen[0] & seen[1]} == {1} and {j for j, _ in seen[1]} == {1, 2}
    table = live_metrics.metrics_table(spark, out, spark.createDataFrame([], kind)).read()
    assert {(r.job_id, r.total_records, r.sent_count, r.failed_count) for r in table.collect()} == {(1, 1, 1, 0), (2, 2, 1, 1)}


def test_keys_of_one_bucket_keep_their_own_entries(spark):
    source, out, state = (fresh_dir(spark, n) for n in ("in", "out", "state"))
    waves = (
        [(1, n, 0, "failure", NOW, None, "e", 0, 2) for n in "abc"] + [(None, None, 0, "failure", NOW, None, "e", 1, 2)],
        [(1, "a", 1, "result", NOW, "sent", None, None, None), (1, "b", 1, "result", NOW, "failed", "again", None, None)],
        [(9, "z", 0, "result", NOW, "sent", None, None, None)],
    )
    with retry_state.replay_settings(spark):
        for rows in waves:
            spark.createDataFrame(rows, EVENT).write.mode("append").parquet(source)
            changes = retry_state.retry_changes(spark.readStream.schema(retry_state.EVENTS).parquet(source), buckets=1)
            run = changes.writeStream.outputMode("update").option("checkpointLocation", state)
            run.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).trigger(availableNow=True).start().awaitTermination()
        held = {(r.invoice_no, r.retry_count) for r in retry_state.stored_entries(spark, state).collect()}
    told = [(r.invoice_no, r.retry_count) for r in spark.read.schema(retry_state.CHANGES).parquet(out).filter("change = 'due'").collect()]
    assert held == {("b", 1), ("c", 0), (None, 1)}
    assert len(told) == len(set(told)) and {("b", 1), ("c", 0), (None, 1)} <= set(told)
    assert run_rows(spark, state) == 1


def run_rows(spark, state):
    """How many values the state of a retry stream holds."""
    with retry_state.replay_settings(spark):
        return spark.read.format("statestore").option("stateVarName", "entries").load(state).count()


def test_facts_kept_for_a_key_lapse_though_its_bucket_lives():
    held = {}

    class Value:
        def __init__(self, name):
            self.name = name

        def get(self):
            return held.get(self.name)

        def update(self, value):
            held[self.name] = value

        def clear(self):
            held.pop(self.name, None)

    machine = settlements.Settlements(None, 1000)
    machine.invoices, machine.facts, machine.kept = Value("invoices"), Value("facts"), Value("kept")

    class At:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentProcessingTimeInMs(self):
            return self.ms

    from pyspark.sql import Row

    def result(number):
        kind = Row("job_id", "invoice_no", "invoice", "asked", "draft", "marks", "send")
        return kind(1, number, None, None, None, None, (True, "p", ""))

    for number, at in (("A", 0), ("B", 900), ("C", 1500)):
        assert list(machine.handleInputRows((0,), iter([result(number)]), At(at))) == []
    assert [known[1] for known in held["kept"][0]] == ["B", "C"]


def test_rows_of_later_batches_are_not_new(spark):
    source, out, state = (fresh_dir(spark, n) for n in ("in", "out", "state"))
    for wave in (["b", "a"], ["0"]):
        rows = [audit_row(number, "sent", 0, error) for error in wave for number in ("N", None)]
        spark.createDataFrame(rows, AUDIT).coalesce(1).write.mode("append").parquet(source)
        with retry_state.replay_settings(spark):
            run = ingest.stream_first_wins(spark.readStream.schema(AUDIT).parquet(source), out, state, ["error_message"])
            run.awaitTermination()
    found = read_batches(spark, out, AUDIT).collect()
    assert sorted((r.invoice_no or "", r.error_message) for r in found) == [("", "a"), ("N", "a")]


class Stored:
    """A value or a list of the state, which counts what is asked of it."""

    def __init__(self):
        self.held, self.calls = None, 0

    def get(self):
        self.calls += 1
        return iter(self.held or []) if isinstance(self.held, list) else self.held

    def update(self, value):
        self.calls, self.held = self.calls + 1, value

    put = update

    def appendList(self, value):
        self.update([*(self.held or []), *value])

    def clear(self):
        self.update(None)


class At:
    def getCurrentProcessingTimeInMs(self):
        return 0


def test_a_draft_is_examined_once_for_an_invoice_that_waits(monkeypatch):
    seen = []
    monkeypatch.setattr(settlements, "passes", lambda asked, marks, f=settlements.passes: seen.append(marks["text"]) or f(asked, marks))
    machine = settlements.FramedSettlements(None, 1000)
    machine.invoices = Stored()
    machine.facts, machine.kept = settlements.Packed(Stored()), settlements.Packed(Stored())

    def text(**values):
        return json.dumps(values)

    def arrive(*rows):
        frame = pd.DataFrame(rows, columns=["job_id", "invoice_no", "invoice", "asked", "draft", "marks", "send", "_bucket"])
        return [tuple(r) for f in machine.handleInputRows((0,), iter([frame]), At()) for r in f.itertuples(index=False)]

    def draft(number, revision, body):
        given = dict(revision=revision, recipient="r", subject="s", greeting="Dear", body=body, closing=None, tone="t")
        return ("1", number, None, None, text(**given), text(revision=revision, kind="whole", recipient="r", tone="t", subject="s"), None, 0)

    def sent(number, provider):
        return ("1", number, None, None, None, None, text(success=True, provider=provider, message=None), 0)

    asked = text(revisions=3, recipient="r", tone="t", subject="s", values=["good"])
    numbers = [f"N{n}" for n in range(50)]
    assert arrive(*[("1", n, text(invoice=n), asked, None, None, None, 0) for n in numbers]) == []
    assert arrive(*[draft(n, 0, "bad") for n in numbers]) == [] and seen == ["Dear bad"] * 50
    assert arrive(*[draft(n, 1, "good") for n in numbers]) == [] and seen[50:] == ["Dear good"] * 50
    assert arrive(*[draft(n, 0, "good") for n in numbers]) == []  # the first to arrive counts
    done = arrive(*[sent(n, p) for n in numbers for p in "qp"])
    assert len(seen) == 100 and machine.invoices.held is None
    assert [(json.loads(i)["invoice"], sorted(d["body"] for d in json.loads(f)), json.loads(s)["provider"]) for i, f, s in done] == [
        (n, ["bad", "good"], "p") for n in numbers
    ]
    # Five micro-batches over 50 keys of one bucket: one call for each value read or written, whatever the keys.
    assert machine.facts.state.calls + machine.kept.state.calls + machine.invoices.calls <= 25
    assert [type(value) for value in machine.kept.state.held] == [int, bytes]


ODD = ["a\nb", 'quo"te\\ \\n', "tab\there\r", " é\U0001f600\u0000\u001f", "", " ", "null", "[{}]"]


@pytest.mark.parametrize("strict", [False, True])
def test_odd_texts_settle_as_in_a_batch(spark, strict):
    rows = [(1, f"A{k}", f"Client {text}", f"a{k}@example.com", "10.10", "2026-05-09") for k, text in enumerate(ODD)]
    raw = spark.createDataFrame([(*r, *rest) for r, rest in zip(rows, [(None, None)] * 4 + [(NOW.replace(microsecond=7), 0.1)] * 4, strict=True)], "job_id long, invoice_number string, client_name string, recipient_email string, amount string, due_date string, seen timestamp, share double")
    staged = stage_invoices(normalize_invoices(raw, "iso"), F.lit(TODAY))
    ready = template_drafts(staged).select(*(F.col(f.name).cast(f.dataType) for f in DRAFTS))
    wrong = ready.withColumn("closing", F.lit(None).cast("string")).filter("invoice_no = 'A1'")
    found = ready.filter("invoice_no NOT IN ('A1', 'A2')").union(wrong)
    results = spark.createDataFrame([(1, "A0", False, None, ODD[3]), (1, "A3", None, "p", ODD[1]), *[(1, f"A{k}", True, "p", "") for k in (4, 5, 6)]], SEND_RESULTS)
    source, drafts, sends, out, state = (fresh_dir(spark, n) for n in ("in", "drafts", "sends", "out", "state"))
    for path, empty in ((drafts, ready), (sends, results)):
        empty.limit(0).write.parquet(path)
    for wave, path in ((raw, source), (found, drafts), (results, sends)):
        wave.write.mode("append").parquet(path)
        with retry_state.replay_settings(spark):
            settlements.stream_settlements(
                spark.readStream.schema(raw.schema).parquet(source), spark.readStream.schema(DRAFTS).parquet(drafts),
                spark.readStream.schema(SEND_RESULTS).parquet(sends), out, state, TODAY, NOW, "iso", strict,
            ).awaitTermination()
    with retry_state.replay_settings(spark):
        waiting = settlements.waiting_invoices(spark, state)
        assert [(f.name, f.dataType) for f in waiting.schema] == [(f.name, f.dataType) for f in staged.schema]
        waits = {tuple(r) for r in waiting.collect()}
    batch = decide_outcomes(staged, found, results, strict=strict)
    still = {r.invoice_no for r in batch.filter(F.col("outcome").isin(*WAITING)).collect()}
    assert still >= {"A2", "A7"} and waits == {tuple(r) for r in staged.collect() if r.invoice_no in still}
    want = {tuple(r) for r in batch.filter(~F.col("outcome").isin(*WAITING)).collect()}
    assert len(want) == 8 - len(still) and {tuple(r) for r in settlements.read_settled(spark, out, "outcomes").select(*batch.columns).collect()} == want
    kept = settlements.read_settled(spark, out, "settled").filter("faults IS NULL")
    assert {tuple(r) for r in kept.select("invoice.*").collect()} == {tuple(r) for r in staged.collect() if r.invoice_no not in still}


def test_typed_values_come_back_out_of_json(spark):
    kind = "d date, m decimal(38,18), x double, t timestamp, n bigint, b binary, flags array<boolean>, s struct<a: string, b: int>"
    rows = [
        (dt.date(1, 1, 1), Decimal("12345678901234567890.123456789012345678"), 0.1 + 0.2, dt.datetime(1999, 12, 31, 23, 59, 59, 999999), 2**63 - 1, b"\x00\xff", [True, None], (None, 1)),
        (dt.date(9999, 12, 31), Decimal("-0.000000000000000001"), float("-inf"), dt.datetime(1900, 1, 1), -(2**63), b"", [], None),
        (None, None, 5e-324, None, None, None, None, ("", None)),
    ]
    given = spark.createDataFrame(rows, kind)
    text = given.select(settlements.as_json(F.struct("*")).alias("text"))
    assert all(list(settlements.parsed(r.text)) == given.columns for r in text.collect())
    back = text.select(settlements.out_of_json(F.col("text"), T.StructType(given.schema.fields)).alias("v")).select("v.*")
    assert back.collect() == given.collect()
    far = spark.sql("SELECT date_add(DATE'9999-12-31', 400) AS d, date_sub(DATE'0001-01-01', 800) AS e")
    again = far.select(settlements.out_of_json(settlements.as_json(F.struct("*")), T.StructType(far.schema.fields)).alias("v")).select("v.*")
    assert again.select(F.unix_date("d"), F.unix_date("e")).collect() == far.select(F.unix_date("d"), F.unix_date("e")).collect()
