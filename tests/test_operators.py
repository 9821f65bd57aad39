import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from duebook import schemas
from duebook.functions import errors
from duebook.functions.text import payment_link
from duebook.operators import (
    attempts,
    audit,
    batching,
    drafts,
    failures,
    ledger,
    metrics,
    normalize,
    outcomes,
    profiling,
    retries,
    validation,
    views,
)

AS_OF = dt.date(2026, 5, 14)
NOW = dt.datetime(2026, 5, 14, 13, 0)

# A sample of invoices and the e-mails it leads to on AS_OF with day-first dates.
SAMPLE = [
    ("001", "accounts@acmetech.com", 12500.0, "2026-04-15"),
    ("002", "finance@brightsolutions.in", 8700.5, "2026-04-25"),
    ("003", "billing@nexusretail.com", 45200.75, "2026-03-30"),
    ("004", "payments@orbitlogistics.in", 15999.99, "2026-05-05"),
    ("005", "accounts.payable@zenithhealthcare.com", 22340.0, "2026-04-10"),
    ("104", "payments@orbitlogistics.in", 153200.75, "2026-04-16"),
    ("105", "accounts@zenithhealthcare.com", 78000.0, "2026-04-02"),
    ("106", "ap@vertexsystems.com", 33999.99, "2026-05-18"),
    ("107", "finance@bluepeakconsulting.com", 64210.0, "2026-05-12"),
    ("108", "accounts@deltamfg.com", 201500.0, "2026-04-29"),
    ("109", "payments@quantumlabs.com", 88765.25, "2026-04-22"),
    ("110", "accounts@evergreenfoods.com", 15999.0, "2026-04-13"),
    ("111", "billing@skylineinfra.com", 510000.0, "2026-03-29"),
    ("112", "finance@novaeducation.org", 27450.0, "2026-05-13"),
    ("113", "accounts@fusiontelecom.com", 112340.4, "2026-05-06"),
    ("114", "payments@artemispharma.com", 66500.0, "2026-04-19"),
    ("115", "billing@cloudmatrix.io", 45555.55, "2026-05-01"),
    ("116", "accounts@ecobuildprojects.com", 98000.0, "2026-04-07"),
    ("117", "finance@metromobility.com", 34999.0, "2026-05-15"),
    ("118", "ap@pulseanalytics.ai", 73500.0, "2026-04-27"),
]
SENT_SUBJECTS = {
    "001": "FINAL NOTICE – Invoice #INV-2026-001 – Immediate Action Required",
    "104": "FINAL NOTICE – Invoice #INV-2026-104 – Immediate Action Required",
    "109": "FINAL NOTICE – Invoice #INV-2026-109 – Immediate Action Required",
    "114": "FINAL NOTICE – Invoice #INV-2026-114 – Immediate Action Required",
    "002": "IMPORTANT: Outstanding Payment – Invoice #INV-2026-002 (19 Days Overdue)",
    "108": "IMPORTANT: Outstanding Payment – Invoice #INV-2026-108 (15 Days Overdue)",
    "118": "IMPORTANT: Outstanding Payment – Invoice #INV-2026-118 (17 Days Overdue)",
    "004": "Payment Follow-Up – Invoice #INV-2026-004 (9 Days Overdue)",
    "112": "Quick Reminder – Invoice #INV-2026-112 | ₹27,450 Due",
}


def raw(spark, rows, job=1):
    return spark.createDataFrame(
        [(job, f"INV-2026-{n}", f"Client {n}", mail, str(amount), due) for n, mail, amount, due in rows],
        "job_id long, invoice_number string, client_name string, recipient_email string, amount string, due_date string",
    )


def staged(spark, rows=None):
    return normalize.stage_invoices(normalize.normalize_invoices(raw(spark, rows or SAMPLE)), F.lit(AS_OF))


def moment(value=NOW):
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def test_sample_run(spark):
    rows = staged(spark)
    stages = {r.stage_key: (r.n, float(r.a)) for r in rows.groupBy("stage_key").agg(F.count("*").alias("n"), F.sum("amount").alias("a")).collect()}
    assert stages == {
        "1st Follow-Up": (1, 27450.00), "2nd Follow-Up": (1, 15999.99), "3rd Follow-Up": (3, 283700.50),
        "4th Follow-Up": (4, 320966.00), "Escalation Flag": (5, 694755.30), "No_overdue": (6, 365889.39),
    }
    done = outcomes.decide_outcomes(rows, drafts.template_drafts(rows))
    log = outcomes.email_log_rows(done, moment()).collect()
    assert {r.invoice_no[-3:]: r.subject for r in log} == SENT_SUBJECTS
    mails = {n: m for n, m, *_ in SAMPLE}
    tones = {r.stage_key: r.tone for r in schemas.stage_table(spark).collect()}
    stage_of = {r.invoice_no: r.stage_key for r in rows.collect()}
    for r in log:
        assert r.to == mails[r.invoice_no[-3:]]
        assert r.tone == tones[stage_of[r.invoice_no]]


def test_quarantine_and_stop_on_bad_dates(spark):
    rows = normalize.normalize_invoices(
        raw(spark, [("1", "a@b.co", 1.0, "someday"), ("2", None, "x", None), ("3", "c@d.co", 2.0, "1 May 2026")])
    )
    good, bad = normalize.split_faulty(rows)
    assert [r.invoice_no for r in good.collect()] == ["INV-2026-3"]
    assert {r.invoice_no[-1]: r.faults for r in bad.collect()} == {
        "1": ["unreadable due_date"],
        "2": ["missing contact_email", "unreadable amount", "missing due_date"],
    }
    with pytest.raises(ValueError, match="2 invoices"):
        normalize.split_faulty(rows, "fail")


def draft_table(spark, rows):
    return spark.createDataFrame(rows, schemas.DRAFTS)


def good_draft(**changes):
    draft = {
        "recipient": " Finance@NovaEducation.org", "subject": SENT_SUBJECTS["112"] + " ", "greeting": "Hi Client 112,",
        "body": "INV-2026-112 is 1 day late https://pay.company.com/INV-2026-112", "closing": "Bye",
        "tone": "Warm & Friendly",
    }
    draft.update(changes)
    return [draft[c] for c in schemas.DRAFT_FIELDS]


RULES = [
    (good_draft(), ("approved", 0, "")),
    ([None] * 6, ("rejected", 1, "No email draft generated.")),
    (good_draft(recipient="a@b.co"), ("rejected", 2, "Recipient email does not match invoice contact email.")),
    (good_draft(tone="Stern & Urgent"), ("rejected", 3, "Tone must be exactly 'Warm & Friendly'.")),
    (good_draft(subject="x"), ("rejected", 4, f"Subject must be exactly: '{SENT_SUBJECTS['112']}'")),
    (good_draft(greeting="Hi"), ("rejected", 5, "Email must include: Client 112")),
    (good_draft(body="x"), ("rejected", 5, "Email must include: INV-2026-112")),
    (good_draft(body="INV-2026-112 is 1 day late"), ("rejected", 5, "Email must include: https://pay.company.com/INV-2026-112")),
    (good_draft(tone="Cheerful"), ("invalid", 6, "Draft record is not valid: tone")),
    (good_draft(recipient="nobody"), ("invalid", 6, "Draft record is not valid: recipient")),
    (good_draft(closing=None), ("invalid", 6, "Draft record is not valid: closing")),
]


def test_each_rule(spark):
    rows = drafts.with_subject(staged(spark, [s for s in SAMPLE if s[0] == "112"]))
    table = draft_table(spark, [(1, "INV-2026-112", i, *d) for i, (d, _) in enumerate(RULES)])
    got = {r.revision: (r.status, r.rule, r.feedback) for r in validation.judge_drafts(rows, table).collect()}
    assert got == {i: want for i, (_, want) in enumerate(RULES)}
    none = validation.judge_drafts(rows, draft_table(spark, [])).first()
    assert (none.status, none.rule) == ("rejected", 1)


def test_strict_search_wants_whole_words(spark):
    rows = drafts.with_subject(staged(spark, [s for s in SAMPLE if s[0] == "112"]))
    body = "INV-2026-112 due 2026-05-13 https://pay.company.com/INV-2026-112"
    table = draft_table(spark, [(1, "INV-2026-112", 0, *good_draft(body=body))])
    assert validation.judge_drafts(rows, table).first().status == "approved"
    assert validation.judge_drafts(rows, table, strict=True).first().feedback == "Email must include: 1"


@pytest.mark.parametrize(
    ("revisions", "start", "want"),
    [
        (["bad", "good"], 0, ("approved", 1)),
        (["bad", "bad", "bad", "good"], 0, ("exhausted", 3)),
        (["bad", "bad"], 0, ("awaiting_draft", 2)),
        ([], 0, ("awaiting_draft", 0)),
        (["bad", "broken", "good"], 0, ("invalid", 1)),
        (["bad", "good"], 2, ("exhausted", 1)),
        (["good"], 5, ("approved", 0)),
    ],
)
def test_revision_fold(spark, revisions, start, want):
    kinds = {"good": good_draft(), "bad": good_draft(subject="x"), "broken": good_draft(tone="Cheerful")}
    rows = drafts.with_subject(staged(spark, [s for s in SAMPLE if s[0] == "112"])).withColumn("retry_count", F.lit(start))
    table = draft_table(spark, [(1, "INV-2026-112", i, *kinds[k]) for i, k in enumerate(revisions)])
    row = validation.fold_revisions(rows, table).first()
    assert (row.draft_state, row.rejections) == want


def test_fold_refuses_rows_beyond_its_revisions(spark):
    rows = drafts.with_subject(staged(spark)).withColumn("max_retries", F.lit(9))
    with pytest.raises(Exception, match="needs revisions >= 9"):
        validation.fold_revisions(rows, draft_table(spark, [])).collect()


def test_attempts(spark):
    table = spark.createDataFrame(
        [(1, "ok", 0, "timeout"), (1, "ok", 1, None), (1, "ok", 2, "bad request"), (1, "bad", 0, "bad request"), (1, "on", 0, "HTTP 429")]
        + [(1, "spent", i, "HTTP 429") for i in range(7)],
        schemas.ATTEMPTS,
    )
    want = {
        "ok": ("succeeded", None, 2, 2), "bad": ("failed", "bad request", 1, 0), "on": ("in_flight", None, 1, 0),
        "spent": ("failed", "Maximum retry attempts (5) exceeded.", 5, 30),
    }
    got = {r.invoice_no: tuple(r)[2:] for r in attempts.fold_attempts(table).collect()}
    assert got == want
    people = spark.createDataFrame([(1, "ok"), (1, "new")], "job_id long, invoice_no string")
    resolved = {r.invoice_no: r.attempt_error for r in attempts.resolve_attempts(people, table).collect()}
    assert resolved == {"ok": None, "new": "Unknown processing error."}


def naive_batches(rows, size):
    groups, seen = defaultdict(list), defaultdict(list)
    for job, stage, number in sorted(rows, key=lambda r: r[2]):
        groups[job, stage].append(number)
        if stage not in seen[job]:
            seen[job].append(stage)
    out = []
    for job, stages in seen.items():
        place = 0
        for stage in stages:
            for i, number in enumerate(groups[job, stage]):
                place += 1
                out.append((job, stage, number, f"{stage}_{i // size + 1}", i % size + 1, place))
    return sorted(out)


def test_batches_equal_the_plain_way_on_uneven_data_with_copies(spark):
    random.seed(5)
    rows = [(1, "A", f"N{i:05d}") for i in range(3000)] + [(1, "B", "N00007")] * 2000
    rows += [(random.randrange(4), random.choice("ABC"), f"N{random.randrange(900):05d}") for _ in range(3000)]
    table = spark.createDataFrame(rows, "job_id long, stage_key string, invoice_no string").repartition(7)
    got = sorted(tuple(r) for r in batching.assign_batches(table).collect())
    plain = naive_batches(rows, 10)
    assert [r[:5] for r in got] == [r[:5] for r in plain]
    jobs = defaultdict(list)
    for r in got:
        jobs[r[0]].append(r[5])
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in jobs.values())


def test_first_row_of_a_key_wins_and_a_rerun_adds_nothing(spark):
    columns = "job_id long, invoice_no string, send_status string, retry_count int, created_at int"
    new = spark.createDataFrame([(1, "a", "sent", 0, 5), (1, "a", "sent", 0, 3), (1, "a", None, 0, 1), (1, "b", "sent", 0, 2)], columns)
    old = spark.createDataFrame([(1, "b", "sent", 0, 0)], columns)
    added = audit.new_audit_rows(new, old)
    assert {(r.invoice_no, r.send_status, r.created_at) for r in added.collect()} == {("a", "sent", 3), ("a", None, 1)}
    table = audit.append_audit(new, old)
    assert audit.new_audit_rows(new, table).count() == 0


def failed_row(number, count=0, limit=5, status="pending", due=NOW, updated=NOW, state="{}"):
    return (1, number, state, "permanent", "bad", count, limit, due, status, updated, updated)


def test_upsert_keeps_the_creation_time(spark):
    earlier, later = NOW - dt.timedelta(days=1), NOW + dt.timedelta(hours=1)
    old = spark.createDataFrame([failed_row("a", 4, status="resolved", updated=earlier), failed_row("b", updated=earlier)], schemas.FAILED)
    new = spark.createDataFrame([failed_row("a", 0, updated=NOW), failed_row("a", 1, updated=later), failed_row("c", updated=NOW)], schemas.FAILED)
    got = {r.invoice_no: (r.status, r.retry_count, r.created_at, r.updated_at) for r in failures.upsert_failures(old, new).collect()}
    assert got == {"a": ("pending", 1, earlier, later), "b": ("pending", 0, earlier, earlier), "c": ("pending", 0, NOW, NOW)}


def test_retry_cycles_end(spark):
    queue = spark.createDataFrame([failed_row("a", 0, 3), failed_row("b", 0, 5)], schemas.FAILED)
    now, seen = NOW, []
    for cycle in range(4):
        now = now + dt.timedelta(hours=2)
        due = failures.due_failures(queue, moment(now))
        ok = (F.col("invoice_no") == "b") & F.lit(cycle == 1)
        results = due.select("job_id", "invoice_no", F.when(ok, F.lit("not_sent")).otherwise(F.lit("failed")).alias("send_status"), F.lit("still bad").alias("send_error"))
        rows = retries.apply_results(queue, results, moment(now)).collect()
        queue = spark.createDataFrame(rows, schemas.FAILED)
        seen.append({r.invoice_no: (r.status, r.retry_count) for r in rows})
    assert seen == [
        {"a": ("pending", 1), "b": ("pending", 1)},
        {"a": ("pending", 2), "b": ("resolved", 1)},
        {"a": ("permanent_failure", 3), "b": ("resolved", 1)},
        {"a": ("permanent_failure", 3), "b": ("resolved", 1)},
    ]
    ended = {r.invoice_no: r.next_retry_at for r in rows}
    assert ended["a"] is None


def test_stored_state_round_trip(spark):
    rows = drafts.with_subject(staged(spark)).withColumns(
        {"validation_status": F.lit(None).cast("string"), "validation_feedback": F.lit(""), "send_status": F.lit("failed"), "send_error": F.lit("é \"q\"")}
    )
    queue = rows.select("job_id", "invoice_no", F.to_json(outcomes.state_struct()).alias("invoice_state_json"))
    queue = queue.unionByName(spark.createDataFrame([(1, "x", "{oops"), (1, "y", '{"retry_count": 2}')], queue.schema))
    readable, broken = failures.split_states(queue)
    assert {r.invoice_no for r in broken.collect()} == {"x", "y"}
    back = retries.restored_invoices(readable)
    shared = [c for c in back.columns if c in rows.columns and c != "amount_raw"]
    assert back.select(*shared).exceptAll(rows.select(*shared)).count() == 0
    assert back.count() == len(SAMPLE)
    later = retries.restored_invoices(readable, F.lit(AS_OF + dt.timedelta(days=40)))
    assert later.filter(F.col("invoice_no") == "INV-2026-112").first().stage_key == "Escalation Flag"


def test_jobs_fold(spark):
    t = [NOW + dt.timedelta(minutes=i) for i in range(4)]
    events = spark.createDataFrame(
        [(1, 0, "queued", t[0], None, "p", "h"), (1, 1, "running", t[1], None, None, None), (1, 2, "failed", t[2], "boom", None, None), (1, 3, "running", t[3], None, None, None),
         (2, 0, "queued", t[1], None, "p", "h")],
        schemas.JOB_EVENTS,
    )
    jobs = ledger.fold_jobs(events)
    first = jobs.filter("id = 1").first()
    assert (first.status, first.started_at, first.completed_at, first.error_message) == ("running", t[3], t[2], None)
    prints = spark.createDataFrame([("h",), ("new",)], "file_hash string")
    decided = {r.file_hash: (r.decision, r.existing_job_id) for r in ledger.ingest_decision(prints, jobs).collect()}
    assert decided == {"h": ("in_progress", 2), "new": ("new", None)}


def test_column_profile(spark):
    table = spark.createDataFrame([("1", "1.5", "x", None), ("2", None, "x", None), ("3", "2", None, None), ("3", "2", "y", None)], "a string, b string, c string, d string")
    got = {r.column_name: tuple(r)[1:] for r in profiling.column_profile(table).collect()}
    assert got == {"a": ("int64", 100.0, 3), "b": ("float64", 75.0, 2), "c": ("object", 75.0, 2), "d": ("float64", 0.0, 0)}
    rough = {r.column_name: r.unique_values for r in profiling.column_profile(table, approximate=True).collect()}
    assert rough == {"a": 3, "b": 2, "c": 2, "d": 0}


def test_email_views_keep_rows_without_a_stage(spark):
    feed = spark.createDataFrame([("1", "Ab", None, "sent"), ("2", "c", "No_overdue", "not_sent")], "invoice_no string, client string, stage_key string, send_status string")
    assert [r.invoice_no for r in views.email_view(feed, kind="Client emails").collect()] == ["1"]
    assert [r.invoice_no for r in views.email_view(feed, search=" 1A").collect()] == ["1"]
    with pytest.raises(ValueError):
        views.email_view(feed, kind="other")


def test_an_existing_link_is_kept(spark):
    row = spark.range(1).select(payment_link(F.lit("7"), F.lit("https://x")).alias("a"), payment_link(F.lit("7"), F.lit("")).alias("b")).first()
    assert (row.a, row.b) == ("https://x", "https://pay.company.com/7")


def test_nothing_can_be_sent_without_a_draft(spark):
    rows = spark.createDataFrame(
        [(1, None, True), (2, "d", True), (3, "d", False)], "id int, draft string, ok boolean"
    ).withColumn("send", F.struct(F.col("ok").alias("success"), F.lit("mailer").alias("provider"), F.lit("down").alias("message")))
    went, error = outcomes.send_result(F.col("draft"), F.col("send"))
    got = {r.id: (r.went, r.error) for r in rows.select("id", went.alias("went"), error.alias("error")).collect()}
    assert got == {
        1: (False, "No email draft available to send."),
        2: (True, None),
        3: (False, "Send failed via mailer: down"),
    }


def test_second_copy_of_a_file_is_in_progress(spark):
    prints = spark.createDataFrame([("b", "h"), ("a", "h"), ("c", "k")], "file_path string, file_hash string")
    jobs = spark.createDataFrame([(7, "k", "completed")], "id long, file_hash string, status string")
    got = {r.file_path: (r.decision, r.existing_job_id) for r in ledger.ingest_decision(prints, jobs).collect()}
    assert got == {"a": ("new", None), "b": ("in_progress", None), "c": ("cached", 7)}


def test_waiting_invoices_are_not_processed(spark):
    rows = spark.createDataFrame(
        [(1, "sent", False, 0), (1, "pending", False, 0), (1, "failed", False, 0)],
        "job_id long, send_status string, escalation_required boolean, retry_count int",
    )
    row = metrics.job_metrics(rows).first()
    assert (row.total_records, row.processed_count, row.successful_count, row.success_rate) == (3, 2, 1, 50.0)
    loaded = spark.createDataFrame([(1, 9), (2, 4)], "job_id long, total_records long")
    got = {r.job_id: (r.total_records, r.processed_count) for r in metrics.job_metrics(rows, loaded).collect()}
    assert got == {1: (9, 2), 2: (4, 0)}


def test_waits_end_within_a_long(spark):
    row = spark.range(1).select(
        errors.wait_before_retry(F.lit(4)).alias("a"), errors.wait_before_retry(F.lit(500)).alias("b")
    ).first()
    assert row.a == 32 and row.b == 2**62
