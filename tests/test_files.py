"""Files, stored tables, whole runs and streams."""

import datetime as dt
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from duebook import schemas
from duebook.operators import drafts, normalize, outcomes
from duebook.plans.followup import Store, run_follow_up
from duebook.plans.retry_cycle import run_retry_cycle
from duebook.session import fresh_dir
from duebook.sources import files, fingerprints, invoice_csv, tables
from duebook.sources.tables import SnapshotTable
from registry import ORACLES, QUERIES
from registry.check import compare, connect

FOLDER = "/root/testdata/sf0.001"
HEAD = "client_name,recipient_email,invoice_number,amount,due_date\n"
AS_OF, NOW = dt.date(2026, 5, 14), dt.datetime(2026, 5, 14, 13)


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_is_read_by_name(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'due_date,extra,amount,invoice_number,client_name,recipient_email\n1 May 2026,x,5.5,00123,"A ""B"", C",a@b.co\n,,NA,2,,\n')
    rows = invoice_csv.read_invoice_csv(spark, path, null_tokens=("NA",)).collect()
    assert (rows[0].invoice_number, rows[0].client_name, rows[0].extra) == ("00123", 'A "B", C', "x")
    assert (rows[1].amount, rows[1].client_name) == (None, None)


def test_csv_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="path is required"):
        invoice_csv.read_invoice_csv(spark, "")
    with pytest.raises(FileNotFoundError):
        invoice_csv.read_invoice_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match=r"\.csv"):
        invoice_csv.read_invoice_csv(spark, write(tmp_path / "a.txt", HEAD))
    with pytest.raises(ValueError, match="no rows"):
        invoice_csv.read_invoice_csv(spark, write(tmp_path / "empty.csv", HEAD))
    with pytest.raises(ValueError, match="Missing required columns: amount, due_date"):
        invoice_csv.read_invoice_csv(spark, write(tmp_path / "b.csv", "client_name,recipient_email,invoice_number\na,b,c\n"))


def test_line_ends_in_quotes_need_multi_line(spark, tmp_path):
    path = write(tmp_path / "m.csv", HEAD + '"A\nB",a@b.co,1,2,1 May 2026\n')
    assert invoice_csv.read_invoice_csv(spark, path, multi_line=True).first().client_name == "A\nB"


def test_mixed_column_orders(spark, tmp_path):
    write(tmp_path / "a.csv", HEAD + "A,a@b.co,1,2,1 May 2026\n")
    write(tmp_path / "b.csv", "due_date,note,amount,invoice_number,client_name,recipient_email\n2 May 2026,n,3,2,B,b@b.co\n")
    rows = {r.invoice_number: (r.client_name, r.amount, r.due_date) for r in invoice_csv.read_mixed_csv(spark, str(tmp_path)).collect()}
    assert rows == {"1": ("A", "2", "1 May 2026"), "2": ("B", "3", "2 May 2026")}
    with pytest.raises(Exception, match="(?i)header"):
        invoice_csv.read_invoice_csv(spark, str(tmp_path)).collect()


def test_fingerprints(spark, tmp_path):
    write(tmp_path / "a.csv", "abc")
    write(tmp_path / "b.csv", "x" * 100)
    got = {r.length: r.file_hash for r in fingerprints.file_fingerprints(spark, str(tmp_path), whole_up_to=50).collect()}
    assert got == {3: hashlib.sha256(b"abc").hexdigest(), 100: hashlib.sha256(b"x" * 100).hexdigest()}


def test_email_log_keeps_its_text(spark, tmp_path):
    row = (NOW, "dry_run", "1", "a@b.co", "₹5 – x", "Warm & Friendly", "Hi,\n\n\"q\" é")
    log = spark.createDataFrame([row], schemas.EMAIL_LOG)
    path = str(tmp_path / "log")
    files.append_email_log(log, path)
    files.append_email_log(log, path)
    assert [tuple(r) for r in files.read_email_log(spark, path).collect()] == [row, row]
    written = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "log").glob("part*"))
    assert written.count("₹5 – x") == 2


def test_snapshot_versions(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), schemas.SEND_RESULTS)
    assert table.read().count() == 0
    assert table.write(spark.createDataFrame([(1, "a", True, "p", "m")], schemas.SEND_RESULTS)) == 1
    assert table.write(table.read().unionByName(table.read())) == 2
    (tmp_path / "t" / "v3").mkdir()
    assert table.versions() == [1, 2] and table.read().count() == 2


def raw(spark):
    rows = [(1, f"N{i}", f"Client {i}", f"c{i}@b.co", float(i), AS_OF - dt.timedelta(days=i)) for i in range(40)]
    rows.append((1, "N99", " ", "c@b.co", 1.0, AS_OF))
    return spark.createDataFrame(rows, "job_id long, invoice_number string, client_name string, recipient_email string, amount double, due_date date")


def test_a_run_puts_every_invoice_in_one_place_and_can_be_repeated(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    staged = normalize.stage_invoices(normalize.normalize_invoices(raw(spark)), F.lit(AS_OF))
    made = drafts.template_drafts(staged)
    broken = made.withColumn("tone", F.when(F.col("invoice_no") == "N3", F.lit("Cheerful")).otherwise(F.col("tone")))
    given = broken.filter(F.col("invoice_no") != "N4")
    sends = given.select("job_id", "invoice_no", (F.col("invoice_no") != "N5").alias("success"), F.lit("mailer").alias("provider"), F.lit("timeout").alias("message"))
    for _ in range(2):
        row = run_follow_up(store, raw(spark), given, AS_OF, NOW, sends).first()
        audit = {r.invoice_no: r.send_status for r in store.audit.read().collect()}
        queue = {r.invoice_no: (r.error_type, r.max_retries) for r in store.queue.read().collect()}
        assert len(audit) == store.audit.read().count() == 38
        assert files.read_email_log(spark, store.email_log).count() == 27
        assert queue == {"N3": ("permanent", 5), "N5": ("retryable", 3)}
        assert {f"N{i}" for i in range(40)} == set(audit) | set(queue) | {"N4"}
        assert (row.total_records, row.processed_count) == (41, 39)  # N99 is in quarantine, N4 waits
        assert (row.sent_count, row.failed_count, row.not_sent_count, row.escalated_count) == (27, 2, 10, 9)
    quarantine = store.quarantine(store.spark.read.parquet(f"{tmp_path}/quarantine").schema)
    assert quarantine.read().first().invoice_no == "N99"

    good = sends.withColumn("success", F.lit(True))
    run_retry_cycle(store, made, NOW + dt.timedelta(hours=1), good)
    after = {r.invoice_no: (r.status, r.retry_count) for r in store.queue.read().collect()}
    assert after == {"N3": ("resolved", 0), "N5": ("resolved", 0)}
    assert store.audit.read().filter("invoice_no = 'N5'").count() == 2


def test_outcomes_without_send_results_are_a_dry_run(spark):
    staged = normalize.stage_invoices(normalize.normalize_invoices(raw(spark)), F.lit(AS_OF))
    done = outcomes.decide_outcomes(staged, drafts.template_drafts(staged))
    assert {r.outcome for r in done.collect()} == {"not_overdue", "sent", "escalated_stage"}


CHECKED = [
    "receivables_by_stage", "due_dates_day_first", "quarantined_invoices", "message_bodies", "masked_emails",
    "draft_rulings", "invoice_outcomes", "audit_records", "first_audit_rows", "queue_upsert", "retry_transitions",
    "job_ledger", "job_metrics", "invoice_batches", "column_profile", "constraint_audit", "streamed_first_wins",
    "streamed_metrics",
]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    verdict = compare(spark, connect(FOLDER), FOLDER, name, QUERIES[name], ORACLES[name])
    assert verdict.startswith("ok") and "TYPES" not in verdict and "EMPTY" not in verdict, verdict


def test_names_agree():
    assert set(ORACLES) <= set(QUERIES)
    assert duckdb.__version__


def test_wide_and_headless_files(spark, tmp_path):
    wide = ",".join(f"n{k}" for k in range(50))
    write(tmp_path / "wide.csv", f"{wide},{HEAD.strip()}\n{wide},A,a@b.co,1,2,1 May 2026\n")
    write(tmp_path / "none.csv", "1,2,3\n")
    rows = invoice_csv.read_mixed_csv(spark, str(tmp_path)).collect()
    assert [(r.client_name, r.due_date) for r in rows] == [("A", "1 May 2026")]
    lacking = invoice_csv.headless_files(spark, str(tmp_path)).collect()
    assert [r.file_path.rsplit("/", 1)[-1] for r in lacking] == ["none.csv"]


def test_old_versions_go_and_jobs_are_cleared(spark, tmp_path):
    schema = "job_id long, x int"
    kind = spark.createDataFrame([], schema).schema
    table = tables.SnapshotTable(spark, str(tmp_path / "s"), kind, keep=2)
    for x in range(4):
        table.write(spark.createDataFrame([(1, x)], schema))
    assert table.versions() == [3, 4] and table.read().first().x == 3
    jobs = tables.PartitionedTable(spark, str(tmp_path / "p"), kind)
    jobs.append(spark.createDataFrame([(1, 1), (2, 2), (3, 3)], schema))
    jobs.clear([1, 9])
    assert sorted(r.job_id for r in jobs.read().collect()) == [2, 3]
    assert [r.x for r in jobs.read([3]).collect()] == [3]


def test_many_files_are_few_folders_and_few_tasks(spark):
    """Equal keys share a file, missing texts are empty lines; nothing is left of the settings changed for reading."""
    path = fresh_dir(spark, "texts")
    texts = {n: f"text {n} \u00e9" for n in range(300)}
    rows = [(n, text) for n, text in texts.items()] + [(300, None), (301, "twice"), (301, "twice")]
    files.write_text_files(spark.createDataFrame(rows, "n long, t string").repartition(5), path, "n", "t")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    prints = fingerprints.file_fingerprints(spark, path, whole_up_to=10)
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    found = {int(r.file_path.rsplit("n=", 1)[1][:-4]): r.file_hash for r in prints.collect()}
    want = {n: f"{text}\n" for n, text in texts.items()} | {300: "\n", 301: "twice\ntwice\n"}
    assert found == {n: hashlib.sha256(text.encode()).hexdigest() for n, text in want.items()}
    assert len({r.file_path.rsplit("/", 1)[0] for r in prints.collect()}) <= 8
