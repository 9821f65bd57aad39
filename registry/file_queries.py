"""Queries that go through files, stored tables and streams on their way."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from duebook.operators import audit, ledger, normalize, profiling, views
from duebook.plans import upload
from duebook.plans.followup import Store, run_follow_up
from duebook.plans.retry_cycle import run_retry_cycle
from duebook.schemas import AUDIT, DRAFTS, SEND_RESULTS
from duebook.session import fresh_dir, write_and_read
from duebook.sources import files, fingerprints, invoice_csv, star
from duebook.sources.recent import RecentTable
from duebook.sources.tables import PartitionedTable
from duebook.streaming import conflicts, ingest, live_metrics, retry_state, settlements
from duebook.streaming.batches import read_batches
from registry import queries as q
from registry.queries import query
from registry.sql import TIME, backoff, retryable

_ACCEPTED = (
    "SELECT job_id, invoice_no, CAST(CAST(amount_text AS DECIMAL(18,2)) AS DOUBLE) AS amount, "
    "CAST(due_date AS VARCHAR) AS due_date FROM faulted WHERE faults = ''"
)


def _accepted(raw):
    good, _ = normalize.split_faulty(normalize.normalize_invoices(raw))
    return good.select("job_id", "invoice_no", "amount", "due_date")


@query(_ACCEPTED)
def invoice_files(spark, folder):
    path = fresh_dir(spark, "invoice-files")
    files.export_csv(star.invoices_text(spark, folder), path)
    return _accepted(invoice_csv.read_invoice_csv(spark, path))


@query(_ACCEPTED.replace("job_id, ", ""))
def mixed_invoice_files(spark, folder):
    path = fresh_dir(spark, "mixed-files")
    rows = star.invoices_text(spark, folder)
    late = F.col("due_date").contains("/")
    files.export_csv(rows.filter(late), path)
    other = rows.filter(~F.coalesce(late, F.lit(False))).select(
        "due_date", "amount", "invoice_number", "recipient_email", "client_name"
    )
    other.write.mode("append").option("header", True).option("escape", '"').csv(path)
    return _accepted(invoice_csv.read_mixed_csv(spark, path)).drop("job_id")


@query(
    f"SELECT o_custkey % {star.JOBS} AS job_id, count(*) AS invoices FROM orders GROUP BY ALL"
)
def invoices_per_file(spark, folder):
    path = fresh_dir(spark, "job-files")
    rows = star.invoices_text(spark, folder)
    rows.withColumn("part", F.col("job_id")).write.partitionBy("part").option("header", True).csv(path)
    read = invoice_csv.read_invoice_csv(spark, path, with_file=True)
    prints = fingerprints.file_fingerprints(spark, path)
    uploads = prints.filter(F.col("file_path").endswith(".csv")).select(
        "file_path",
        F.regexp_extract("file_path", r"part=(\d+)", 1).cast("long").alias("job_id"),
    )
    named = invoice_csv.with_job_ids(read.drop("job_id", "part"), uploads)
    return named.groupBy("job_id").agg(F.count("*").alias("invoices"))


@query(
    "SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS length, sha256(text || chr(10)) AS file_hash FROM documents"
)
def file_fingerprints(spark, folder):
    """Every document as a file of its own; files over 4000 bytes are hashed chunk by chunk."""
    path = fresh_dir(spark, "document-files")
    docs = star.table(spark, folder, "documents").select("text", "doc_id")
    files.write_text_files(docs, path, "doc_id", "text")
    prints = fingerprints.file_fingerprints(spark, path, whole_up_to=4000)
    return prints.filter(F.col("file_path").endswith(".txt")).select(
        F.regexp_extract("file_path", r"doc_id=(\d+)", 1).cast("long").alias("doc_id"), "length", "file_hash"
    )


_WIDE = 36


@query(_ACCEPTED.replace("job_id, ", ""))
def wide_invoice_files(spark, folder):
    """Files in which 36 other columns stand before the required ones."""
    path = fresh_dir(spark, "wide-files")
    rows = star.invoices_text(spark, folder)
    others = [F.lit(f"n{k}").alias(f"note_{k}") for k in range(_WIDE)]
    files.export_csv(rows.select(*others, *invoice_csv.fv.REQUIRED_COLUMNS), path)
    return _accepted(invoice_csv.read_mixed_csv(spark, path)).drop("job_id")


@query(
    f"SELECT CAST(o_custkey % {star.JOBS} AS BIGINT) AS job_id, 'invoices' AS kind, count(*) AS n FROM orders GROUP BY ALL "
    f"UNION ALL SELECT DISTINCT CAST(o_custkey % {star.JOBS} AS BIGINT), 'headless', 0 FROM orders WHERE o_custkey % {star.JOBS} % 2 = 1"
)
def headless_files(spark, folder):
    """Files of even jobs have a header, odd ones a file without one beside it."""
    path = fresh_dir(spark, "headless-files")
    rows = star.invoices_text(spark, folder).withColumn("part", F.col("job_id")).repartition("part")
    rows.write.partitionBy("part").option("header", True).csv(path)
    odd = rows.filter("job_id % 2 = 1").select("due_date", "part").distinct()
    odd.withColumn("due_date", F.lit("x")).distinct().write.mode("append").partitionBy("part").csv(path)
    part = F.regexp_extract("file_path", r"part=(\d+)", 1).cast("long").alias("job_id")
    read = invoice_csv.read_mixed_csv(spark, f"{path}/*").groupBy(part).agg(F.count("*").alias("n"))
    lacking = invoice_csv.headless_files(spark, f"{path}/*").select(part, F.lit("headless").alias("kind"), F.lit(0).alias("n"))
    return read.select("job_id", F.lit("invoices").alias("kind"), "n").unionByName(lacking)


@query(q.EMAIL_LOG_SQL)
def email_log_files(spark, folder):
    path = fresh_dir(spark, "email-log")
    files.append_email_log(q.outcomes.email_log_rows(q._outcomes(spark, folder), star.now()), path)
    return files.read_email_log(spark, path)


@query("SELECT CAST(id AS VARCHAR) AS id, file_hash, status FROM jobs WHERE status = 'failed'")
def exported_jobs(spark, folder):
    path = fresh_dir(spark, "jobs-csv")
    jobs = ledger.fold_jobs(star.job_events(spark, folder))
    files.export_csv(views.jobs_view(jobs, ["failed"]).select("id", "file_hash", "status"), path)
    return spark.read.option("header", True).schema("id STRING, file_hash STRING, status STRING").csv(path)


@query(f"SELECT job_id, invoice_no, error_type, error_message, retry_count, status FROM ({q._NEW_FAILED})")
def exported_failures(spark, folder):
    path = fresh_dir(spark, "failures-csv")
    names = ["job_id", "invoice_no", "error_type", "error_message", "retry_count", "status"]
    files.export_csv(q._queue_rows(spark, folder).select(*names), path)
    kinds = "job_id LONG, invoice_no STRING, error_type STRING, error_message STRING, retry_count INT, status STRING"
    return spark.read.option("header", True).option("escape", '"').schema(kinds).csv(path)


_AUDIT_EXPORT = ["job_id", "invoice_no", "client", "stage_key", "subject", "send_status", "error_message", "retry_count"]


@query(
    "SELECT job_id, retry_count, "
    + ", ".join(f"nullif({c}, '') AS {c}" for c in _AUDIT_EXPORT if c not in ("job_id", "retry_count"))
    + " FROM audit"
)
def exported_audit(spark, folder):
    """Empty and missing texts are one in such a file, and read back as missing."""
    path = fresh_dir(spark, "audit-csv")
    files.export_csv(q._audit(spark, folder).select(*_AUDIT_EXPORT), path)
    kinds = T.StructType([AUDIT[name] for name in _AUDIT_EXPORT])
    return spark.read.option("header", True).option("escape", '"').schema(kinds).csv(path)


@query(f'SELECT invoice_no, "to", subject, tone, body FROM ({q.EMAIL_LOG_SQL})')
def exported_emails(spark, folder):
    """Bodies run over several lines."""
    path = fresh_dir(spark, "emails-csv")
    files.export_csv(q.email_log(spark, folder).select("invoice_no", "to", "subject", "tone", "body"), path)
    kinds = "invoice_no STRING, `to` STRING, subject STRING, tone STRING, body STRING"
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(kinds).csv(path)


def _recent_audit(spark, folder):
    table = RecentTable(spark, fresh_dir(spark, "recent"), AUDIT, seconds=600)
    table.append(q._audit(spark, folder))
    return table


@query(f"{q._FEED_SELECT}{q._FEED}")
def stored_email_feed(spark, folder):
    """The feed out of folders by time, of which only the newest are opened."""
    return views.email_feed(_recent_audit(spark, folder).newest(300))


@query(
    f"{q._FEED_SELECT}(SELECT * FROM audit WHERE job_id = 5 AND created_at < {TIME} + INTERVAL 900 SECOND "
    "ORDER BY created_at DESC, job_id, invoice_no LIMIT 20)"
)
def stored_email_next_page(spark, folder):
    """A page of one job from a time on, out of the folders that end there."""
    after = (star.NOW + dt.timedelta(seconds=900), 10**6, "~")

    def rest(rows):
        return views.next_page(rows.filter("job_id = 5"), after)

    return rest(_recent_audit(spark, folder).newest(20, rest, at=after[0]))


_CLOSE = "unique_values BETWEEN 0.98 * exact AND 1.02 * exact"


@query(f"SELECT * EXCLUDE (unique_values), true AS within_two_percent FROM ({q.PROFILE_SQL})")
def profile_of_all_jobs(spark, folder):
    """The profile of all jobs from the sketches stored per job, held against the exact one."""
    loose = q._loose(spark, folder)
    rows = profiling.profile_sketches(loose)
    table = PartitionedTable(spark, fresh_dir(spark, "profiles"), rows.schema)
    table.replace(rows)
    exact = profiling.column_profile(loose).select("column_name", F.col("unique_values").alias("exact"))
    merged = profiling.profile_from_sketches(table.read()).join(exact, "column_name")
    return merged.select("column_name", "type", "filled_percent", F.expr(_CLOSE).alias("within_two_percent"))


def _run(spark, folder, runs=("sends",), raw=None, between=None, drafts=None):
    """Runs one after the other, each with the send results or dry."""
    store = Store(spark, fresh_dir(spark, "store"))
    drafts = write_and_read(star.drafts(spark, folder), "drafts") if drafts is None else drafts
    sends = star.send_results(spark, folder)
    raw = (star.invoices_balanced(spark, folder) if raw is None else raw).drop("o_orderkey")
    for k, kind in enumerate(runs):
        if k and between:
            between(store)
        metrics = run_follow_up(
            store, raw, drafts, star.AS_OF, star.NOW, sends if kind == "sends" else None
        )
    return store, drafts, sends, metrics


@query(f"SELECT {q._METRIC_COLUMNS} FROM metrics")
def follow_up_run(spark, folder):
    return _run(spark, folder)[3].select(*q._METRIC_COLUMNS.split(", "))


@query(
    f"SELECT * REPLACE (CAST({TIME} AS VARCHAR) AS created_at, CAST(amount AS DOUBLE) AS amount) FROM audit"
)
def audit_after_rerun(spark, folder):
    return _run(spark, folder, ("sends", "sends"))[0].audit.read()


@query(
    """SELECT job_id, invoice_no, CASE outcome WHEN 'send_failed' THEN 'resolved' ELSE 'pending' END AS status,
      send_error AS error_message FROM outcomes WHERE send_status = 'failed'"""
)
def rerun_queue(spark, folder):
    """The second run sends everything: only drafts that are no valid record still wait."""
    store = _run(spark, folder, ("sends", "dry"))[0]
    return store.queue.read().select("job_id", "invoice_no", "status", "error_message")


@query(q.EMAIL_LOG_SQL)
def rerun_email_log(spark, folder):
    """The first run sends everything, the second one only what the results say."""
    store = _run(spark, folder, ("dry", "sends"))[0]
    return files.read_email_log(spark, store.email_log)


@query(
    f"""SELECT * REPLACE (CAST({TIME} AS VARCHAR) AS created_at, CAST(amount AS DOUBLE) AS amount) FROM audit
    UNION ALL SELECT * REPLACE (CAST({TIME} AS VARCHAR) AS created_at, CAST(amount AS DOUBLE) AS amount,
      CAST(retry_count + 100 AS INTEGER) AS retry_count) FROM audit"""
)
def rerun_keeps_retry_audit(spark, folder):
    """Rows that retries have added between two runs are still there after the second."""

    def retried(store):
        rows = write_and_read(store.audit.read(), "retried")
        store.audit.append(rows.withColumn("retry_count", F.col("retry_count") + 100))

    return _run(spark, folder, ("sends", "sends"), between=retried)[0].audit.read()


_PLACES = "SELECT *, o_orderkey % 19 = 4 AS faulty FROM outcomes"


@query(
    f"""SELECT job_id, count(*) AS total_records, count(*) FILTER (WHERE NOT faulty AND send_status <> 'pending') AS processed_count,
      count(*) FILTER (WHERE NOT faulty AND send_status = 'sent') AS sent_count,
      count(*) FILTER (WHERE NOT faulty AND send_status = 'failed') AS failed_count FROM ({_PLACES}) GROUP BY job_id"""
)
def metrics_with_quarantine(spark, folder):
    """Invoices in quarantine and waiting ones are loaded, but not processed."""
    metrics = _run(spark, folder, raw=star.invoices_faulty(spark, folder))[3]
    return metrics.select("job_id", "total_records", "processed_count", "sent_count", "failed_count")


@query(
    """SELECT job_id, count(*) AS invoices, count(DISTINCT invoice_no) AS numbers FROM (
      SELECT job_id, o_orderkey // 60 AS invoice_no FROM balanced_invoices) GROUP BY job_id"""
)
def duplicate_numbers_run(spark, folder):
    """A run over invoices that share numbers keeps each of them, and the same ones when run again."""
    raw = star.invoices_sharing_numbers(spark, folder)
    once, drafts, *_ = _run(spark, folder, raw=raw)
    twice = _run(spark, folder, ("sends", "sends"), raw=raw, drafts=drafts)[0]
    rows = once.outcomes(_outcome_schema(spark, folder)).read()
    different = once.audit.read().exceptAll(twice.audit.read()).limit(1)
    counts = rows.groupBy("job_id").agg(F.count("*").alias("invoices"), F.countDistinct("invoice_no").alias("numbers"))
    return counts.join(different.select(F.lit(True).alias("differs")), how="left").filter("differs IS NULL").drop("differs")


def _outcome_schema(spark, folder):
    none = (rows.filter(F.lit(False)) for rows in (star.staged(spark, folder), star.drafts(spark, folder), star.send_results(spark, folder)))
    return q.outcomes.decide_outcomes(*none).schema


@query(
    f"""SELECT job_id, invoice_no, CASE WHEN {retryable('send_error')} THEN 'retryable' ELSE 'permanent' END AS error_type,
      send_error AS error_message, max_retries, CAST(retry_count + CASE WHEN again THEN 1 ELSE 0 END AS INTEGER) AS retry_count,
      CASE WHEN again THEN 'pending' ELSE 'resolved' END AS status,
      CAST(CASE WHEN again THEN {TIME} + INTERVAL 2 HOUR + {backoff('retry_count + 1')}
        ELSE {TIME} + {backoff('retry_count')} END AS VARCHAR) AS next_retry_at,
      CAST({TIME} AS VARCHAR) AS created_at, CAST({TIME} + INTERVAL 2 HOUR AS VARCHAR) AS updated_at
    FROM (SELECT *, outcome = 'attempt_failed' OR retry_count < 2 AS again FROM outcomes WHERE send_status = 'failed')"""
)
def retry_cycle_run(spark, folder):
    """The whole queue after a cycle: invalid drafts and refused e-mails fail once more, and an entry that
    may look at one revision only, a faulty one, is escalated and so resolved."""
    store, drafts, sends, _ = _run(spark, folder)
    run_retry_cycle(store, drafts, star.NOW + dt.timedelta(hours=2), sends, limit=None)
    return store.queue.read().drop("invoice_state_json")


def _uploads(spark, folder):
    """One file per job; that of job 3 has bad dates, and that of job 5 is there twice."""
    path = fresh_dir(spark, "uploads")
    key = F.col("o_orderkey")
    late = (F.col("job_id") == 3) & (key % 7 == 0)
    rows = star.invoices_balanced(spark, folder).withColumns(
        {
            "due_date": F.when(late, F.lit("not a date")).otherwise(F.col("due_date").cast("string")),
            "part": F.explode(
                F.when(F.col("job_id") == 5, F.array(F.lit(5), F.lit(50))).otherwise(F.array(F.col("job_id").cast("int")))
            ),
        }
    )
    rows.drop("job_id").repartition("part").sortWithinPartitions("part", "o_orderkey").drop("o_orderkey").write.partitionBy(
        "part"
    ).option("header", True).csv(path)
    return f"{path}/*/*.csv"


def _part():
    return F.regexp_extract("file_path", r"part=(\d+)", 1).cast("int").alias("part")


@query(
    f"""SELECT CAST(job_id AS INTEGER) AS part, CASE WHEN job_id = 3 THEN 'failed' ELSE 'completed' END AS status,
      CASE WHEN job_id = 3 THEN count(*) FILTER (WHERE o_orderkey % 7 = 0) || ' invoices have an unreadable due date' END AS error_message,
      CASE WHEN job_id = 3 THEN 0 ELSE count(*) END AS total_records,
      CASE WHEN job_id = 3 THEN 0 ELSE count(*) END AS processed_count,
      CASE WHEN job_id = 3 THEN 0 ELSE count(*) FILTER (WHERE route = 'draft') END AS sent_count,
      CASE WHEN job_id = 3 THEN 0 ELSE count(*) FILTER (WHERE route = 'escalation') END AS escalated_count,
      CAST({TIME} AS VARCHAR) AS completed_at FROM staged GROUP BY job_id"""
)
def upload_run(spark, folder):
    """The ledger after the files of a folder have run, dry, as jobs."""
    store = Store(spark, fresh_dir(spark, "store"))
    upload.run_uploads(store, _uploads(spark, folder), star.AS_OF, star.NOW, on_bad_date="fail", date_mode="iso")
    return upload.ledger(store).select(
        _part(), "status", "error_message", "total_records", "processed_count", "sent_count", "escalated_count", "completed_at"
    )


@query(
    """SELECT CAST(part AS INTEGER) AS part, CASE part WHEN 3 THEN 'new' ELSE 'cached' END AS second,
      CASE part WHEN 50 THEN 'in_progress' ELSE 'new' END AS first
    FROM (SELECT DISTINCT job_id AS part FROM staged UNION ALL SELECT 50)"""
)
def upload_rerun(spark, folder):
    """What is decided on the same files when they are new, and when they come again."""
    store, path = Store(spark, fresh_dir(spark, "store")), _uploads(spark, folder)
    first, second = (
        upload.run_uploads(store, path, star.AS_OF, star.NOW, on_bad_date="fail", date_mode="iso") for _ in range(2)
    )
    return first.select(_part(), F.col("decision").alias("first")).join(
        second.select(_part(), F.col("decision").alias("second")), "part"
    )


def _streamed(spark, folder, raw):
    source, out = fresh_dir(spark, "stream-in"), fresh_dir(spark, "stream-out")
    raw = raw.drop("o_orderkey")
    raw.repartition(4, "invoice_number").write.option("header", True).csv(source)
    arriving = ingest.invoice_stream(spark, source, raw.columns, files_per_batch=2)
    ingest.stream_follow_up(
        arriving,
        write_and_read(star.drafts(spark, folder), "drafts"),
        out,
        fresh_dir(spark, "stream-state"),
        star.AS_OF,
        star.NOW,
        star.send_results(spark, folder),
        date_mode="iso",
    ).awaitTermination()
    return out


@query(
    f"SELECT * REPLACE (CAST({TIME} AS VARCHAR) AS created_at, CAST(amount AS DOUBLE) AS amount) FROM audit"
)
def streamed_follow_up(spark, folder):
    out = _streamed(spark, folder, star.invoices_balanced(spark, folder))
    return ingest.read_sink(spark, out, "audit")


@query(
    f"""SELECT job_id, invoice_no, CASE WHEN faulty THEN 'quarantined' ELSE outcome END AS place,
      NOT faulty AND send_status = 'failed' AS queued, NOT faulty AND outcome = 'sent' AS logged FROM ({_PLACES})"""
)
def streamed_places(spark, folder):
    """Where every invoice of a stream ends up, over all sinks."""
    out = _streamed(spark, folder, star.invoices_faulty(spark, folder))
    key = ["job_id", "invoice_no"]

    def keys(sink, name):
        return ingest.read_sink(spark, out, sink).select(*key).withColumn(name, F.lit(True))

    places = ingest.read_sink(spark, out, "outcomes").select(*key, F.col("outcome").alias("place")).unionByName(
        keys("quarantine", "place").withColumn("place", F.lit("quarantined"))
    )
    marked = places.join(keys("queue", "queued"), key, "left").join(keys("email_log", "logged"), key, "left")
    return marked.na.fill(False, ["queued", "logged"])


@query(
    f"""SELECT job_id, invoice_no, send_status, retry_count, error_message FROM ({q._ARRIVALS})
    QUALIFY row_number() OVER (PARTITION BY job_id, invoice_no, send_status, retry_count
      ORDER BY event_id % 5, error_message) = 1"""
)
def streamed_first_wins(spark, folder):
    """Five files arrive one after the other; the row that wins is of the first file with its key."""
    source, out = fresh_dir(spark, "audit-in"), fresh_dir(spark, "audit-out")
    rows = q._audit_arrivals(spark, folder)
    part = F.col("event_id") % 5
    filled = rows.select(
        *[
            F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in AUDIT.fields
        ],
        part.alias("part"),
    )
    waves = [filled.filter(F.col("part") == k).drop("part") for k in range(5)]
    checkpoint = fresh_dir(spark, "audit-state")
    _in_waves(spark, source, waves, lambda rows: ingest.stream_first_wins(rows, out, checkpoint, ["error_message"]))
    return read_batches(spark, out, AUDIT).select(*audit.AUDIT_KEY, "error_message")


def _in_waves(spark, source, waves, start):
    """Write the waves one after the other, and have a stream read each before the next one comes."""
    for wave in waves:
        wave.write.mode("append").parquet(source)
        with retry_state.replay_settings(spark):
            start(spark.readStream.schema(wave.schema).parquet(source)).awaitTermination()


@query(
    f"""SELECT CAST(o_custkey % {star.JOBS} AS BIGINT) AS job_id, 'INV-' || o_orderkey AS invoice_no, CAST({TIME} + INTERVAL (day) DAY AS VARCHAR) AS created_at
    FROM orders, (VALUES (0), (10)) AS t(day)"""
)
def streamed_within_watermark(spark, folder):
    """Copies an hour later are dropped; copies ten days later, when the key has been forgotten, come through once."""
    source, out, checkpoint = fresh_dir(spark, "late-in"), fresh_dir(spark, "late-out"), fresh_dir(spark, "late-state")
    key = {"job_id": (F.col("o_custkey") % star.JOBS).cast("long"), "invoice_no": F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string"))}
    rows = star.table(spark, folder, "orders").select(
        *(c.alias(n) for n, c in key.items()), F.lit("failed").alias("send_status"), F.lit(0).alias("retry_count")
    )
    clock = spark.range(1).select(F.lit(-1).cast("long").alias("job_id"), F.lit("clock").alias("invoice_no"), F.lit("failed").alias("send_status"), F.lit(0).alias("retry_count"))

    def at(rows, days, hours=0):
        return rows.withColumn("created_at", star.now() + F.make_dt_interval(F.lit(days), F.lit(hours)))

    waves = [at(rows, 0).union(at(rows, 0)), at(rows, 0, 1), at(clock, 10), at(rows, 10)]
    for wave in waves:
        wave.write.mode("append").parquet(source)
        arriving = ingest.within_watermark(spark.readStream.schema(wave.schema).parquet(source), "1 day")
        arriving.writeStream.option("checkpointLocation", checkpoint).option("path", out).format("parquet").trigger(
            availableNow=True
        ).start().awaitTermination()
    return spark.read.parquet(out).filter("invoice_no <> 'clock'").select("job_id", "invoice_no", "created_at")


def _settled(spark, folder):
    """Invoices arrive first, then their drafts, then the send results: (sinks, checkpoint) after all three."""
    names = ("late-invoices", "late-drafts", "late-results", "settled", "settled-state")
    arrivals, drafts, results, out, checkpoint = (fresh_dir(spark, n) for n in names)
    raw = star.invoices_faulty(spark, folder).drop("o_orderkey")
    empty = {drafts: DRAFTS, results: SEND_RESULTS}
    for path, schema in empty.items():
        spark.createDataFrame([], schema).write.parquet(path)

    def typed(rows, schema):
        return rows.select(*(F.col(f.name).cast(f.dataType) for f in schema))

    phases = (
        lambda: raw.write.option("header", True).csv(arrivals),
        lambda: typed(star.drafts(spark, folder), DRAFTS).write.mode("append").parquet(drafts),
        lambda: typed(star.send_results(spark, folder), SEND_RESULTS).write.mode("append").parquet(results),
    )
    for phase in phases:
        phase()
        with retry_state.replay_settings(spark):
            settlements.stream_settlements(
                ingest.invoice_stream(spark, arrivals, raw.columns),
                spark.readStream.schema(DRAFTS).parquet(drafts),
                spark.readStream.schema(SEND_RESULTS).parquet(results),
                out, checkpoint, star.AS_OF, star.NOW, date_mode="iso",
            ).awaitTermination()
    return out, checkpoint


@query(
    f"""SELECT job_id, invoice_no, CASE WHEN faulty THEN 'quarantined' WHEN send_status = 'pending' THEN 'waiting' ELSE outcome END AS place,
      CASE WHEN NOT faulty AND send_status <> 'pending' THEN send_error END AS send_error,
      CASE WHEN NOT faulty AND send_status <> 'pending' THEN retry_count END AS retry_count,
      CASE WHEN NOT faulty AND send_status <> 'pending' THEN d_subject END AS subject FROM ({_PLACES})"""
)
def streamed_late_drafts(spark, folder):
    """Where every invoice is after its drafts and results have come later than itself; those that wait, out of the state."""
    out, checkpoint = _settled(spark, folder)
    found = settlements.read_settled(spark, out, "outcomes")
    none = {"send_error": F.lit(None).cast("string"), "retry_count": F.lit(None).cast("int"), "subject": F.lit(None).cast("string")}

    def elsewhere(rows, place):
        return rows.select("job_id", "invoice_no", F.lit(place).alias("place"), *(c.alias(n) for n, c in none.items()))

    with retry_state.replay_settings(spark):
        waiting = write_and_read(elsewhere(settlements.waiting_invoices(spark, checkpoint), "waiting"), "waiting")
    settled = found.select("job_id", "invoice_no", F.col("outcome").alias("place"), "send_error", "retry_count", F.col("draft.subject").alias("subject"))
    return settled.unionByName(elsewhere(settlements.read_settled(spark, out, "quarantine"), "quarantined")).unionByName(waiting)


def _two_runs(spark, folder, name, stream):
    """The outcomes of a run as a first wave, those of a run an hour later that sends everything as a second one."""
    source, out, checkpoint = (fresh_dir(spark, f"{name}-{part}") for part in ("in", "out", "state"))
    drafts = write_and_read(star.drafts(spark, folder), "drafts")
    staged = star.staged(spark, folder)
    for k, sends in enumerate((star.send_results(spark, folder), None)):
        wave = q.outcomes.decide_outcomes(staged, drafts, sends)
        moment = star.now() + F.make_dt_interval(F.lit(0), F.lit(k))
        _in_waves(spark, source, [wave], lambda rows, at=moment: stream(rows, out, checkpoint, at))
    return out


@query(
    f"""SELECT job_id, invoice_no, error_type, error_message, retry_count, max_retries, CASE status WHEN 'resolved' THEN first ELSE second END AS next_retry_at,
      status, CAST({TIME} AS VARCHAR) AS created_at, CAST({TIME} + INTERVAL 1 HOUR AS VARCHAR) AS updated_at
    FROM (SELECT * , CAST(next_retry_at AS VARCHAR) AS first, CAST(next_retry_at + INTERVAL 1 HOUR AS VARCHAR) AS second
      FROM (SELECT n.* REPLACE (CASE o.outcome WHEN 'send_failed' THEN 'resolved' ELSE 'pending' END AS status)
        FROM ({q._NEW_FAILED}) n JOIN outcomes o ON o.job_id = n.job_id AND o.invoice_no = n.invoice_no))"""
)
def streamed_queue(spark, folder):
    """An invoice that fails in two waves has one entry, one that fails and is sent later is resolved."""
    out = _two_runs(spark, folder, "queue", conflicts.stream_queue)
    return conflicts.read_queue(spark, out).drop("invoice_state_json")


@query(
    f"""SELECT * REPLACE (CAST({TIME} AS VARCHAR) AS created_at, CAST(amount AS DOUBLE) AS amount) FROM audit
    UNION ALL SELECT * REPLACE (CAST({TIME} + INTERVAL 1 HOUR AS VARCHAR) AS created_at, CAST(amount AS DOUBLE) AS amount,
      'sent' AS send_status, '' AS error_message) FROM audit WHERE send_status = 'failed'"""
)
def streamed_audit(spark, folder):
    """Audit rows of two waves of outcomes: of the second only those with a key that is new."""
    return conflicts.read_audit(spark, _two_runs(spark, folder, "audit", conflicts.stream_audit))


@query(f"SELECT {q._METRIC_COLUMNS} FROM metrics")
def streamed_metrics(spark, folder):
    source, out = fresh_dir(spark, "outcomes-in"), fresh_dir(spark, "metrics-out")
    rows = q._outcomes(spark, folder).select(
        "job_id", "invoice_no", "send_status", "escalation_required", "retry_count"
    )
    part = F.pmod(F.xxhash64("invoice_no"), F.lit(2))
    checkpoint = fresh_dir(spark, "metrics-state")
    waves = [rows.filter(part == k) for k in range(2)]
    _in_waves(spark, source, waves, lambda arriving: live_metrics.stream_metrics(arriving, out, checkpoint))
    return live_metrics.metrics_table(spark, out, rows).read().select(*q._METRIC_COLUMNS.split(", "))


@query(
    f"""SELECT job_id, invoice_no, retry_count, epoch_ms({TIME} + {backoff('retry_count')}) AS next_retry_ms FROM queue"""
)
def streamed_due(spark, folder):
    """Entries whose time has come are reported when the next batch arrives."""
    source, out = fresh_dir(spark, "events-in"), fresh_dir(spark, "changes-out")
    none = F.lit(None)
    entered = star.failed_queue(spark, folder).select(
        "job_id", "invoice_no", F.lit(0).cast("long").alias("seq"), F.lit("failure").alias("kind"),
        star.now().alias("at"), none.cast("string").alias("send_status"), "error_message",
        "retry_count", "max_retries",
    )
    later = spark.createDataFrame([(-1, "none", 0, "result", star.NOW, "sent", None, None, None)], retry_state.EVENTS)
    state = fresh_dir(spark, "retry-state")
    _in_waves(spark, source, [entered, later], lambda rows: retry_state.stream_retry_state(rows, out, state))
    changes = spark.read.schema(retry_state.CHANGES).parquet(out)
    return changes.filter(F.col("change") == "due").select("job_id", "invoice_no", "retry_count", "next_retry_ms")


@query(
    f"""SELECT job_id, invoice_no, CAST(n AS INTEGER) AS retry_count, max_retries,
      CASE WHEN hit AND failed THEN send_error ELSE error_message END AS error_message,
      CASE WHEN hit AND NOT failed THEN 'resolved' WHEN hit AND n >= max_retries THEN 'permanent_failure' ELSE 'pending' END AS status,
      CASE WHEN hit AND failed AND n >= max_retries THEN NULL
        WHEN hit AND failed THEN epoch_ms({TIME} + INTERVAL 1 HOUR + {backoff('n')})
        ELSE epoch_ms({TIME} + {backoff('retry_count')}) END AS next_retry_ms
    FROM (SELECT q.*, o.o_orderstatus <> 'O' AS hit, o.o_orderstatus = 'F' AS failed, s.send_message AS send_error,
        q.retry_count + CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS n
      FROM queue q JOIN orders o ON o.o_orderkey = q.o_orderkey
      JOIN send_results s ON s.invoice_no = q.invoice_no)"""
)
def streamed_retry_state(spark, folder):
    """Failures and results of the queue replayed as events through the state machine."""
    changes = spark.read.schema(retry_state.CHANGES).parquet(_replayed(spark, folder)[0])
    return retry_state.current_state(changes)


def _replayed(spark, folder):
    """(changes, checkpoint) after the queue's failures and then their results have gone through the state machine."""
    source, out, state = (fresh_dir(spark, n) for n in ("events-in", "changes-out", "retry-state"))
    none = F.lit(None)
    entered = star.failed_queue(spark, folder).select(
        "job_id", "invoice_no", F.lit(0).cast("long").alias("seq"), F.lit("failure").alias("kind"),
        star.now().alias("at"), none.cast("string").alias("send_status"), "error_message",
        "retry_count", "max_retries",
    )
    ended = q._retry_results(spark, folder).select(
        "job_id", "invoice_no", F.lit(1).cast("long").alias("seq"), F.lit("result").alias("kind"),
        (star.now() + F.make_dt_interval(F.lit(0), F.lit(1))).alias("at"), "send_status",
        F.col("send_error").alias("error_message"), none.cast("int").alias("retry_count"),
        none.cast("int").alias("max_retries"),
    )
    _in_waves(spark, source, [entered, ended], lambda rows: retry_state.stream_retry_state(rows, out, state))
    return out, state


@query(
    """SELECT job_id, invoice_no, CAST(n AS INTEGER) AS retry_count FROM (SELECT q.*, o.o_orderstatus <> 'O' AS hit, o.o_orderstatus = 'F' AS failed,
        q.retry_count + CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS n FROM queue q JOIN orders o ON o.o_orderkey = q.o_orderkey)
    WHERE NOT hit OR (failed AND n < max_retries)"""
)
def streamed_pending_state(spark, folder):
    """What the state store holds after the replay: the entries that are still pending, and none besides."""
    state = _replayed(spark, folder)[1]
    with retry_state.replay_settings(spark):
        return write_and_read(retry_state.stored_entries(spark, state), "stored").select("job_id", "invoice_no", "retry_count")
