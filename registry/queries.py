"""Every operator as a query over the given tables, with its comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duebook import fixed_values as fv
from duebook.functions import dates, errors, money, text
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
    quality,
    retries,
    stages,
    validation,
    views,
)
from duebook.schemas import DRAFT_FIELDS
from duebook.sources import star
from registry import sql
from registry.sql import DAY, TIME, oracle, percent, stripped, two_digits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Times and dates as text and money as double, so that both sides compare by value."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            c = c.cast("string")
        elif kind.startswith("decimal"):
            c = c.cast("double")
        elif kind == "array":
            c = F.array_join(c, ", ")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(sql_text: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = lambda spark, folder: tidy(fn(spark, folder))
        if sql_text is not None:
            ORACLES[fn.__name__] = oracle(sql_text)
        return fn

    return register


def texts(*columns: str) -> str:
    """Casts for SELECT * REPLACE."""
    return "(" + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns) + ")"


# --- normalizing and staging ------------------------------------------------------------------

@query(
    "SELECT stage_key, count(*) AS invoices, CAST(sum(amount) AS DOUBLE) AS total_amount "
    "FROM staged_natural GROUP BY stage_key"
)
def receivables_by_stage(spark, folder):
    return stages.stage_summary(star.staged(spark, folder, balanced=False))


@query(
    "SELECT job_id, invoice_no, client, CAST(amount AS DOUBLE) AS amount, amount_raw, "
    "CAST(due_date AS VARCHAR) AS due_date_text, CAST(due_date AS VARCHAR) AS due_date, contact_email, "
    "1 AS followup_count, 0 AS retry_count, 3 AS max_retries FROM natural_invoices"
)
def normalized_invoices(spark, folder):
    return normalize.normalize_invoices(star.invoices(spark, folder)).drop("o_orderkey")


def _parsed(spark, folder, mode):
    rows = star.invoices_text(spark, folder)
    return rows.select(
        "invoice_number", "due_date", dates.parse_due_date(F.col("due_date"), mode).alias("parsed")
    )


def _parsed_sql(day_first):
    return (
        "SELECT invoice_no AS invoice_number, due_text AS due_date, "
        f"CAST({sql.parsed_date('due_text', day_first)} AS VARCHAR) AS parsed FROM text_invoices"
    )


@query(_parsed_sql(True))
def due_dates_day_first(spark, folder):
    return _parsed(spark, folder, "dayfirst")


@query(_parsed_sql(False))
def due_dates_iso(spark, folder):
    return _parsed(spark, folder, "iso")


@query(
    "SELECT job_id, invoice_no, faults FROM faulted WHERE faults <> ''"
)
def quarantined_invoices(spark, folder):
    rows = normalize.normalize_invoices(star.invoices_text(spark, folder))
    return normalize.split_faulty(rows)[1].select("job_id", "invoice_no", "faults")


@query(
    "SELECT job_id, invoice_no, CAST(CAST(amount_text AS DECIMAL(18,2)) AS DOUBLE) AS amount, "
    "CAST(due_date AS VARCHAR) AS due_date FROM faulted WHERE faults = ''"
)
def accepted_invoices(spark, folder):
    rows = normalize.normalize_invoices(star.invoices_text(spark, folder))
    return normalize.split_faulty(rows)[0].select("job_id", "invoice_no", "amount", "due_date")


@query("SELECT job_id, invoice_no, days_overdue, stage_key FROM staged")
def overdue_stages(spark, folder):
    return star.staged(spark, folder).select("job_id", "invoice_no", "days_overdue", "stage_key")


@query(
    "SELECT invoice_no, stage_key, followup_number, tone, key_message, cta, escalation_required, "
    "subject_template FROM staged"
)
def stage_wording(spark, folder):
    return star.staged(spark, folder).select(
        "invoice_no", "stage_key", "followup_number", "tone", "key_message", "cta",
        "escalation_required", "subject_template",
    )


@query(
    "SELECT job_id, stage_key, count(*) AS invoices, CAST(sum(amount) AS DOUBLE) AS total_amount "
    "FROM staged GROUP BY ALL"
)
def job_stage_summary(spark, folder):
    return stages.stage_summary(star.staged(spark, folder), "job_id")


# --- scalar expressions -----------------------------------------------------------------------

@query(
    "SELECT invoice_no, CASE o_orderkey % 3 WHEN 0 THEN 'https://pay.example/' || o_orderkey "
    "ELSE 'https://pay.company.com/' || invoice_no END AS payment_link FROM natural_invoices"
)
def payment_links(spark, folder):
    key = F.col("o_orderkey")
    given = F.when(key % 3 == 0, F.concat(F.lit("https://pay.example/"), key.cast("string"))).when(
        key % 3 == 1, F.lit("")
    )
    return star.invoices(spark, folder).select(
        F.col("invoice_number").alias("invoice_no"),
        text.payment_link(F.col("invoice_number"), given).alias("payment_link"),
    )


@query("SELECT invoice_no, stage_key, expected_subject AS subject FROM staged")
def subject_lines(spark, folder):
    return drafts.with_subject(star.staged(spark, folder)).select(
        "invoice_no", "stage_key", F.col("expected_subject").alias("subject")
    )


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'USD ' || price WHEN 1 THEN '€' || price
      WHEN 2 THEN 'INR ' || format('{:,.2f}', CAST(price AS DOUBLE)) ELSE 'INR ' || format('{:,.2f}', CAST(price AS DOUBLE)) END AS amount_text
    FROM (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price FROM orders)"""
)
def currency_texts(spark, folder):
    key = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    given = (
        F.when(key % 4 == 0, F.concat(F.lit(" USD "), price, F.lit("\t")))
        .when(key % 4 == 1, F.concat(F.lit("€"), price))
        .when(key % 4 == 2, F.concat(F.lit(" "), price, F.lit(" ")))
        .otherwise(price)
    )
    return star.table(spark, folder, "orders").select(
        "o_orderkey", money.currency_text(given).alias("amount_text")
    )


@query(
    f"SELECT c_custkey, {sql.masked('email')} AS masked FROM (SELECT c_custkey, "
    "CASE c_custkey % 6 WHEN 5 THEN NULL WHEN 4 THEN lower(c_name) ELSE "
    "left(lower(c_name), CAST(CASE c_custkey % 6 WHEN 3 THEN c_custkey % 14 ELSE c_custkey % 6 END AS INTEGER)) "
    "|| '@mail@example.com' END AS email FROM customer)"
)
def masked_emails(spark, folder):
    kind = F.col("c_custkey") % 6
    size = F.when(kind == 3, F.col("c_custkey") % 14).otherwise(kind).cast("int")
    name = F.lower("c_name")
    email = (
        F.when(kind == 5, F.lit(None).cast("string"))
        .when(kind == 4, name)
        .otherwise(F.concat(F.left(name, size), F.lit("@mail@example.com")))
    )
    return star.table(spark, folder, "customer").select("c_custkey", text.mask_email(email).alias("masked"))


@query(
    f"""SELECT conv_id, turn, concat_ws(chr(10) || chr(10),
      nullif({stripped("CASE WHEN turn % 3 = 0 THEN ' ' || role || ',' END")}, ''),
      nullif({stripped("text || chr(10) || chr(8195)")}, ''),
      nullif({stripped("CASE WHEN turn % 2 = 0 THEN ' ' ELSE 'Regards' END")}, '')) AS body
    FROM conversations"""
)
def message_bodies(spark, folder):
    turn = F.col("turn")
    return star.table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        text.assemble_body(
            F.when(turn % 3 == 0, F.concat(F.lit(" "), F.col("role"), F.lit(","))),
            F.concat(F.col("text"), F.lit("\n ")),
            F.when(turn % 2 == 0, F.lit(" ")).otherwise(F.lit("Regards")),
        ).alias("body"),
    )


@query(f"SELECT job_id, invoice_no, {sql.INPUT_SQL} FROM staged")
def draft_inputs(spark, folder):
    return drafts.draft_inputs(star.staged(spark, folder)).withColumn(
        "days_overdue", F.col("days_overdue").cast("string")
    )


@query(sql.PROMPT_SQL)
def prompt_texts(spark, folder):
    return drafts.render_prompts(
        drafts.draft_inputs(star.staged(spark, folder)), tuple(drafts.PROMPTS)
    )


@query(
    "SELECT job_id, invoice_no, 0 AS revision, recipient, subject, greeting, body, closing, tone FROM ready"
)
def ready_made_drafts(spark, folder):
    return drafts.template_drafts(star.staged(spark, folder))


_EVENT_TEXT = f"{sql._errors}[event_id % 10 + 1]"


def _event_text():
    return F.element_at(
        F.array(*[F.lit(t) for t in star.ERROR_TEXTS]), (F.col("event_id") % 10 + 1).cast("int")
    )


@query(
    f"SELECT event_id, CASE WHEN {sql.retryable('message')} THEN 'retryable' ELSE 'permanent' END AS error_type "
    f"FROM (SELECT event_id, CASE WHEN event_type <> 'view' THEN {_EVENT_TEXT} END AS message FROM events)"
)
def error_classes(spark, folder):
    message = F.when(F.col("event_type") != "view", _event_text())
    return star.table(spark, folder, "events").select(
        "event_id", errors.error_class(message).alias("error_type")
    )


@query(
    f"SELECT doc_id, CASE WHEN {sql.retryable('text')} THEN 'retryable' ELSE 'permanent' END AS error_type FROM documents"
)
def long_text_error_classes(spark, folder):
    return star.table(spark, folder, "documents").select(
        "doc_id", errors.error_class(F.col("text")).alias("error_type")
    )


@query(
    f"SELECT o_orderkey, CAST({TIME} + {sql.backoff('o_orderkey % 40')} AS VARCHAR) AS next_retry_at FROM orders"
)
def retry_schedule(spark, folder):
    count = (F.col("o_orderkey") % 40).cast("int")
    return star.table(spark, folder, "orders").select(
        "o_orderkey", errors.next_retry_at(star.now(), count).alias("next_retry_at")
    )


@query(
    "SELECT job_id, invoice_no, attempt, CAST(2 * pow(2, least(attempt, 61)) AS BIGINT) AS wait_seconds, "
    "CAST(2 * (pow(2, least(attempt, 61)) - 1) AS BIGINT) AS waited_before FROM attempts"
)
def attempt_waits(spark, folder):
    return star.attempts(spark, folder).select(
        "job_id",
        "invoice_no",
        "attempt",
        errors.wait_before_retry(F.col("attempt")).alias("wait_seconds"),
        errors.waited_until(F.col("attempt")).alias("waited_before"),
    )


@query(
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seconds, strftime(ts, '%Y-%m-%d %H:%M') AS minutes FROM events"
)
def short_times(spark, folder):
    return star.table(spark, folder, "events").select(
        "event_id",
        text.short_time(F.col("ts")).alias("seconds"),
        text.short_time(F.col("ts"), 16).alias("minutes"),
    )


@query(
    """SELECT event_id, coalesce(CAST(trunc(try_cast(CASE WHEN event_type = 'view' THEN 'n/a' WHEN event_type = 'error' THEN NULL
      ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS DOUBLE)) AS BIGINT), 0) AS counter FROM events"""
)
def counters_read(spark, folder):
    kind = F.col("event_type")
    given = F.when(kind == "view", F.lit("n/a")).when(
        kind != "error", F.col("value").cast("decimal(18,2)").cast("string")
    )
    return star.table(spark, folder, "events").select(
        "event_id", money.count_or_zero(given).alias("counter")
    )


@query(
    f"SELECT o_orderkey, {two_digits('o_totalprice / 7')} AS two, {two_digits('o_orderkey / 8.0', 1)} AS one FROM orders"
)
def rounded_numbers(spark, folder):
    return star.table(spark, folder, "orders").select(
        "o_orderkey",
        money.rounded(F.col("o_totalprice") / 7, 2).alias("two"),
        money.rounded(F.col("o_orderkey") / F.lit(8.0), 1).alias("one"),
    )


@query(
    "SELECT invoice_no, CASE WHEN days_overdue > 30 THEN days_overdue || ' days overdue — flagged for legal/finance review' "
    "ELSE 'Email validation failed after ' || (o_orderkey % 4) || ' retries — manual review required' END AS reason FROM staged"
)
def escalation_reasons(spark, folder):
    return star.staged(spark, folder).select(
        "invoice_no",
        outcomes.escalation_reason(F.col("days_overdue"), F.col("o_orderkey") % 4).alias("reason"),
    )


@query(
    "SELECT id, '#' || id || ' · ' || upper(status) || ' · ' || strftime(created_at, '%Y-%m-%d %H:%M') AS label FROM jobs"
)
def job_labels(spark, folder):
    jobs = ledger.fold_jobs(star.job_events(spark, folder))
    return jobs.select("id", text.job_label(F.col("id"), F.col("status"), F.col("created_at")).alias("label"))


@query(
    """SELECT q.job_id, q.invoice_no, q.payload <> 'whole' AS payload_error, CASE WHEN payload = 'whole' THEN s.client END AS client,
      CASE WHEN payload = 'whole' THEN CAST(s.amount AS DOUBLE) END AS amount,
      CASE WHEN payload = 'whole' THEN s.stage_key END AS stage_key,
      CASE WHEN payload = 'whole' THEN s.cta END AS cta,
      CASE payload WHEN 'whole' THEN 0 WHEN 'headless' THEN 1 END AS stored_retries
    FROM queue q JOIN staged s ON s.job_id = q.job_id AND s.invoice_no = q.invoice_no"""
)
def queue_payloads(spark, folder):
    return failures.read_states(star.failed_queue(spark, folder)).select(
        "job_id",
        "invoice_no",
        "payload_error",
        F.col("state.invoice.client").alias("client"),
        F.col("state.invoice.amount").alias("amount"),
        F.col("state.stage_key").alias("stage_key"),
        F.col("state.stage_meta.cta").alias("cta"),
        F.col("state.retry_count").alias("stored_retries"),
    )


# --- drafts, attempts, outcomes ---------------------------------------------------------------

def _mailed(spark, folder):
    rows = drafts.with_subject(star.staged(spark, folder))
    return rows.withColumn("route", outcomes.initial_route()).filter(F.col("route") == "draft")


@query("SELECT job_id, invoice_no, revision, status, rule, feedback FROM rulings")
def draft_rulings(spark, folder):
    return validation.judge_drafts(_mailed(spark, folder), star.drafts(spark, folder))


@query(f"SELECT job_id, invoice_no, revision, status, rule, feedback FROM ({sql.rulings(strict=True)})")
def draft_rulings_strict(spark, folder):
    return validation.judge_drafts(_mailed(spark, folder), star.drafts(spark, folder), strict=True)


@query(
    """SELECT doc_id, CASE WHEN NOT contains(t, lang) THEN lang WHEN NOT contains(t, source) THEN source
      WHEN NOT contains(t, CAST(n_chars % 10 AS VARCHAR)) THEN CAST(n_chars % 10 AS VARCHAR)
      WHEN NOT contains(t, 'the') THEN 'the' END AS missing
    FROM (SELECT *, 'Hi ' || text || ' Bye' AS t FROM documents)"""
)
def long_text_values(spark, folder):
    draft = F.struct(
        F.lit("Hi").alias("greeting"), F.col("text").alias("body"), F.lit("Bye").alias("closing")
    )
    rows = star.table(spark, folder, "documents").select(
        "doc_id",
        F.col("lang").alias("client"),
        F.col("source").alias("invoice_no"),
        (F.col("n_chars") % 10).alias("days_overdue"),
        F.lit("the").alias("payment_link"),
        draft.alias("draft"),
    )
    values = F.array(*[F.col(c).cast("string") for c in validation.CHECKED_VALUES])
    return rows.select("doc_id", validation.first_missing_value(validation.draft_text(F.col("draft")), values).alias("missing"))


@query("SELECT job_id, invoice_no, route FROM staged")
def initial_routes(spark, folder):
    return star.staged(spark, folder).select(
        "job_id", "invoice_no", outcomes.initial_route().alias("route")
    )


@query(
    "SELECT job_id, invoice_no, revision, CASE WHEN status = 'approved' THEN 'send' WHEN revision + 1 >= 3 THEN 'escalate' "
    "ELSE 'regenerate' END AS next_step FROM rulings"
)
def next_steps(spark, folder):
    ruled = validation.judge_drafts(_mailed(spark, folder), star.drafts(spark, folder))
    return ruled.select(
        "job_id",
        "invoice_no",
        "revision",
        validation.next_step(F.col("status"), F.col("revision") + 1, F.lit(fv.MAX_REVISIONS)).alias(
            "next_step"
        ),
    )


@query(
    "SELECT f.job_id, f.invoice_no, draft_state, rejections, draft_feedback, draft_rule, d.recipient, d.subject, "
    "d.greeting, d.body, d.closing, d.tone FROM revision_fold f LEFT JOIN drafts d ON d.job_id = f.job_id "
    "AND d.invoice_no = f.invoice_no AND d.revision = f.last_revision"
)
def revision_fold(spark, folder):
    return validation.fold_revisions(_mailed(spark, folder), star.drafts(spark, folder)).select(
        "job_id", "invoice_no", "draft_state", "rejections", "draft_feedback", "draft_rule", "draft.*"
    )


@query("SELECT * FROM attempt_fold")
def attempt_fold(spark, folder):
    return attempts.fold_attempts(star.attempts(spark, folder))


@query(
    f"""SELECT c.job_id, c.invoice_no, coalesce(attempt_state, 'failed') AS attempt_state,
      CASE WHEN attempt_state IS NULL THEN 'Unknown processing error.' ELSE attempt_error END AS attempt_error,
      coalesce(attempts_used, 0) AS attempts_used, coalesce(waited_seconds, 0) AS waited_seconds
    FROM (SELECT c_custkey % {star.JOBS} AS job_id, 'INV-' || c_custkey AS invoice_no FROM customer) c
    LEFT JOIN attempt_fold f ON f.job_id = c.job_id AND f.invoice_no = c.invoice_no"""
)
def attempts_resolved(spark, folder):
    people = star.table(spark, folder, "customer").select(
        (F.col("c_custkey") % star.JOBS).alias("job_id"),
        F.concat(F.lit("INV-"), F.col("c_custkey").cast("string")).alias("invoice_no"),
    )
    return attempts.resolve_attempts(people, star.attempts(spark, folder))


def _outcomes(spark, folder):
    return outcomes.decide_outcomes(
        star.staged(spark, folder), star.drafts(spark, folder), star.send_results(spark, folder)
    )


@query(
    "SELECT job_id, invoice_no, stage_key, escalation_required, payment_link, validation_status, validation_feedback, "
    "send_status, send_error, retry_count, max_retries, route, outcome FROM outcomes"
)
def invoice_outcomes(spark, folder):
    return _outcomes(spark, folder).select(
        "job_id", "invoice_no", "stage_key", "escalation_required", "payment_link",
        "validation_status", "validation_feedback", "send_status", "send_error", "retry_count",
        "max_retries", "route", "outcome",
    )


@query(
    "SELECT o.job_id, o.invoice_no, CASE WHEN o.route = 'draft' AND a.attempt_state = 'failed' THEN 'attempt_failed' "
    "WHEN o.route = 'draft' AND a.attempt_state = 'in_flight' THEN 'in_flight' "
    "WHEN o.route = 'draft' AND a.attempt_state IS NULL THEN 'attempt_failed' ELSE o.outcome END AS outcome, "
    "CASE WHEN o.route = 'draft' AND a.attempt_state = 'failed' THEN a.attempt_error "
    "WHEN o.route = 'draft' AND a.attempt_state = 'in_flight' THEN '' "
    "WHEN o.route = 'draft' AND a.attempt_state IS NULL THEN 'Unknown processing error.' ELSE o.send_error END AS send_error "
    "FROM outcomes o LEFT JOIN attempt_fold a ON a.job_id = o.job_id AND a.invoice_no = o.invoice_no"
)
def outcomes_with_attempts(spark, folder):
    return outcomes.decide_outcomes(
        star.staged(spark, folder),
        star.drafts(spark, folder),
        star.send_results(spark, folder),
        star.attempts(spark, folder),
    ).select("job_id", "invoice_no", "outcome", "send_error")


@query(
    f"""SELECT job_id, invoice_no, gone IS NULL AND success AS sent,
      CASE WHEN gone THEN {sql.text(sql.NOTHING_TO_SEND)} WHEN NOT success THEN {sql.SEND_ERROR} END AS send_error
    FROM (SELECT s.job_id, s.invoice_no, x.success, x.send_message, CASE WHEN s.o_orderkey % 5 = 0 THEN true END AS gone
      FROM staged s JOIN send_results x ON x.job_id = s.job_id AND x.invoice_no = s.invoice_no WHERE s.route = 'draft')"""
)
def send_outcomes(spark, folder):
    """How sending an approved e-mail went; every fifth draft has been taken away since it was approved."""
    kept = star.drafts(spark, folder).filter((F.col("revision") == 0) & (_sequence().cast("long") % 5 != 0))
    drafts_left = kept.select("job_id", "invoice_no", F.struct(*DRAFT_FIELDS).alias("draft"))
    approved = star.staged(spark, folder).filter(outcomes.initial_route() == "draft").select("job_id", "invoice_no")
    sends = star.send_results(spark, folder).select(
        "job_id", "invoice_no", F.struct("success", "provider", "message").alias("send")
    )
    rows = approved.join(drafts_left, ["job_id", "invoice_no"], "left").join(sends, ["job_id", "invoice_no"])
    went, error = outcomes.send_result(F.col("draft"), F.col("send"))
    return rows.select("job_id", "invoice_no", went.alias("sent"), error.alias("send_error"))


def _sequence():
    return F.substring("invoice_no", 5, 20).cast("double")


def _audit(spark, folder):
    stamp = star.now() + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), _sequence())
    return outcomes.audit_rows(_outcomes(spark, folder), stamp)


_AUDIT_SQL = "SELECT * REPLACE (CAST(created_at AS VARCHAR) AS created_at, CAST(amount AS DOUBLE) AS amount) FROM audit"


@query(_AUDIT_SQL)
def audit_records(spark, folder):
    return _audit(spark, folder)


def _queue_rows(spark, folder):
    return outcomes.queue_rows(_outcomes(spark, folder), star.now())


_NEW_FAILED = (
    f"SELECT job_id, invoice_no, CASE WHEN {sql.retryable('send_error')} THEN 'retryable' ELSE 'permanent' END AS error_type, "
    f"send_error AS error_message, retry_count, max_retries, {TIME} + {sql.backoff('retry_count')} AS next_retry_at, "
    f"'pending' AS status, {TIME} AS created_at, {TIME} AS updated_at FROM outcomes WHERE send_status = 'failed'"
)


@query(f"SELECT * REPLACE {texts('next_retry_at', 'created_at', 'updated_at')} FROM ({_NEW_FAILED})")
def queue_entries(spark, folder):
    return _queue_rows(spark, folder).drop("invoice_state_json")


EMAIL_LOG_SQL = (
    f"""SELECT CAST({TIME} AS VARCHAR) AS "timestamp", 'dry_run' AS mode, invoice_no, d_recipient AS "to", d_subject AS subject,
      d_tone AS tone, d_greeting || chr(10) || chr(10) || d_body || chr(10) || chr(10) || d_closing AS body
    FROM outcomes WHERE outcome = 'sent'"""
)


@query(EMAIL_LOG_SQL)
def email_log(spark, folder):
    return outcomes.email_log_rows(_outcomes(spark, folder), star.now())


# --- audit ------------------------------------------------------------------------------------

def _audit_arrivals(spark, folder):
    """Events as audit rows with many copies per key, in order of arrival."""
    return star.table(spark, folder, "events").select(
        (F.col("user_id") % star.JOBS).alias("job_id"),
        F.concat(F.lit("INV-"), F.col("user_id").cast("string")).alias("invoice_no"),
        F.when(F.col("event_type") == "error", F.lit("failed")).otherwise(F.lit("sent")).alias("send_status"),
        (F.col("event_id") % 4).cast("int").alias("retry_count"),
        F.col("props").alias("error_message"),
        "event_id",
    )


_ARRIVALS = (
    f"SELECT user_id % {star.JOBS} AS job_id, 'INV-' || user_id AS invoice_no, "
    "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'sent' END AS send_status, "
    "CAST(event_id % 4 AS INTEGER) AS retry_count, props AS error_message, event_id FROM events"
)
_FIRST = (
    f"SELECT * FROM ({_ARRIVALS}) QUALIFY row_number() OVER "
    "(PARTITION BY job_id, invoice_no, send_status, retry_count ORDER BY event_id) = 1"
)


@query(_FIRST)
def first_audit_rows(spark, folder):
    return audit.first_per_key(_audit_arrivals(spark, folder), ["event_id"])


def _audit_on_file(spark, folder):
    return star.table(spark, folder, "customer").select(
        (F.col("c_custkey") % star.JOBS).alias("job_id"),
        F.concat(F.lit("INV-"), F.col("c_custkey").cast("string")).alias("invoice_no"),
        F.when(F.col("c_acctbal") < 0, F.lit("failed")).otherwise(F.lit("sent")).alias("send_status"),
        (F.col("c_nationkey") % 4).alias("retry_count"),
        F.col("c_mktsegment").alias("error_message"),
        (-F.col("c_custkey") - 1).alias("event_id"),
    )


_ON_FILE = (
    f"SELECT c_custkey % {star.JOBS} AS job_id, 'INV-' || c_custkey AS invoice_no, "
    "CASE WHEN c_acctbal < 0 THEN 'failed' ELSE 'sent' END AS send_status, c_nationkey % 4 AS retry_count, "
    "c_mktsegment AS error_message, -c_custkey - 1 AS event_id FROM customer"
)
_NEW_AUDIT = (
    f"SELECT * FROM ({_FIRST}) n WHERE NOT EXISTS (SELECT 1 FROM ({_ON_FILE}) e WHERE e.job_id = n.job_id "
    "AND e.invoice_no = n.invoice_no AND e.send_status = n.send_status AND e.retry_count = n.retry_count)"
)


@query(_NEW_AUDIT)
def new_audit_rows(spark, folder):
    return audit.new_audit_rows(
        _audit_arrivals(spark, folder), _audit_on_file(spark, folder), ["event_id"]
    )


@query(f"{_NEW_AUDIT} UNION ALL {_ON_FILE}")
def appended_audit(spark, folder):
    return audit.append_audit(
        _audit_arrivals(spark, folder), _audit_on_file(spark, folder), ["event_id"]
    )


@query(_AUDIT_SQL + " WHERE job_id = 7")
def audit_of_job(spark, folder):
    return audit.audit_of_job(_audit(spark, folder), 7)


@query(f"SELECT * FROM ({_ON_FILE}) WHERE job_id NOT IN (SELECT r_regionkey FROM region)")
def audit_orphans(spark, folder):
    known = star.table(spark, folder, "region").select(F.col("r_regionkey").cast("long").alias("id"))
    return quality.orphans(_audit_on_file(spark, folder), known)


# --- the retry queue --------------------------------------------------------------------------

_QUEUE_COLUMNS = "job_id, invoice_no, error_type, error_message, retry_count, max_retries, next_retry_at, status, created_at, updated_at"
_QUEUE_TIMES = texts("next_retry_at", "created_at", "updated_at")


@query(
    f"""SELECT * REPLACE {_QUEUE_TIMES} FROM (
      SELECT coalesce(q.job_id, n.job_id) AS job_id, coalesce(q.invoice_no, n.invoice_no) AS invoice_no, CASE WHEN n.job_id IS NULL THEN q.error_type ELSE n.error_type END AS error_type,
        CASE WHEN n.job_id IS NULL THEN q.error_message ELSE n.error_message END AS error_message,
        CASE WHEN n.job_id IS NULL THEN q.retry_count ELSE n.retry_count END AS retry_count,
        CASE WHEN n.job_id IS NULL THEN q.max_retries ELSE n.max_retries END AS max_retries,
        CASE WHEN n.job_id IS NULL THEN q.next_retry_at ELSE n.next_retry_at END AS next_retry_at,
        CASE WHEN n.job_id IS NULL THEN q.status ELSE n.status END AS status,
        coalesce(q.created_at, n.created_at) AS created_at, CASE WHEN n.job_id IS NULL THEN q.updated_at ELSE n.updated_at END AS updated_at
      FROM (SELECT * FROM queue WHERE o_orderkey % 3 = 0) q FULL JOIN ({_NEW_FAILED}) n ON n.job_id = q.job_id AND n.invoice_no = q.invoice_no)"""
)
def queue_upsert(spark, folder):
    """New failures meet a queue that has a third of the invoices, so some are changed and some come in."""
    on_file = star.failed_queue(spark, folder).filter(_sequence().cast("long") % 3 == 0)
    return failures.upsert_failures(on_file, _queue_rows(spark, folder)).drop("invoice_state_json")


_DUE = f"SELECT {_QUEUE_COLUMNS} FROM queue WHERE status = 'pending' AND next_retry_at <= {TIME}"


@query(f"SELECT * REPLACE {_QUEUE_TIMES} FROM ({_DUE} ORDER BY next_retry_at, job_id, invoice_no LIMIT 100)")
def due_failures(spark, folder):
    return failures.due_failures(star.failed_queue(spark, folder), star.now()).drop("invoice_state_json")


@query(f"SELECT * REPLACE {_QUEUE_TIMES} FROM ({_DUE})")
def all_due_failures(spark, folder):
    return failures.due_failures(star.failed_queue(spark, folder), star.now(), limit=None).drop(
        "invoice_state_json"
    )


@query(
    f"SELECT * REPLACE {_QUEUE_TIMES} FROM (SELECT {_QUEUE_COLUMNS} FROM queue ORDER BY updated_at DESC, job_id, invoice_no LIMIT 500)"
)
def latest_failures(spark, folder):
    return failures.latest_failures(star.failed_queue(spark, folder)).drop("invoice_state_json")


def _retry_results(spark, folder):
    return star.send_results(spark, folder).join(
        star.table(spark, folder, "orders").select(
            F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")).alias("invoice_no"), "o_orderstatus"
        ),
        "invoice_no",
    ).filter(F.col("o_orderstatus") != "O").select(
        "job_id",
        "invoice_no",
        F.when(F.col("o_orderstatus") == "F", F.lit("failed")).when(F.col("success"), F.lit("sent"))
        .otherwise(F.lit("not_sent")).alias("send_status"),
        F.col("message").alias("send_error"),
    )


@query(
    f"""SELECT job_id, invoice_no, error_type, CASE WHEN hit AND failed THEN send_error ELSE error_message END AS error_message,
      CAST(n AS INTEGER) AS retry_count, max_retries,
      CAST(CASE WHEN hit AND failed THEN CASE WHEN n >= max_retries THEN NULL ELSE {TIME} + {sql.backoff('n')} END ELSE next_retry_at END AS VARCHAR) AS next_retry_at,
      CASE WHEN NOT hit THEN status WHEN NOT failed THEN 'resolved' WHEN n >= max_retries THEN 'permanent_failure' ELSE 'pending' END AS status,
      CAST(created_at AS VARCHAR) AS created_at, CAST(CASE WHEN hit THEN {TIME} ELSE updated_at END AS VARCHAR) AS updated_at
    FROM (SELECT q.*, o.o_orderstatus <> 'O' AS hit, o.o_orderstatus = 'F' AS failed, s.send_message AS send_error,
        q.retry_count + CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS n
      FROM queue q JOIN orders o ON o.o_orderkey = q.o_orderkey
      JOIN send_results s ON s.invoice_no = q.invoice_no)"""
)
def retry_transitions(spark, folder):
    return retries.apply_results(
        star.failed_queue(spark, folder), _retry_results(spark, folder), star.now()
    ).drop("invoice_state_json")


_RESTORED = "queue q JOIN staged s ON s.job_id = q.job_id AND s.invoice_no = q.invoice_no"


@query(
    f"SELECT q.job_id, q.invoice_no, s.client, s.days_overdue, s.stage_key, s.tone, s.cta, 0 AS retry_count, 5 AS max_retries "
    f"FROM {_RESTORED} WHERE q.payload = 'whole'"
)
def restored_states(spark, folder):
    readable, _ = failures.split_states(star.failed_queue(spark, folder))
    return retries.restored_invoices(readable).select(
        "job_id", "invoice_no", "client", "days_overdue", "stage_key", "tone", "cta", "retry_count", "max_retries"
    )


@query(
    f"""SELECT r.job_id, r.invoice_no, r.later AS days_overdue, g.stage_key, g.tone FROM (
      SELECT q.job_id, q.invoice_no, CAST(greatest(date_diff('day', s.due_date, {DAY}) + 9, 0) AS INTEGER) AS later
      FROM {_RESTORED} WHERE q.payload = 'whole') r
    JOIN stages g ON r.later BETWEEN g.first_day AND g.last_day"""
)
def restaged_states(spark, folder):
    readable, _ = failures.split_states(star.failed_queue(spark, folder))
    later = F.date_add(star.as_of(), 9)
    return retries.restored_invoices(readable, later, "iso").select(
        "job_id", "invoice_no", "days_overdue", "stage_key", "tone"
    )


def _retried(spark, folder):
    readable, _ = failures.split_states(star.failed_queue(spark, folder))
    return outcomes.decide_outcomes(
        retries.restored_invoices(readable),
        star.drafts(spark, folder),
        star.send_results(spark, folder),
        revisions=fv.MAX_QUEUE_RETRIES,
    )


_RETRIED = """
    SELECT s.job_id, s.invoice_no, CASE s.route WHEN 'no_overdue' THEN 'not_overdue' WHEN 'escalation' THEN 'escalated_stage'
      ELSE CASE WHEN f.stop IS NULL THEN 'awaiting_draft' WHEN r.rule = 6 THEN 'attempt_failed'
        WHEN x.success THEN 'sent' ELSE 'send_failed' END END AS outcome,
      CASE WHEN s.route = 'draft' AND r.rule = 0 THEN f.stop ELSE 0 END AS retry_count
    FROM (SELECT s.* FROM staged s JOIN queue q ON s.job_id = q.job_id AND s.invoice_no = q.invoice_no WHERE q.payload = 'whole') s
    LEFT JOIN (SELECT job_id, invoice_no, min(revision) AS stop FROM rulings WHERE rule IN (0, 6) GROUP BY ALL) f
      ON f.job_id = s.job_id AND f.invoice_no = s.invoice_no
    LEFT JOIN rulings r ON r.job_id = s.job_id AND r.invoice_no = s.invoice_no AND r.revision = f.stop
    LEFT JOIN send_results x ON x.job_id = s.job_id AND x.invoice_no = s.invoice_no"""


@query(
    f"SELECT job_id, invoice_no, outcome, CAST(retry_count AS INTEGER) AS retry_count FROM ({_RETRIED})"
)
def retry_outcomes(spark, folder):
    return _retried(spark, folder).select("job_id", "invoice_no", "outcome", "retry_count")


@query(
    f"""SELECT n.job_id, n.invoice_no, n.send_status, CAST(n.retry_count AS INTEGER) AS retry_count FROM (
      SELECT job_id, invoice_no, retry_count, CASE outcome WHEN 'sent' THEN 'sent' WHEN 'send_failed' THEN 'failed' ELSE 'not_sent' END AS send_status
      FROM ({_RETRIED}) WHERE outcome NOT IN ('attempt_failed', 'awaiting_draft')) n
    WHERE NOT EXISTS (SELECT 1 FROM audit a WHERE a.job_id = n.job_id AND a.invoice_no = n.invoice_no
      AND a.send_status = n.send_status AND a.retry_count = n.retry_count)"""
)
def retry_audit(spark, folder):
    rows = outcomes.audit_rows(_retried(spark, folder), star.now())
    return audit.new_audit_rows(rows, _audit(spark, folder)).select(
        "job_id", "invoice_no", "send_status", "retry_count"
    )


# --- jobs -------------------------------------------------------------------------------------

_JOB_TIMES = texts("created_at", "started_at", "completed_at")


def _jobs(spark, folder):
    return ledger.fold_jobs(star.job_events(spark, folder))


@query(f"SELECT * REPLACE {_JOB_TIMES} FROM jobs")
def job_ledger(spark, folder):
    return _jobs(spark, folder)


@query(
    f"""SELECT CAST(id AS BIGINT) AS id, file_path, file_hash, status, coalesce(m.total_records, 0) AS total_records,
      coalesce(m.processed_count, 0) AS processed_count, coalesce(m.sent_count, 0) AS sent_count,
      coalesce(m.escalated_count, 0) AS escalated_count, coalesce(m.failed_count, 0) AS failed_count,
      CAST(created_at AS VARCHAR) AS created_at, CAST(started_at AS VARCHAR) AS started_at,
      CAST(completed_at AS VARCHAR) AS completed_at, error_message
    FROM jobs j LEFT JOIN metrics m ON m.job_id = j.id"""
)
def job_ledger_with_metrics(spark, folder):
    counted = metrics.job_metrics(_outcomes(spark, folder))
    return ledger.fold_jobs(star.job_events(spark, folder), counted)


@query(
    f"SELECT CAST(c_custkey AS BIGINT) AS job_id, 0::BIGINT AS seq, 'queued' AS status, CAST({TIME} AS VARCHAR) AS \"at\", "
    "CAST(NULL AS VARCHAR) AS error_message, '/uploads/' || c_custkey AS file_path, sha256(c_name) AS file_hash FROM customer"
)
def job_created_events(spark, folder):
    uploads = star.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("job_id"),
        F.concat(F.lit("/uploads/"), F.col("c_custkey").cast("string")).alias("file_path"),
        F.sha2("c_name", 256).alias("file_hash"),
    )
    return ledger.created_events(uploads, star.now())


@query(
    f"""SELECT id, CASE WHEN seq IS NULL THEN status WHEN id % 2 = 0 THEN 'failed' ELSE 'completed' END AS status,
      CASE WHEN seq IS NULL THEN error_message WHEN id % 2 = 0 THEN 'stopped by hand' END AS error_message,
      CAST(CASE WHEN seq IS NULL THEN completed_at ELSE greatest(coalesce(completed_at, {TIME}), TIMESTAMP '2030-01-01 00:00:00') END AS VARCHAR) AS completed_at
    FROM jobs LEFT JOIN (SELECT o_orderkey, 9 AS seq FROM orders WHERE o_orderstatus = 'P') p ON p.o_orderkey = id"""
)
def job_status_changes(spark, folder):
    late = F.lit("2030-01-01 00:00:00").cast("timestamp")
    stopped = star.table(spark, folder, "orders").filter(F.col("o_orderstatus") == "P").select(
        F.col("o_orderkey").alias("job_id")
    )
    even = F.col("job_id") % 2 == 0
    changes = ledger.status_events(
        stopped,
        F.when(even, F.lit("failed")).otherwise(F.lit("completed")),
        F.lit(9),
        late,
        F.when(even, F.lit("stopped by hand")),
    )
    events = star.job_events(spark, folder).unionByName(changes)
    return ledger.fold_jobs(events).select("id", "status", "error_message", "completed_at")


@query("SELECT file_hash, max(id) AS id, arg_max(status, id) AS status FROM jobs GROUP BY file_hash")
def latest_jobs_by_hash(spark, folder):
    return ledger.latest_job_by_hash(_jobs(spark, folder))


@query(
    """SELECT c_custkey, CASE WHEN status IN ('queued', 'running') THEN 'in_progress' WHEN status = 'completed' THEN 'cached' ELSE 'new' END AS decision,
      CASE WHEN status IN ('queued', 'running', 'completed') THEN id END AS existing_job_id
    FROM customer LEFT JOIN (SELECT file_hash, max(id) AS id, arg_max(status, id) AS status FROM jobs GROUP BY file_hash) j
      ON j.file_hash = sha256(CAST(c_custkey AS VARCHAR))"""
)
def ingest_decisions(spark, folder):
    prints = star.table(spark, folder, "customer").select(
        "c_custkey", F.sha2(F.col("c_custkey").cast("string"), 256).alias("file_hash")
    )
    return ledger.ingest_decision(prints, _jobs(spark, folder)).select(
        "c_custkey", "decision", "existing_job_id"
    )


@query(f"SELECT * REPLACE {_JOB_TIMES} FROM jobs WHERE id = 42")
def job_by_id(spark, folder):
    return ledger.job_by_id(_jobs(spark, folder), 42)


@query(f"SELECT * REPLACE {_JOB_TIMES} FROM (SELECT * FROM jobs WHERE file_hash = sha256('7') ORDER BY id DESC LIMIT 1)")
def job_by_hash(spark, folder):
    import hashlib

    return ledger.job_by_hash(_jobs(spark, folder), hashlib.sha256(b"7").hexdigest())


@query(f"SELECT * REPLACE {_JOB_TIMES} FROM (SELECT * FROM jobs ORDER BY id DESC LIMIT 50)")
def newest_jobs(spark, folder):
    return ledger.newest_jobs(_jobs(spark, folder))


# --- metrics ----------------------------------------------------------------------------------

_METRIC_COLUMNS = (
    "job_id, total_records, processed_count, sent_count, escalated_count, failed_count, not_sent_count, "
    "total_retries, successful_count, success_rate, failure_rate, escalation_rate, average_retries"
)


@query(f"SELECT {_METRIC_COLUMNS} FROM metrics")
def job_metrics(spark, folder):
    return metrics.job_metrics(_outcomes(spark, folder)).select(*_METRIC_COLUMNS.split(", "))


def _counted_jobs(spark, folder):
    counted = metrics.job_metrics(_outcomes(spark, folder))
    return counted.withColumn("id", F.col("job_id"))


@query(
    "SELECT *, " + percent("sent_count", "total_records", 1) + " AS sent_rate FROM (SELECT count(*) AS jobs, "
    + ", ".join(
        f"CAST(sum({c}) AS BIGINT) AS {c}"
        for c in ("total_records", "processed_count", "sent_count", "escalated_count", "failed_count")
    )
    + " FROM metrics)"
)
def all_jobs_totals(spark, folder):
    return metrics.all_jobs_totals(_counted_jobs(spark, folder))


@query(
    "SELECT job_id, " + percent("processed_count", "total", 1) + " AS progress, "
    + percent("sent_count", "total", 1) + " AS success, least(processed_count::DOUBLE / total, 1.0) AS live, "
    + two_digits("sent_count::DOUBLE / greatest(total, sent_count + escalated_count + failed_count, 1) * 100.0") + " AS sent_share, "
    + two_digits("escalated_count::DOUBLE / greatest(total, sent_count + escalated_count + failed_count, 1) * 100.0") + " AS escalated_share, "
    + two_digits("failed_count::DOUBLE / greatest(total, sent_count + escalated_count + failed_count, 1) * 100.0") + " AS failed_share, "
    "greatest(total - (sent_count + escalated_count + failed_count), 0) AS remaining "
    "FROM (SELECT *, processed_count + job_id * 40 - 200 AS total FROM metrics)"
)
def job_progress(spark, folder):
    jobs = _counted_jobs(spark, folder).withColumn(
        "total_records", F.col("processed_count") + F.col("job_id") * 40 - 200
    )
    return metrics.with_progress(jobs).select(
        "job_id", "progress", "success", "live", "sent_share", "escalated_share", "failed_share", "remaining"
    )


@query("SELECT CASE WHEN stage_key = 'No_overdue' THEN 'Unspecified' ELSE tone_used END AS tone, count(*) AS emails FROM audit GROUP BY 1")
def tone_histogram(spark, folder):
    rows = _audit(spark, folder).withColumn(
        "tone_used", F.when(F.col("stage_key") != fv.STAGE_NOT_OVERDUE, F.col("tone_used")).otherwise(F.lit(""))
    )
    return metrics.tone_histogram(rows)


_COUNTS = "count(*) AS shown, count(*) FILTER (WHERE send_status = 'sent') AS sent, count(*) FILTER (WHERE send_status = 'failed') AS failed"


@query(f"SELECT {_COUNTS} FROM audit WHERE job_id = 3")
def audit_counters(spark, folder):
    return metrics.audit_counters(audit.audit_of_job(_audit(spark, folder), 3))


@query(f"SELECT {_COUNTS}, count(*) FILTER (WHERE escalation_required) AS escalated FROM audit")
def email_counters(spark, folder):
    return metrics.email_counters(_audit(spark, folder))


@query(
    "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'resolved') AS resolved, "
    "count(*) FILTER (WHERE status = 'permanent_failure') AS permanent FROM queue"
)
def failure_counters(spark, folder):
    return metrics.failure_counters(star.failed_queue(spark, folder))


@query(
    "SELECT '#' || job_id AS job, job_id AS id, sent_count, escalated_count, failed_count FROM "
    "(SELECT * FROM metrics ORDER BY job_id DESC LIMIT 15)"
)
def job_bars(spark, folder):
    return metrics.job_bars(_counted_jobs(spark, folder))


# --- views ------------------------------------------------------------------------------------

@query(f"SELECT * REPLACE {_JOB_TIMES} FROM jobs WHERE status IN ('failed', 'running') AND regexp_matches(CAST(id AS VARCHAR), '1.*7$')")
def jobs_filtered(spark, folder):
    return views.jobs_view(_jobs(spark, folder), ["failed", "running"], " 1.*7$ ")


@query(
    _AUDIT_SQL + " WHERE (regexp_matches(invoice_no, '(?i)inv-1[0-4]') OR regexp_matches(client, '(?i)inv-1[0-4]')) "
    "AND send_status IN ('sent', 'failed') AND stage_key IN ('1st Follow-Up', '4th Follow-Up')"
)
def audit_filtered(spark, folder):
    return views.audit_view(
        _audit(spark, folder), "inv-1[0-4]", ["sent", "failed"], ["1st Follow-Up", "4th Follow-Up"]
    )


@query(
    "SELECT invoice_no, CASE stage_key WHEN 'Escalation Flag' THEN 'Escalations' WHEN 'No_overdue' THEN 'No overdue' "
    "ELSE 'Client emails' END AS kind FROM audit"
)
def email_types(spark, folder):
    return _audit(spark, folder).select("invoice_no", views.email_type().alias("kind"))


_FEED = "(SELECT * FROM audit ORDER BY created_at DESC, job_id, invoice_no LIMIT 300)"
_FEED_SELECT = "SELECT * REPLACE (CAST(created_at AS VARCHAR) AS created_at, CAST(amount AS DOUBLE) AS amount) FROM "


@query(f"{_FEED_SELECT}{_FEED}")
def email_feed(spark, folder):
    return views.email_feed(_audit(spark, folder))


@query(f"{_FEED_SELECT}{_FEED.replace('FROM audit', 'FROM audit WHERE job_id = 5')}")
def email_feed_of_job(spark, folder):
    return views.email_feed(_audit(spark, folder), job_id=5)


@query(
    f"{_FEED_SELECT}{_FEED} WHERE send_status = 'sent' AND stage_key NOT IN ('Escalation Flag', 'No_overdue') "
    "AND contains(lower(invoice_no || client), '2customer')"
)
def emails_filtered(spark, folder):
    feed = views.email_feed(_audit(spark, folder))
    return views.email_view(feed, "sent", "Client emails", " 2Customer ")


@query(f"{_FEED_SELECT}(SELECT * FROM audit ORDER BY created_at DESC, job_id, invoice_no LIMIT 40)")
def email_page(spark, folder):
    return views.email_page(_audit(spark, folder), pages=2)


@query(
    f"{_FEED_SELECT}(SELECT * FROM audit WHERE created_at < {TIME} + INTERVAL 900 SECOND ORDER BY created_at DESC, job_id, invoice_no LIMIT 20)"
)
def email_next_page(spark, folder):
    import datetime as dt

    after = (star.NOW + dt.timedelta(seconds=900), 10**6, "~")
    return views.next_page(_audit(spark, folder), after)


@query(
    f"""SELECT * FROM (SELECT * REPLACE {_QUEUE_TIMES} FROM (SELECT {_QUEUE_COLUMNS} FROM queue)) WHERE status IN ('pending', 'resolved')
      AND contains(lower(concat_ws(' ', job_id, invoice_no, error_type, error_message, retry_count, max_retries,
        coalesce(next_retry_at, 'None'), status, created_at, updated_at)), 'limit reached 1')"""
)
def failures_filtered(spark, folder):
    queue = star.failed_queue(spark, folder).drop("invoice_state_json")
    return views.failures_view(queue, ["pending", "resolved"], "Limit reached 1")


@query(f"SELECT * REPLACE {_JOB_TIMES} FROM jobs WHERE status IN ('running', 'queued')")
def active_jobs(spark, folder):
    return views.active_jobs(_jobs(spark, folder))


@query("SELECT DISTINCT stage_key AS option FROM audit")
def filter_options(spark, folder):
    return views.filter_options(_audit(spark, folder), "stage_key")


@query(
    "SELECT job_id, invoice_no AS invoice_number, client AS client_name, contact_email AS recipient_email, "
    "amount_text AS amount, due_text AS due_date, o_orderkey FROM text_invoices ORDER BY job_id, invoice_no LIMIT 20"
)
def preview(spark, folder):
    return views.preview(star.invoices_text(spark, folder), 20, ("job_id", "invoice_number"))


# --- profile and quality ----------------------------------------------------------------------

def _loose(spark, folder):
    return star.invoices_text(spark, folder).drop("o_orderkey", "invoice_number")


_LOOSE = "SELECT job_id, client AS client_name, contact_email AS recipient_email, amount_text AS amount, due_text AS due_date FROM text_invoices"
_LOOSE_NAMES = ["job_id", "client_name", "recipient_email", "amount", "due_date"]


@query(
    "SELECT count(*) AS rows, 5::BIGINT AS columns, "
    + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in _LOOSE_NAMES)
    + f" AS empty_cells FROM ({_LOOSE})"
)
def table_profile(spark, folder):
    return profiling.table_profile(_loose(spark, folder))


@query(
    "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM "
    "(SELECT count(*) AS n FROM events GROUP BY user_id, event_type)"
)
def duplicate_rows(spark, folder):
    return profiling.duplicate_rows(star.table(spark, folder, "events").select("user_id", "event_type"))


@query("SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)")
def duplicate_documents(spark, folder):
    return profiling.duplicate_rows(star.table(spark, folder, "documents").select("text", "lang"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_rows(spark, folder):
    return profiling.without_duplicates(star.table(spark, folder, "events").select("user_id", "event_type"))


PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{kind}' AS type, {percent(f'count({c})', 'count(*)', 1)} AS filled_percent, "
    f"count(DISTINCT {c}) AS unique_values FROM ({_LOOSE})"
    for c, kind in zip(_LOOSE_NAMES, ["bigint", "object", "object", "object", "object"], strict=True)
)


@query(PROFILE_SQL)
def column_profile(spark, folder):
    return profiling.column_profile(_loose(spark, folder))


@query(
    f"""SELECT job_id, 'INV-' || (o_orderkey // {3 * star.JOBS}) AS invoice_no, count(*) AS copies
    FROM balanced_invoices GROUP BY ALL HAVING count(*) > 1"""
)
def duplicate_invoices(spark, folder):
    rows = normalize.normalize_invoices(star.invoices_sharing_numbers(spark, folder))
    return normalize.duplicate_invoices(rows)


def _rule(table, name, rule, condition):
    return f"SELECT '{name}' AS table_name, '{rule}' AS rule, count(*) FILTER (WHERE {condition}) AS violations FROM {table}"


_QUEUE_ALL = "(SELECT *, payload AS invoice_state_json FROM queue)"
_RULES = (
    [_rule("jobs", "jobs", f"{c} not null", f"{c} IS NULL") for c in ("file_path", "file_hash", "status", "created_at")]
    + [_rule("jobs", "jobs", "status accepted", "status NOT IN ('queued', 'running', 'completed', 'failed')")]
    + [_rule("audit", "audit_logs", f"{c} not null", f"{c} IS NULL") for c in ("job_id", "invoice_no", "client", "created_at")]
    + [
        _rule(_QUEUE_ALL, "failed_invoices", f"{c} not null", f"{c} IS NULL")
        for c in ("job_id", "invoice_no", "invoice_state_json", "status", "created_at", "updated_at")
    ]
    + [
        _rule("queue", "failed_invoices", "status accepted", "status NOT IN ('pending', 'retried', 'resolved', 'permanent_failure')"),
        "SELECT 'jobs' AS table_name, 'unique id' AS rule, count(*) - count(DISTINCT id) AS violations FROM jobs",
        "SELECT 'audit_logs' AS table_name, 'unique job_id, invoice_no, send_status, retry_count' AS rule, "
        "CAST(sum(n - 1) AS BIGINT) AS violations FROM (SELECT count(*) AS n FROM audit GROUP BY job_id, invoice_no, send_status, retry_count)",
        "SELECT 'failed_invoices' AS table_name, 'unique job_id, invoice_no' AS rule, "
        "CAST(sum(n - 1) AS BIGINT) AS violations FROM (SELECT count(*) AS n FROM queue GROUP BY job_id, invoice_no)",
        "SELECT 'audit_logs' AS table_name, 'job_id in jobs' AS rule, count(*) FILTER (WHERE job_id NOT IN (SELECT id FROM jobs)) AS violations FROM audit",
        "SELECT 'failed_invoices' AS table_name, 'job_id in jobs' AS rule, count(*) FILTER (WHERE job_id NOT IN (SELECT id FROM jobs)) AS violations FROM queue",
    ]
)


@query(" UNION ALL ".join(_RULES))
def constraint_audit(spark, folder):
    return quality.constraint_audit(
        _jobs(spark, folder), _audit(spark, folder), star.failed_queue(spark, folder)
    )


# --- batches ----------------------------------------------------------------------------------

_ORDERED = """
    SELECT *, row_number() OVER (PARTITION BY job_id, stage_key ORDER BY invoice_no) AS place,
      min(invoice_no) OVER (PARTITION BY job_id, stage_key) AS seen FROM staged_natural"""


@query(
    f"SELECT job_id, stage_key, invoice_no, stage_key || '_' || ((place - 1) // 10 + 1) AS batch_id, "
    f"CAST((place - 1) % 10 + 1 AS INTEGER) AS batch_position FROM ({_ORDERED})"
)
def invoice_batches(spark, folder):
    rows = star.staged(spark, folder, balanced=False).select("job_id", "stage_key", "invoice_no")
    return batching.assign_batches(rows).drop("dispatch_position")


@query(
    f"SELECT job_id, invoice_no, row_number() OVER (PARTITION BY job_id ORDER BY seen, place) AS dispatch_position FROM ({_ORDERED})"
)
def dispatch_order(spark, folder):
    rows = star.staged(spark, folder, balanced=False).select("job_id", "stage_key", "invoice_no")
    return batching.assign_batches(rows).select("job_id", "invoice_no", "dispatch_position")


@query(
    "SELECT job_id, stage_key, CAST(row_number() OVER (PARTITION BY job_id ORDER BY seen) AS INTEGER) AS stage_position FROM "
    f"(SELECT DISTINCT job_id, stage_key, seen FROM ({_ORDERED}))"
)
def stage_order(spark, folder):
    return batching.stage_order(star.staged(spark, folder, balanced=False))
