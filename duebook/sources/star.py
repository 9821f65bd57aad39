"""Receivables inputs read out of an order/customer star schema.

Every order is an invoice of its customer. Drafts, attempts, send results, jobs and the retry queue
are derived from the same rows, with faults and failures given by the order number, so that all
operators have whole tables to work on.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duebook import fixed_values as fv
from duebook.operators.drafts import template_drafts, with_subject
from duebook.operators.normalize import normalize_invoices, stage_invoices
from duebook.operators.outcomes import state_struct
from duebook.schemas import DRAFT_FIELDS, FAILED

AS_OF = dt.date(1998, 6, 30)
NOW = dt.datetime(1998, 6, 30, 12, 0, 0)
JOBS = 20

ERROR_TEXTS = [
    "HTTP 429 returned",
    "Rate limit reached",
    "model capacity exceeded",
    "service tier capacity exceeded for model",
    "read TIMEOUT after 30s",
    "service temporarily unavailable",
    "Connection error.",
    "maximum retry attempts reached",
    "invalid api key",
    "bad request",
]


def as_of() -> Column:
    return F.lit(AS_OF)


def now() -> Column:
    return F.lit(NOW.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    orders = table(spark, folder, "orders")
    return orders.join(customers, orders.o_custkey == customers.c_custkey)


def _invoice(due_date: Column, amount: Column, *extra: Column | str) -> list[Column | str]:
    email = F.concat(
        F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com")
    )
    return [
        (F.col("o_custkey") % JOBS).alias("job_id"),
        F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")).alias("invoice_number"),
        F.col("c_name").alias("client_name"),
        email.alias("recipient_email"),
        amount.alias("amount"),
        due_date.alias("due_date"),
        *extra,
    ]


def invoices(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as raw invoices, due on the order date."""
    return _orders(spark, folder).select(
        *_invoice(F.to_date("o_orderdate"), F.col("o_totalprice"), "o_orderkey")
    )


def balanced_due_date() -> Column:
    return F.date_sub(as_of(), (F.col("o_orderkey") % 45 - 5).cast("int"))


def invoices_balanced(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as raw invoices, due from 5 days ahead to 39 days back."""
    return _orders(spark, folder).select(
        *_invoice(balanced_due_date(), F.col("o_totalprice"), "o_orderkey")
    )


def text_due_date() -> Column:
    """The order date in six notations; the seventh class is junk or missing."""
    day = F.to_date("o_orderdate")
    kind = F.col("o_orderkey") % 7
    text = F
    for i, pattern in enumerate(
        ["yyyy-MM-dd", "dd/MM/yyyy", "d MMM yyyy", "MMMM d, yyyy", "yyyyMMdd", "dd.MM.yyyy"]
    ):
        text = text.when(kind == i, F.date_format(day, pattern))
    return text.when(F.col("o_orderkey") % 2 == 0, F.lit("not a date"))


def invoices_text(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as raw text rows, as they come out of a file, with gaps in some fields."""
    key = F.col("o_orderkey")
    amount = F.when(key % 17 == 3, F.lit("n/a")).otherwise(
        F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    )
    rows = _orders(spark, folder).select(*_invoice(text_due_date(), amount, "o_orderkey"))
    return rows.withColumns(
        {
            "client_name": F.when(key % 19 != 4, F.col("client_name")).otherwise(F.lit("  ")),
            "recipient_email": F.when(key % 23 != 5, F.col("recipient_email")),
        }
    )


def staged(spark: SparkSession, folder: str, balanced: bool = True) -> DataFrame:
    raw = invoices_balanced(spark, folder) if balanced else invoices(spark, folder)
    return stage_invoices(normalize_invoices(raw), as_of())


def drafts(spark: SparkSession, folder: str) -> DataFrame:
    """One to four revisions per invoice in an e-mail stage, the first ones faulty.

    ``o_orderkey % 8`` picks the fault, ``o_orderkey / 16 % 4`` the first faultless revision and
    ``o_orderkey / 64 % 4 + 1`` how many there are.
    """
    key = F.col("o_orderkey")
    count = F.floor(key / 64).cast("long") % 4
    clean = template_drafts(staged(spark, folder), keep=("o_orderkey",)).drop("revision")
    clean = clean.withColumn("revision", F.explode(F.sequence(F.lit(0), count.cast("int"))))
    fault = F.when(F.col("revision") < F.floor(key / 16).cast("long") % 4, key % 8).otherwise(
        F.lit(0)
    )
    clean = clean.withColumn("fault", fault)
    bad = F.col("fault")
    link = F.concat(F.lit(fv.PAYMENT_LINK_BASE), F.col("invoice_no"))
    changed = {
        "recipient": F.when(bad == 2, F.lit("someone.else@example.com")),
        "tone": F.when(
            bad == 3,
            F.when(F.col("tone") == "Warm & Friendly", F.lit("Stern & Urgent")).otherwise(
                F.lit("Warm & Friendly")
            ),
        ).when(bad == 7, F.lit("Cheerful")),
        "subject": F.when(bad == 4, F.concat(F.lit("Re: "), F.col("subject"))),
        "greeting": F.when(bad == 5, F.lit("Hello,")),
        "body": F.when(bad == 6, F.replace(F.col("body"), link, F.lit("our payment page"))),
    }
    return clean.select(
        "job_id",
        "invoice_no",
        "revision",
        *[
            F.when(bad != 1, F.coalesce(changed[c], F.col(c)) if c in changed else F.col(c)).alias(c)
            for c in DRAFT_FIELDS
        ],
    )


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user as attempts on that user's invoice, in order of time."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, folder, "events").withColumn("place", F.row_number().over(order))
    failed = F.col("event_type").isin("error", "click", "view")
    message = F.element_at(
        F.array(*[F.lit(t) for t in ERROR_TEXTS]), (F.col("event_id") % 10 + 1).cast("int")
    )
    return rows.select(
        (F.col("user_id") % JOBS).alias("job_id"),
        F.concat(F.lit("INV-"), F.col("user_id").cast("string")).alias("invoice_no"),
        (F.col("place") - 1).cast("int").alias("attempt"),
        F.when(failed, message).alias("error_message"),
    )


def send_results(spark: SparkSession, folder: str) -> DataFrame:
    """One delivery result per order; every eleventh is a failure."""
    key = F.col("o_orderkey")
    success = key % 11 != 0
    message = F.when(success, F.lit("accepted")).when(
        key % 2 == 0, F.lit("HTTP 503: temporarily unavailable")
    ).otherwise(F.lit("HTTP 400: bad request"))
    return table(spark, folder, "orders").select(
        (F.col("o_custkey") % JOBS).alias("job_id"),
        F.concat(F.lit("INV-"), key.cast("string")).alias("invoice_no"),
        success.alias("success"),
        F.lit("mailer").alias("provider"),
        message.alias("message"),
    )


def job_events(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as an upload of its customer's file, with up to three status changes."""
    key = F.col("o_orderkey")
    base = table(spark, folder, "orders").select(
        key.alias("job_id"),
        F.col("o_orderdate").cast("timestamp").alias("day"),
        F.concat(F.lit("/uploads/"), F.col("o_custkey").cast("string"), F.lit(".csv")).alias("file_path"),
        F.sha2(F.col("o_custkey").cast("string"), 256).alias("file_hash"),
        (key % 4).alias("kind"),
    )

    def event(seq: int, status: Column, minutes: int, path: bool) -> Column:
        error = F.when(status == "failed", F.lit("worker stopped"))
        return F.struct(
            F.lit(seq).cast("long").alias("seq"),
            status.alias("status"),
            (F.col("day") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))).alias("at"),
            error.alias("error_message"),
            (F.col("file_path") if path else F.lit(None).cast("string")).alias("file_path"),
            (F.col("file_hash") if path else F.lit(None).cast("string")).alias("file_hash"),
        )

    last = F.when(F.col("kind") == 3, F.lit("failed")).otherwise(F.lit("completed"))
    events = F.array_compact(
        F.array(
            event(0, F.lit("queued"), 0, True),
            F.when(F.col("kind") >= 1, event(1, F.lit("running"), 1, False)),
            F.when(F.col("kind") >= 2, event(2, last, 5, False)),
        )
    )
    return base.select("job_id", F.inline(events))


def invoices_faulty(spark: SparkSession, folder: str) -> DataFrame:
    """The balanced invoices, every nineteenth without a client, so that it is quarantined."""
    blank = F.col("o_orderkey") % 19 == 4
    return invoices_balanced(spark, folder).withColumn(
        "client_name", F.when(blank, F.lit(" ")).otherwise(F.col("client_name"))
    )


def invoices_sharing_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """The balanced invoices, with one number for each three order numbers of a job."""
    shared = F.floor(F.col("o_orderkey") / (3 * JOBS)).cast("string")
    return invoices_balanced(spark, folder).withColumn("invoice_number", F.concat(F.lit("INV-"), shared))


def failed_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Every invoice as a queue entry, in all states of the retry cycle."""
    rows = staged(spark, folder)
    key = F.col("o_orderkey")
    message = F.element_at(F.array(*[F.lit(t) for t in ERROR_TEXTS]), (key % 10 + 1).cast("int"))
    rows = with_subject(rows).withColumns(
        {
            "retry_count": F.lit(0),
            "max_retries": F.lit(fv.MAX_QUEUE_RETRIES),
            "validation_status": F.lit(None).cast("string"),
            "validation_feedback": F.lit(""),
            "send_status": F.lit("failed"),
            "send_error": message,
        }
    )
    kind = key % 9
    status = (
        F.when(kind == 7, F.lit("resolved"))
        .when(kind == 8, F.lit("permanent_failure"))
        .otherwise(F.lit("pending"))
    )
    whole = F.to_json(state_struct())
    payload = (
        F.when(key % 29 == 1, F.lit("{broken"))
        .when(key % 29 == 2, F.lit('{"retry_count": 1}'))
        .otherwise(whole)
    )
    moment = now()
    due = moment + F.make_dt_interval(F.lit(0), F.lit(0), (key % 61 - 30).cast("int"))
    age = moment - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (key % 100000).cast("double"))
    return rows.select(
        "job_id",
        "invoice_no",
        payload.alias("invoice_state_json"),
        F.when(key % 10 < 8, F.lit("retryable")).otherwise(F.lit("permanent")).alias("error_type"),
        message.alias("error_message"),
        (key % 7).cast("int").alias("retry_count"),
        F.when(key % 5 == 0, F.lit(3)).otherwise(F.lit(5)).alias("max_retries"),
        F.when(kind != 8, due).alias("next_retry_at"),
        status.alias("status"),
        (age - F.make_dt_interval(F.lit(1))).alias("created_at"),
        age.alias("updated_at"),
    ).select(*FAILED.fieldNames())
