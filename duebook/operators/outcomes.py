"""One outcome per invoice, and the audit and queue rows that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook import fixed_values as fv
from duebook.functions.errors import error_class, next_retry_at
from duebook.functions.text import assemble_body, mask_email
from duebook.operators.attempts import resolve_attempts
from duebook.operators.drafts import with_subject
from duebook.operators.hot_keys import ROWS_PER_TASK, find_hot_keys, spread_join
from duebook.operators.validation import KEY, fold_revisions
from duebook.schemas import AUDIT, DRAFT_FIELDS, EMAIL_LOG, FAILED, INVOICE_STATE

_DRAFT_TYPE = "struct<" + ",".join(f"{name}:string" for name in DRAFT_FIELDS) + ">"
WAITING = ["in_flight", "awaiting_draft", "awaiting_send"]


def initial_route() -> Column:
    return (
        F.when(F.col("days_overdue") == 0, F.lit("no_overdue"))
        .when(F.col("escalation_required"), F.lit("escalation"))
        .otherwise(F.lit("draft"))
    )


def escalation_reason(days: Column, retry_count: Column) -> Column:
    def around(template: str, name: str, value: Column) -> Column:
        before, after = template.split("{" + name + "}")
        return F.concat(F.lit(before), value.cast("string"), F.lit(after))

    return F.when(
        days > fv.ESCALATION_AFTER_DAYS, around(fv.TEXT_ESCALATED_DAYS, "days", days)
    ).otherwise(around(fv.TEXT_ESCALATED_DRAFT, "n", retry_count))


def send_error_text(provider: Column, message: Column) -> Column:
    start, middle, end = fv.TEXT_SEND_FAILED.replace("{message}", "{provider}").split("{provider}")
    return F.concat(F.lit(start), provider, F.lit(middle), message, F.lit(end))


def send_result(draft: Column, send: Column) -> tuple[Column, Column]:
    """(went out, error text) of a send; without a draft nothing can go out."""
    none = draft.isNull()
    error = F.when(none, F.lit(fv.TEXT_NOTHING_TO_SEND)).when(
        ~send["success"], send_error_text(send["provider"], send["message"])
    )
    return ~none & send["success"], error


def _without_draft(rows: DataFrame) -> DataFrame:
    """Invoices that get no e-mail: not overdue, or too late for one."""
    late = F.col("route") == "escalation"
    reason = escalation_reason(F.col("days_overdue"), F.col("retry_count"))
    return rows.withColumns(
        {
            "outcome": F.when(late, F.lit("escalated_stage")).otherwise(F.lit("not_overdue")),
            "validation_status": F.when(~late, F.lit("approved")),
            "validation_feedback": F.when(late, F.lit("")).otherwise(F.lit(fv.TEXT_NOT_OVERDUE)),
            "send_status": F.lit("not_sent"),
            "send_error": F.when(late, reason).otherwise(F.lit(fv.TEXT_NOT_OVERDUE)),
            "escalation_required": late,
            "payment_link": F.lit(""),
            "draft": F.lit(None).cast(_DRAFT_TYPE),
        }
    )


def _with_draft(
    rows: DataFrame,
    drafts: DataFrame,
    send_results: DataFrame | None,
    attempts: DataFrame | None,
    revisions: int,
    strict: bool,
    rows_per_task: int,
) -> DataFrame:
    """Invoices that get an e-mail: validate, then read how sending went."""
    hot = find_hot_keys(rows, KEY, rows_per_task)
    if send_results is not None:
        # Before the fold: what comes out of it isn't known to be in order any more and would be sorted again.
        sends = send_results.groupBy(*KEY).agg(
            F.min(F.struct("success", "provider", "message")).alias("_send")
        )
        rows = spread_join(rows, sends, KEY, hot)
    else:
        rows = rows.withColumn(
            "_send", F.expr("struct(true AS success, 'dry_run' AS provider, '' AS message)")
        )
    rows = fold_revisions(rows, drafts, revisions, strict, hot)
    if attempts is not None:
        rows = resolve_attempts(rows, attempts, hot=hot)
    else:
        rows = rows.withColumns(
            {"attempt_state": F.lit("succeeded"), "attempt_error": F.lit(None).cast("string")}
        )

    state, tried = F.col("draft_state"), F.col("attempt_state")
    outcome = (
        F.when(tried == "failed", F.lit("attempt_failed"))
        .when(tried == "in_flight", F.lit("in_flight"))
        .when(state == "invalid", F.lit("attempt_failed"))
        .when(state == "awaiting_draft", F.lit("awaiting_draft"))
        .when(state == "exhausted", F.lit("escalated_draft"))
        .when(F.col("_send").isNull(), F.lit("awaiting_send"))
        .when(send_result(F.col("draft"), F.col("_send"))[0], F.lit("sent"))
        .otherwise(F.lit("send_failed"))
    )
    rows = rows.withColumns({"outcome": outcome, "_start": F.col("retry_count")})
    rejected = F.col("_start") + F.col("rejections")
    result = F.col("outcome")
    broken = result == "attempt_failed"
    waiting = result.isin(*WAITING)
    escalated = result == "escalated_draft"
    judged = result.isin("sent", "send_failed", "awaiting_send")
    return rows.withColumns(
        {
            "validation_status": F.when(judged, F.lit("approved")).when(
                escalated, F.lit("rejected")
            ),
            "validation_feedback": F.when(escalated, F.col("draft_feedback")).otherwise(F.lit("")),
            "send_status": F.when(result == "sent", F.lit("sent"))
            .when(broken | (result == "send_failed"), F.lit("failed"))
            .when(escalated, F.lit("not_sent"))
            .otherwise(F.lit("pending")),
            "send_error": F.when(tried == "failed", F.col("attempt_error"))
            .when(broken, F.col("draft_feedback"))
            .when(escalated, escalation_reason(F.col("days_overdue"), rejected))
            .when(result == "send_failed", send_result(F.col("draft"), F.col("_send"))[1])
            .otherwise(F.lit("")),
            "escalation_required": escalated,
            "retry_count": F.when(broken, F.lit(0)).when(waiting, F.col("_start")).otherwise(rejected),
            "max_retries": F.when(broken, F.lit(fv.MAX_QUEUE_RETRIES)).otherwise(F.col("max_retries")),
            "draft": F.when(~broken, F.col("draft")),
        }
    )


OUTCOME_COLUMNS = [
    *KEY, "client", "amount", "due_date_text", "contact_email", "followup_count", "days_overdue",
    "stage_key", "escalation_required", "followup_number", "tone", "key_message", "cta",
    "subject_template", "payment_link", "draft", "validation_status", "validation_feedback",
    "send_status", "send_error", "retry_count", "max_retries", "route", "outcome",
]


def decide_outcomes(
    staged: DataFrame,
    drafts: DataFrame,
    send_results: DataFrame | None = None,
    attempts: DataFrame | None = None,
    revisions: int = fv.MAX_REVISIONS,
    strict: bool = False,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Route, validate and settle every staged invoice.

    Only invoices in an e-mail stage are joined, so the many that are not overdue or long overdue
    never enter a shuffle. Drafts, attempts and send results are reduced to one row per invoice
    before they meet the invoices, all on the same key. An invoice number used by more than
    ``rows_per_task`` rows is looked for in a sample first and spread over several tasks. Without ``send_results`` every approved
    draft counts as sent (dry run); without ``attempts`` none failed. ``revisions`` must be at
    least the largest max_retries - retry_count of the rows.
    """
    routed = with_subject(staged).withColumn("route", initial_route())
    mailed = _with_draft(
        routed.filter(F.col("route") == "draft"),
        drafts, send_results, attempts, revisions, strict, rows_per_task,
    )
    quiet = _without_draft(routed.filter(F.col("route") != "draft"))
    return mailed.select(*OUTCOME_COLUMNS).unionByName(quiet.select(*OUTCOME_COLUMNS))


AUDITED = ["not_overdue", "escalated_stage", "escalated_draft", "sent", "send_failed"]
QUEUED = ["attempt_failed", "send_failed"]


def audit_rows(outcomes: DataFrame, created_at: Column) -> DataFrame:
    """Audit records with masked addresses. Attempts that broke off leave none."""
    draft = F.col("draft")
    return outcomes.filter(F.col("outcome").isin(*AUDITED)).select(
        "job_id",
        created_at.alias("created_at"),
        "invoice_no",
        "client",
        "amount",
        F.col("due_date_text").alias("due_date"),
        mask_email(F.col("contact_email")).alias("contact_email_masked"),
        "followup_count",
        "days_overdue",
        "stage_key",
        "escalation_required",
        "followup_number",
        "key_message",
        "cta",
        "payment_link",
        mask_email(draft["recipient"]).alias("recipient"),
        F.coalesce(draft["subject"], F.lit("")).alias("subject"),
        F.coalesce(draft["tone"], F.col("tone"), F.lit("")).alias("tone_used"),
        "validation_status",
        "validation_feedback",
        "send_status",
        F.col("send_error").alias("error_message"),
        "retry_count",
        "max_retries",
    ).select(*AUDIT.fieldNames())


def state_struct() -> Column:
    """What a queued invoice has to remember to be tried again."""
    flat = {
        "invoice": F.struct(
            "invoice_no", "client", "amount", F.col("due_date_text").alias("due_date"),
            "contact_email", "followup_count",
        ),
        "stage_meta": F.struct(
            "followup_number", "tone", "key_message", "cta",
            (F.col("stage_key") == fv.STAGE_ESCALATION).alias("escalation_required"),
            "subject_template",
        ),
    }
    return F.struct(*[flat.get(name, F.col(name)).alias(name) for name in INVOICE_STATE.fieldNames()])


def queue_rows(outcomes: DataFrame, now: Column) -> DataFrame:
    """New entries of the retry queue: every failed result, permanent errors included."""
    return outcomes.filter(F.col("outcome").isin(*QUEUED)).select(
        *KEY,
        F.to_json(state_struct()).alias("invoice_state_json"),
        error_class(F.col("send_error")).alias("error_type"),
        F.col("send_error").alias("error_message"),
        "retry_count",
        "max_retries",
        next_retry_at(now, F.col("retry_count")).alias("next_retry_at"),
        F.lit("pending").alias("status"),
        now.alias("created_at"),
        now.alias("updated_at"),
    ).select(*FAILED.fieldNames())


def email_log_rows(outcomes: DataFrame, at: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Dry-run log: one row per e-mail that went out."""
    draft = F.col("draft")
    return outcomes.filter(F.col("outcome") == "sent").select(
        at.alias("timestamp"),
        F.lit("dry_run").alias("mode"),
        "invoice_no",
        draft["recipient"].alias("to"),
        draft["subject"].alias("subject"),
        draft["tone"].alias("tone"),
        assemble_body(draft["greeting"], draft["body"], draft["closing"]).alias("body"),
        *keep,
    ).select(*EMAIL_LOG.fieldNames(), *keep)
