"""Draft inputs, prompt texts and ready-made drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook import fixed_values as fv
from duebook.functions.money import currency_from_number
from duebook.functions.text import fill_template, payment_link, subject_line
from duebook.schemas import DRAFT_FIELDS

# Names of the 14 fields a draft is written from.
INPUT_FIELDS = [
    "client_name", "recipient_email", "invoice_id", "amount", "due_date", "days_overdue",
    "stage", "tone", "key_message", "cta", "payment_link", "finance_contact",
    "validation_feedback", "subject",
]

_TASK = """\
Write to {client_name} <{recipient_email}>.
They owe {amount} on invoice {invoice_id}; it fell due on {due_date}, {days_overdue} days ago.
This is the step called "{stage}", so sound like this: {tone}.
Make this point: {key_message} Then ask: {cta}
They can pay at {payment_link} and ask questions at {finance_contact}.
What was wrong with the last version: {validation_feedback}
"""

_TASK_WITH_SUBJECT = _TASK + "Put exactly this above it: {subject}\n"

# version -> (system text, human template). Pass your own to use other wording; a version without
# a human template gives the system text only.
PROMPTS: dict[str, tuple[str, str | None]] = {
    "v1": (
        "You write payment reminders for a finance team. Name the client, the invoice number, "
        "the amount, the due date, the days overdue and the payment link, with the values given "
        "and no others. Match the tone of the stage and end with the call to action.",
        _TASK,
    ),
    "v2": (
        "You write payment reminders for a finance team. Take subject, recipient and tone over "
        "unchanged. Name the client, the invoice number, the amount, the due date, the days "
        "overdue and the payment link. If there is validation feedback, put right what it names.",
        None,
    ),
    "v3": (
        "You write short payment reminders for a finance team, three to five paragraphs. Take "
        "subject, recipient and tone over unchanged and work the key message and the call to "
        "action in. Close with the finance team's regards.",
        _TASK_WITH_SUBJECT,
    ),
    "current": (
        "You write payment reminders for a finance team, in plain text. Use only the values "
        "given. Take subject, recipient and tone over unchanged; greet the client by name; name "
        "the invoice number, the amount, the due date, the days overdue and the payment link; "
        "keep the closing out of the body. Validation feedback, if any, comes before all else.",
        _TASK_WITH_SUBJECT,
    ),
}

# Wording of ready-made drafts: stage -> (greeting, body). They hold every value the rules ask for.
DRAFT_TEXTS: dict[str, tuple[str, str]] = {
    "1st Follow-Up": (
        "Hi {client_name},",
        "A friendly reminder about invoice {invoice_id} for {amount}, due on {due_date} and now "
        "{days_overdue} days past that date.\n\n{key_message} {cta}\n\nPay here: {payment_link}",
    ),
    "2nd Follow-Up": (
        "Dear {client_name},",
        "Invoice {invoice_id} for {amount} was due on {due_date} and is {days_overdue} days "
        "overdue.\n\n{key_message} {cta}\n\nPay here: {payment_link}",
    ),
    "3rd Follow-Up": (
        "Dear {client_name},",
        "Despite earlier reminders, invoice {invoice_id} for {amount}, due on {due_date}, is "
        "{days_overdue} days overdue.\n\n{key_message} {cta}\n\nPay here: {payment_link}",
    ),
    "4th Follow-Up": (
        "Dear {client_name},",
        "Final notice: invoice {invoice_id} for {amount}, due on {due_date}, is {days_overdue} "
        "days overdue.\n\n{key_message} {cta}\n\nPay here: {payment_link}",
    ),
}
DRAFT_CLOSING = "Regards,\nFinance Team"


def with_subject(staged: DataFrame) -> DataFrame:
    """Add the payment link and the subject the stage calls for."""
    link = F.col("payment_link") if "payment_link" in staged.columns else None
    return staged.withColumns(
        {
            "payment_link": payment_link(F.col("invoice_no"), link),
            "expected_subject": subject_line(
                F.col("subject_template"),
                F.col("invoice_no"),
                F.col("amount_raw"),
                F.col("days_overdue"),
            ),
        }
    )


def draft_inputs(
    staged: DataFrame, feedback: Column | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The 14 fields a draft is written from, with the key (job_id, invoice_no)."""
    feedback = F.lit(None).cast("string") if feedback is None else feedback
    return with_subject(staged).select(
        "job_id",
        "invoice_no",
        F.col("client").alias("client_name"),
        F.col("contact_email").alias("recipient_email"),
        F.col("invoice_no").alias("invoice_id"),
        currency_from_number(F.col("amount_raw")).alias("amount"),
        F.col("due_date_text").alias("due_date"),
        "days_overdue",
        F.col("stage_key").alias("stage"),
        "tone",
        "key_message",
        "cta",
        "payment_link",
        F.lit(fv.FINANCE_CONTACT).alias("finance_contact"),
        F.coalesce(feedback, F.lit(fv.NO_FEEDBACK)).alias("validation_feedback"),
        F.col("expected_subject").alias("subject"),
        *keep,
    )


def render_prompts(
    inputs: DataFrame,
    versions: tuple[str, ...] = ("current",),
    prompts: dict[str, tuple[str, str | None]] = PROMPTS,
) -> DataFrame:
    """One row per draft input and prompt version, for an offline model run."""
    values = {name: F.col(name) for name in INPUT_FIELDS}
    texts = []
    for version in versions:
        system, human = prompts[version]
        texts.append(
            F.struct(
                F.lit(version).alias("version"),
                F.lit(system).alias("system_text"),
                (F.lit(None).cast("string") if human is None else fill_template(human, values)).alias(
                    "human_text"
                ),
            )
        )
    return inputs.select("job_id", "invoice_no", F.inline(F.array(*texts)))


def template_drafts(staged: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Revision 0 of a draft for every invoice in an e-mail stage, from fixed wording."""
    inputs = draft_inputs(staged.filter(F.col("stage_key").isin(*DRAFT_TEXTS)), keep=keep)
    values = {name: F.col(name) for name in INPUT_FIELDS}

    def by_stage(part: int) -> Column:
        text = F
        for stage, texts in DRAFT_TEXTS.items():
            text = text.when(F.col("stage") == stage, fill_template(texts[part], values))
        return text

    return inputs.select(
        "job_id",
        "invoice_no",
        F.lit(0).alias("revision"),
        F.col("recipient_email").alias("recipient"),
        "subject",
        by_stage(0).alias("greeting"),
        by_stage(1).alias("body"),
        F.lit(DRAFT_CLOSING).alias("closing"),
        "tone",
        *keep,
    ).select("job_id", "invoice_no", "revision", *DRAFT_FIELDS, *keep)
