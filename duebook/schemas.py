"""Row types of the tables and the stage table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duebook import fixed_values as fv

MONEY = T.DecimalType(18, 2)

DRAFT_FIELDS = ["recipient", "subject", "greeting", "body", "closing", "tone"]

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "money": MONEY,
}


def _row(**fields: str | T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField(name, _TYPES[kind] if isinstance(kind, str) else kind)
            for name, kind in fields.items()
        ]
    )


_KEY = {"job_id": "long", "invoice_no": "string"}

DRAFTS = _row(**_KEY, revision="int", **{name: "string" for name in DRAFT_FIELDS})
ATTEMPTS = _row(**_KEY, attempt="int", error_message="string")
SEND_RESULTS = _row(**_KEY, success="boolean", provider="string", message="string")
EMAIL_LOG = _row(
    timestamp="timestamp", mode="string", invoice_no="string", to="string", subject="string",
    tone="string", body="string",
)
JOBS = _row(
    id="long", file_path="string", file_hash="string", status="string", total_records="long",
    processed_count="long", sent_count="long", escalated_count="long", failed_count="long",
    created_at="timestamp", started_at="timestamp", completed_at="timestamp",
    error_message="string",
)
JOB_EVENTS = _row(
    job_id="long", seq="long", status="string", at="timestamp", error_message="string",
    file_path="string", file_hash="string",
)
AUDIT = _row(
    job_id="long", created_at="timestamp", invoice_no="string", client="string", amount="money",
    due_date="string", contact_email_masked="string", followup_count="int", days_overdue="int",
    stage_key="string", escalation_required="boolean", followup_number="int",
    key_message="string", cta="string", payment_link="string", recipient="string",
    subject="string", tone_used="string", validation_status="string",
    validation_feedback="string", send_status="string", error_message="string",
    retry_count="int", max_retries="int",
)
FAILED = _row(
    **_KEY, invoice_state_json="string", error_type="string", error_message="string",
    retry_count="int", max_retries="int", next_retry_at="timestamp", status="string",
    created_at="timestamp", updated_at="timestamp",
)
METRICS = _row(
    job_id="long", total_records="long", processed_count="long", sent_count="long",
    escalated_count="long", failed_count="long",
)
INVOICE_STATE = _row(
    invoice=_row(
        invoice_no="string", client="string", amount="money", due_date="string",
        contact_email="string", followup_count="int",
    ),
    days_overdue="int",
    stage_key="string",
    stage_meta=_row(
        followup_number="int", tone="string", key_message="string", cta="string",
        escalation_required="boolean", subject_template="string",
    ),
    payment_link="string", escalation_required="boolean", retry_count="int", max_retries="int",
    validation_status="string", validation_feedback="string", send_status="string",
    send_error="string",
)

STAGE_COLUMNS = [
    "stage_key", "followup_number", "tone", "key_message", "cta", "escalation_required",
    "subject_template",
]


def stage_table(spark: SparkSession) -> DataFrame:
    """The six stages. A fixed six rows, so it is always safe to broadcast."""
    rows = [
        F.struct(
            *[
                F.lit(value).alias(name)
                for name, value in zip(STAGE_COLUMNS, (row[0], *row[3:]), strict=True)
            ]
        )
        for row in fv.STAGES
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))
