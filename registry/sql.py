"""Common table expressions for the comparison SQL, written for DuckDB.

``oracle(select)`` puts in front of a SELECT the expressions it names, directly or through others.
"""

from __future__ import annotations

import re

from duebook import fixed_values as fv
from duebook.operators.drafts import DRAFT_CLOSING, DRAFT_TEXTS, PROMPTS
from duebook.sources.star import AS_OF, ERROR_TEXTS, JOBS, NOW


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


# The contract's texts, written out here so that a slip in the library shows.
RETRYABLE_TEXTS = [
    "429", "rate limit", "capacity exceeded", "service tier capacity exceeded", "timeout",
    "temporarily unavailable", "connection error", "maximum retry attempts",
]
EMAIL_ADDRESS = r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@([A-Za-z0-9-]+\.)+[A-Za-z]{2,}$"
NO_DRAFT = "No email draft generated."
WRONG_RECIPIENT = "Recipient email does not match invoice contact email."
WRONG_TONE = "Tone must be exactly '{tone}'."
WRONG_SUBJECT = "Subject must be exactly: '{subject}'"
MISSING_VALUE = "Email must include: {value}"
NOT_OVERDUE = "Invoice is not overdue."
ESCALATED_DAYS = "{days} days overdue — flagged for legal/finance review"
ESCALATED_DRAFT = "Email validation failed after {n} retries — manual review required"
NOTHING_TO_SEND = "No email draft available to send."
SEND_FAILED = "Send failed via {provider}: {message}"
TONES = ["Warm & Friendly", "Polite but Firm", "Formal & Serious", "Stern & Urgent", "Legal Review Required"]

DAY = f"DATE '{AS_OF}'"
TIME = f"TIMESTAMP '{NOW}'"
SPACE = "(" + " || ".join(
    f"chr({ord(c)})" if ord(c) != 32 else "' '" for c in fv.WHITE_SPACE
) + ")"


def stripped(value: str) -> str:
    return f"trim({value}, {SPACE})"


def masked(email: str) -> str:
    local = f"split_part({email}, '@', 1)"
    domain = f"substr({email}, instr({email}, '@') + 1)"
    return (
        f"CASE WHEN {email} IS NULL OR instr({email}, '@') = 0 THEN '' "
        f"WHEN length({local}) = 0 THEN '*@' || {domain} "
        f"WHEN length({local}) <= 2 THEN left({local}, 1) || '*@' || {domain} "
        f"ELSE left({local}, 2) || repeat('*', length({local}) - 2) || '@' || {domain} END"
    )


def retryable(message: str) -> str:
    low = f"lower(coalesce({message}, ''))"
    return "(" + " OR ".join(f"contains({low}, {text(t)})" for t in RETRYABLE_TEXTS) + ")"


def filled(template: str, **values: str) -> str:
    """Nested replace over a template; the values come from the data and hold no placeholders."""
    expression = text(template)
    for name, value in values.items():
        expression = f"replace({expression}, '{{{name}}}', {value})"
    return expression


def two_digits(value: str, digits: int = 2) -> str:
    return f"CAST(format('{{:.{digits}f}}', CAST({value} AS DOUBLE)) AS DOUBLE)"


def percent(part: str, whole: str, digits: int) -> str:
    return (
        f"CASE WHEN coalesce({whole}, 0) = 0 THEN 0.0 ELSE "
        + two_digits(f"({part})::DOUBLE / ({whole})::DOUBLE * 100.0", digits)
        + " END"
    )


def backoff(count: str) -> str:
    return f"to_minutes(CAST(least(60, pow(2, least({count}, 30))) AS INTEGER))"


_stage_rows = ",\n".join(
    "(" + ", ".join(
        [
            text(s[0]), str(s[1]), "1000000" if s[2] is None else str(s[2]), str(s[3]),
            text(s[4]), text(s[5]), text(s[6]), str(s[7]).lower(), text(s[8]),
        ]
    ) + ")"
    for s in fv.STAGES
)
_errors = "[" + ", ".join(text(t) for t in ERROR_TEXTS) + "]"
_input_names = {
    "client_name": "client", "recipient_email": "contact_email", "invoice_id": "invoice_no",
    "amount": "amount_text", "due_date": "due_date_text",
    "days_overdue": "CAST(days_overdue AS VARCHAR)", "stage": "stage_key", "tone": "tone",
    "key_message": "key_message", "cta": "cta", "payment_link": "payment_link",
    "finance_contact": text(fv.FINANCE_CONTACT), "validation_feedback": text(fv.NO_FEEDBACK),
    "subject": "expected_subject",
}


def by_stage(part: int) -> str:
    return "CASE stage_key " + " ".join(
        f"WHEN {text(stage)} THEN {filled(texts[part], **_input_names)}"
        for stage, texts in DRAFT_TEXTS.items()
    ) + " END"


def staged_from(name: str) -> str:
    return f"""
    SELECT b.*, CAST(b.due_date AS VARCHAR) AS due_date_text, s.* EXCLUDE (first_day, last_day),
      'https://pay.company.com/' || b.invoice_no AS payment_link,
      'INR ' || format('{{:,.2f}}', b.amount_raw) AS amount_text,
      replace(replace(replace(s.subject_template, '{{amount}}', format('{{:,.0f}}', b.amount_raw)),
        '{{days_overdue}}', CAST(b.days_overdue AS VARCHAR)), '{{invoice_no}}', b.invoice_no) AS expected_subject,
      CASE WHEN b.days_overdue = 0 THEN 'no_overdue' WHEN s.escalation_required THEN 'escalation'
        ELSE 'draft' END AS route,
      0 AS retry_count, 3 AS max_retries, 1 AS followup_count
    FROM (SELECT *, CAST(greatest(date_diff('day', due_date, {DAY}), 0) AS INTEGER) AS days_overdue
      FROM {name}) b
    JOIN stages s ON b.days_overdue BETWEEN s.first_day AND s.last_day"""


def record_fault(d: str) -> str:
    names = ["recipient", "subject", "greeting", "body", "closing", "tone"]
    missing = " ".join(f"WHEN {d}.{n} IS NULL THEN '{n}'" for n in names)
    tones = ", ".join(text(t) for t in TONES)
    return (
        f"CASE {missing} WHEN NOT regexp_matches({stripped(d + '.recipient')}, {text(EMAIL_ADDRESS)}) "
        f"THEN 'recipient' WHEN {d}.tone NOT IN ({tones}) THEN 'tone' END"
    )


def first_missing(d: str, s: str, strict: bool = False) -> str:
    whole = f"concat_ws(' ', {d}.greeting, {d}.body, {d}.closing)"
    values = [f"{s}.client", f"{s}.invoice_no", f"CAST({s}.days_overdue AS VARCHAR)", f"{s}.payment_link"]

    def has(value: str) -> str:
        if not strict:
            return f"contains({whole}, {value})"
        words = [f"' ' || regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]', ' ', 'g') || ' '" for x in (whole, value)]
        return f"contains({words[0]}, {words[1]})"

    return "CASE " + " ".join(f"WHEN NOT {has(v)} THEN {v}" for v in values) + " END"


def rulings(strict: bool = False) -> str:
    empty = " AND ".join(
        f"d.{n} IS NULL" for n in ("recipient", "subject", "greeting", "body", "closing", "tone")
    )
    return f"""
    SELECT job_id, invoice_no, revision,
      CASE rule WHEN 0 THEN 'approved' WHEN 6 THEN 'invalid' ELSE 'rejected' END AS status, rule,
      CASE rule WHEN 0 THEN '' WHEN 1 THEN {text(NO_DRAFT)}
        WHEN 2 THEN {text(WRONG_RECIPIENT)}
        WHEN 3 THEN {filled(WRONG_TONE, tone='stage_tone')}
        WHEN 4 THEN {filled(WRONG_SUBJECT, subject='expected_subject')}
        WHEN 5 THEN {filled(MISSING_VALUE, value='missing')}
        ELSE 'Draft record is not valid: ' || fault END AS feedback
    FROM (
      SELECT s.job_id, s.invoice_no, d.revision, s.tone AS stage_tone, s.expected_subject, d.fault, d.missing,
        CASE WHEN {empty} THEN 1 WHEN d.fault IS NOT NULL THEN 6
          WHEN lower({stripped('d.recipient')}) IS DISTINCT FROM lower({stripped('s.contact_email')}) THEN 2
          WHEN {stripped('d.tone')} <> s.tone THEN 3
          WHEN {stripped('d.subject')} <> {stripped('s.expected_subject')} THEN 4
          WHEN d.missing IS NOT NULL THEN 5 ELSE 0 END AS rule
      FROM (SELECT * FROM staged WHERE route = 'draft') s
      LEFT JOIN (SELECT d.*, {record_fault('d')} AS fault, {first_missing('d', 'i', strict)} AS missing
        FROM drafts d JOIN staged i ON i.job_id = d.job_id AND i.invoice_no = d.invoice_no) d
      ON d.job_id = s.job_id AND d.invoice_no = s.invoice_no)"""


_invoice_base = f"""
    SELECT o.o_orderkey, o.o_custkey % {JOBS} AS job_id, 'INV-' || o.o_orderkey AS invoice_no,
      c.c_name AS client, lower(replace(c.c_name, '#', '.')) || '@example.com' AS contact_email,
      CAST(o.o_totalprice AS DECIMAL(18,2)) AS amount, o.o_totalprice AS amount_raw,
      {{due}} AS due_date
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""

_text_date = f"""CASE o_orderkey % 7
      WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y')
      WHEN 2 THEN strftime(o_orderdate, '%-d %b %Y') WHEN 3 THEN strftime(o_orderdate, '%B %-d, %Y')
      WHEN 4 THEN strftime(o_orderdate, '%Y%m%d') WHEN 5 THEN strftime(o_orderdate, '%d.%m.%Y')
      ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'not a date' END END"""


def parsed_date(value: str, day_first: bool = True) -> str:
    """First format that fits; ``kind`` 0 and 4 are the year-first notations."""
    year_first = ["%Y-%d-%m", "%Y-%m-%d"] if day_first else ["%Y-%m-%d", "%Y-%d-%m"]
    compact = ["%Y%d%m", "%Y%m%d"] if day_first else ["%Y%m%d", "%Y%d%m"]
    tries = {
        r"^\d{4}-\d{1,2}-\d{1,2}$": year_first,
        r"^\d{8}$": compact,
        r"^\d{1,2}/\d{1,2}/\d{4}$": ["%d/%m/%Y", "%m/%d/%Y"],
        r"^\d{1,2}\.\d{1,2}\.\d{4}$": ["%d.%m.%Y", "%m.%d.%Y"],
        r"^\d{1,2} [A-Za-z]+ \d{4}$": ["%d %b %Y", "%d %B %Y"],
        r"^[A-Za-z]+ \d{1,2}, \d{4}$": ["%b %d, %Y", "%B %d, %Y"],
    }
    cases = " ".join(
        f"WHEN regexp_matches({value}, '{shape}') THEN CAST(try_strptime({value}, "
        + "[" + ", ".join(text(f) for f in formats) + "]) AS DATE)"
        for shape, formats in tries.items()
    )
    return f"CASE {cases} END"


_wording = {
    "not_overdue": text(NOT_OVERDUE),
    "late": filled(ESCALATED_DAYS, days="CAST(days_overdue AS VARCHAR)"),
    "spent": filled(ESCALATED_DRAFT, n="CAST(rejections AS VARCHAR)"),
    "send": filled(SEND_FAILED, provider="'mailer'", message="send_message"),
}

#: Error text of a send that the provider refused.
SEND_ERROR = _wording["send"]

CTES: dict[str, str] = {
    "stages": f"""
    SELECT * FROM (VALUES {_stage_rows}) AS t(stage_key, first_day, last_day, followup_number, tone,
      key_message, cta, escalation_required, subject_template)""",
    "natural_invoices": _invoice_base.format(due="CAST(o.o_orderdate AS DATE)"),
    "balanced_invoices": _invoice_base.format(
        due=f"{DAY} - CAST(o.o_orderkey % 45 - 5 AS INTEGER)"
    ),
    "staged_natural": staged_from("natural_invoices"),
    "staged": staged_from("balanced_invoices"),
    "text_invoices": f"""
    SELECT o_orderkey, o_custkey % {JOBS} AS job_id, 'INV-' || o_orderkey AS invoice_no,
      CASE WHEN o_orderkey % 19 <> 4 THEN c_name ELSE '  ' END AS client,
      CASE WHEN o_orderkey % 23 <> 5 THEN lower(replace(c_name, '#', '.')) || '@example.com' END AS contact_email,
      CASE WHEN o_orderkey % 17 = 3 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS amount_text,
      {_text_date} AS due_text
    FROM orders JOIN customer ON o_custkey = c_custkey""",
    "faulted": f"""
    SELECT *, concat_ws(', ',
        CASE WHEN coalesce(trim(client), '') = '' THEN 'missing client' END,
        CASE WHEN contact_email IS NULL THEN 'missing contact_email' END,
        CASE WHEN try_cast(amount_text AS DOUBLE) IS NULL THEN 'unreadable amount' END,
        CASE WHEN due_text IS NULL THEN 'missing due_date' WHEN due_date IS NULL THEN 'unreadable due_date' END
      ) AS faults
    FROM (SELECT *, {parsed_date('due_text')} AS due_date FROM text_invoices)""",
    "ready": f"""
    SELECT o_orderkey, job_id, invoice_no, client, tone AS stage_tone, contact_email AS recipient,
      expected_subject AS subject, {by_stage(0)} AS greeting, {by_stage(1)} AS body,
      {text(DRAFT_CLOSING)} AS closing, tone
    FROM staged WHERE route = 'draft'""",
    "drafts": f"""
    SELECT job_id, invoice_no, CAST(revision AS INTEGER) AS revision,
      CASE WHEN fault = 1 THEN NULL WHEN fault = 2 THEN 'someone.else@example.com' ELSE recipient END AS recipient,
      CASE WHEN fault = 1 THEN NULL WHEN fault = 4 THEN 'Re: ' || subject ELSE subject END AS subject,
      CASE WHEN fault = 1 THEN NULL WHEN fault = 5 THEN 'Hello,' ELSE greeting END AS greeting,
      CASE WHEN fault = 1 THEN NULL WHEN fault = 6 THEN
        replace(body, 'https://pay.company.com/' || invoice_no, 'our payment page') ELSE body END AS body,
      CASE WHEN fault = 1 THEN NULL ELSE closing END AS closing,
      CASE WHEN fault = 1 THEN NULL WHEN fault = 7 THEN 'Cheerful' WHEN fault = 3 THEN
        CASE WHEN stage_tone = 'Warm & Friendly' THEN 'Stern & Urgent' ELSE 'Warm & Friendly' END
        ELSE tone END AS tone
    FROM (SELECT *, CASE WHEN revision < (o_orderkey // 16) % 4 THEN o_orderkey % 8 ELSE 0 END AS fault
      FROM (SELECT *, unnest(range(0, (o_orderkey // 64) % 4 + 1)) AS revision FROM ready))""",
    "rulings": rulings(),
    "attempts": f"""
    SELECT user_id % {JOBS} AS job_id, 'INV-' || user_id AS invoice_no, CAST(place - 1 AS INTEGER) AS attempt,
      CASE WHEN event_type IN ('error', 'click', 'view') THEN {_errors}[event_id % 10 + 1] END AS error_message
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events)""",
    "attempt_fold": f"""
    SELECT job_id, invoice_no,
      CASE WHEN ending IS NULL THEN 'in_flight' WHEN error_message IS NULL THEN 'succeeded' ELSE 'failed' END AS attempt_state,
      CASE WHEN ending IS NOT NULL AND error_message IS NOT NULL THEN
        CASE WHEN {retryable('error_message')} THEN 'Maximum retry attempts (5) exceeded.' ELSE error_message END
      END AS attempt_error,
      CAST(coalesce(ending, newest) + 1 AS INTEGER) AS attempts_used,
      CAST(2 * (pow(2, coalesce(ending, newest)) - 1) AS BIGINT) AS waited_seconds
    FROM (SELECT k.*, a.error_message FROM (
        SELECT job_id, invoice_no, max(attempt) AS newest,
          min(attempt) FILTER (WHERE error_message IS NULL OR NOT {retryable('error_message')} OR attempt = 4) AS ending
        FROM attempts WHERE attempt < 5 GROUP BY ALL) k
      LEFT JOIN attempts a ON a.job_id = k.job_id AND a.invoice_no = k.invoice_no AND a.attempt = k.ending)""",
    "send_results": f"""
    SELECT o_custkey % {JOBS} AS job_id, 'INV-' || o_orderkey AS invoice_no, o_orderkey % 11 <> 0 AS success,
      CASE WHEN o_orderkey % 11 <> 0 THEN 'accepted' WHEN o_orderkey % 2 = 0 THEN 'HTTP 503: temporarily unavailable'
        ELSE 'HTTP 400: bad request' END AS send_message
    FROM orders""",
    "fold": """
    SELECT s.job_id, s.invoice_no, count(*) FILTER (WHERE r.rule = 0 OR r.rule = 6) > 0 AS settled,
      count(r.revision) AS seen, min(r.revision) FILTER (WHERE r.rule = 0 OR r.rule = 6) AS stop
    FROM (SELECT * FROM staged WHERE route = 'draft') s
    LEFT JOIN rulings r ON r.job_id = s.job_id AND r.invoice_no = s.invoice_no AND r.revision < 3
    GROUP BY ALL""",
    "revision_fold": """
    SELECT f.job_id, f.invoice_no,
      CASE WHEN f.settled AND r.rule = 0 THEN 'approved' WHEN f.settled THEN 'invalid'
        WHEN f.seen >= 3 THEN 'exhausted' ELSE 'awaiting_draft' END AS draft_state,
      CAST(coalesce(f.stop, f.seen) AS INTEGER) AS rejections,
      coalesce(r.feedback, '') AS draft_feedback, r.rule AS draft_rule,
      coalesce(f.stop, f.seen - 1) AS last_revision
    FROM fold f LEFT JOIN rulings r ON r.job_id = f.job_id AND r.invoice_no = f.invoice_no
      AND r.revision = coalesce(f.stop, f.seen - 1)""",
    "outcomes": f"""
    SELECT job_id, invoice_no, client, amount, due_date_text, contact_email, followup_count, days_overdue, stage_key,
      outcome IN ('escalated_stage', 'escalated_draft') AS escalation_required, followup_number, tone, key_message, cta,
      subject_template, CASE WHEN route = 'draft' THEN payment_link ELSE '' END AS payment_link,
      CASE WHEN outcome <> 'attempt_failed' THEN d_recipient END AS d_recipient,
      CASE WHEN outcome <> 'attempt_failed' THEN d_subject END AS d_subject,
      CASE WHEN outcome <> 'attempt_failed' THEN d_tone END AS d_tone,
      d_greeting, d_body, d_closing,
      CASE WHEN outcome IN ('not_overdue', 'sent', 'send_failed') THEN 'approved'
        WHEN outcome = 'escalated_draft' THEN 'rejected' END AS validation_status,
      CASE WHEN outcome = 'not_overdue' THEN {_wording['not_overdue']}
        WHEN outcome = 'escalated_draft' THEN draft_feedback ELSE '' END AS validation_feedback,
      CASE WHEN outcome = 'sent' THEN 'sent' WHEN outcome IN ('attempt_failed', 'send_failed') THEN 'failed'
        WHEN outcome = 'awaiting_draft' THEN 'pending' ELSE 'not_sent' END AS send_status,
      CASE outcome WHEN 'not_overdue' THEN {_wording['not_overdue']} WHEN 'escalated_stage' THEN {_wording['late']}
        WHEN 'escalated_draft' THEN {_wording['spent']} WHEN 'attempt_failed' THEN draft_feedback
        WHEN 'send_failed' THEN {_wording['send']} ELSE '' END AS send_error,
      CAST(CASE WHEN outcome IN ('sent', 'send_failed', 'escalated_draft') THEN rejections ELSE 0 END AS INTEGER) AS retry_count,
      CASE WHEN outcome = 'attempt_failed' THEN 5 ELSE 3 END AS max_retries, route, outcome, o_orderkey
    FROM (
      SELECT s.*, f.rejections, f.draft_feedback, d.recipient AS d_recipient, d.subject AS d_subject, d.tone AS d_tone,
        d.greeting AS d_greeting, d.body AS d_body, d.closing AS d_closing, x.send_message,
        CASE s.route WHEN 'no_overdue' THEN 'not_overdue' WHEN 'escalation' THEN 'escalated_stage' ELSE
          CASE f.draft_state WHEN 'invalid' THEN 'attempt_failed' WHEN 'awaiting_draft' THEN 'awaiting_draft'
            WHEN 'exhausted' THEN 'escalated_draft' ELSE CASE WHEN x.success THEN 'sent' ELSE 'send_failed' END END
        END AS outcome
      FROM staged s
      LEFT JOIN revision_fold f ON f.job_id = s.job_id AND f.invoice_no = s.invoice_no
      LEFT JOIN drafts d ON d.job_id = s.job_id AND d.invoice_no = s.invoice_no AND d.revision = f.last_revision
      LEFT JOIN send_results x ON x.job_id = s.job_id AND x.invoice_no = s.invoice_no)""",
    "audit": f"""
    SELECT job_id, {TIME} + to_seconds(o_orderkey) AS created_at, invoice_no, client, amount, due_date_text AS due_date,
      {masked('contact_email')} AS contact_email_masked, followup_count, days_overdue, stage_key, escalation_required,
      followup_number, key_message, cta, payment_link, {masked('d_recipient')} AS recipient,
      coalesce(d_subject, '') AS subject, coalesce(d_tone, tone) AS tone_used, validation_status, validation_feedback,
      send_status, send_error AS error_message, retry_count, max_retries
    FROM outcomes WHERE outcome NOT IN ('attempt_failed', 'awaiting_draft')""",
    "metrics": f"""
    SELECT *, processed_count - failed_count AS successful_count,
      {percent('processed_count - failed_count', 'processed_count', 2)} AS success_rate,
      {percent('failed_count', 'processed_count', 2)} AS failure_rate,
      {percent('escalated_count', 'processed_count', 2)} AS escalation_rate,
      {two_digits('total_retries::DOUBLE / processed_count')} AS average_retries
    FROM (SELECT job_id, count(*) AS total_records, count(*) FILTER (WHERE send_status <> 'pending') AS processed_count,
        count(*) FILTER (WHERE send_status = 'sent') AS sent_count,
        count(*) FILTER (WHERE send_status = 'not_sent' AND escalation_required) AS escalated_count,
        count(*) FILTER (WHERE send_status = 'failed') AS failed_count, count(*) FILTER (WHERE send_status = 'not_sent') AS not_sent_count,
        CAST(sum(retry_count) AS BIGINT) AS total_retries
      FROM outcomes GROUP BY job_id)""",
    "job_events": """
    SELECT o_orderkey AS job_id, CAST(seq AS BIGINT) AS seq,
      CASE seq WHEN 0 THEN 'queued' WHEN 1 THEN 'running' ELSE CASE o_orderkey % 4 WHEN 3 THEN 'failed' ELSE 'completed' END END AS status,
      CAST(o_orderdate AS TIMESTAMP) + CASE seq WHEN 0 THEN INTERVAL 0 MINUTE WHEN 1 THEN INTERVAL 1 MINUTE ELSE INTERVAL 5 MINUTE END AS "at",
      CASE WHEN seq = 2 AND o_orderkey % 4 = 3 THEN 'worker stopped' END AS error_message,
      CASE WHEN seq = 0 THEN '/uploads/' || o_custkey || '.csv' END AS file_path,
      CASE WHEN seq = 0 THEN sha256(CAST(o_custkey AS VARCHAR)) END AS file_hash
    FROM orders, (VALUES (0), (1), (2)) s(seq)
    WHERE seq = 0 OR (seq = 1 AND o_orderkey % 4 >= 1) OR (seq = 2 AND o_orderkey % 4 >= 2)""",
    "jobs": """
    SELECT job_id AS id, max(file_path) AS file_path, max(file_hash) AS file_hash, arg_max(status, seq) AS status,
      0::BIGINT AS total_records, 0::BIGINT AS processed_count, 0::BIGINT AS sent_count, 0::BIGINT AS escalated_count,
      0::BIGINT AS failed_count, min("at") AS created_at, max("at") FILTER (WHERE status = 'running') AS started_at,
      max("at") FILTER (WHERE status IN ('completed', 'failed')) AS completed_at, max(error_message) AS error_message
    FROM job_events GROUP BY job_id""",
    "queue": f"""
    SELECT job_id, invoice_no, o_orderkey, CASE WHEN o_orderkey % 10 < 8 THEN 'retryable' ELSE 'permanent' END AS error_type,
      {_errors}[o_orderkey % 10 + 1] AS error_message, CAST(o_orderkey % 7 AS INTEGER) AS retry_count,
      CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 5 END AS max_retries,
      CASE WHEN o_orderkey % 9 <> 8 THEN {TIME} + to_minutes(o_orderkey % 61 - 30) END AS next_retry_at,
      CASE o_orderkey % 9 WHEN 7 THEN 'resolved' WHEN 8 THEN 'permanent_failure' ELSE 'pending' END AS status,
      {TIME} - to_seconds(o_orderkey % 100000) - INTERVAL 1 DAY AS created_at,
      {TIME} - to_seconds(o_orderkey % 100000) AS updated_at,
      CASE o_orderkey % 29 WHEN 1 THEN 'broken' WHEN 2 THEN 'headless' ELSE 'whole' END AS payload
    FROM staged""",
}


def oracle(select: str) -> str:
    """A SELECT with the common table expressions it needs."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name, body in CTES.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql, re.IGNORECASE):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(select)
    if not needed:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + "\n" + select


PROMPT_SQL = " UNION ALL ".join(
    f"SELECT job_id, invoice_no, {text(version)} AS version, {text(system)} AS system_text, "
    + ("CAST(NULL AS VARCHAR)" if human is None else filled(human, **_input_names))
    + " AS human_text FROM staged"
    for version, (system, human) in PROMPTS.items()
)
INPUT_SQL = ", ".join(f"{value} AS {name}" for name, value in _input_names.items())
