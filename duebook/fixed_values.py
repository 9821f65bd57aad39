"""Values that are part of the contract: change one and results change."""

# ---------------------------------------------------------------------------
# Follow-up stages.
# stage_key, first day, last day (None = open), number, tone, key message,
# call to action, escalation, subject template
# ---------------------------------------------------------------------------
STAGES = [
    (
        "No_overdue", 0, 0, 0,
        "No Action Required",
        "Invoice is not overdue.",
        "No action required.",
        False,
        "",
    ),
    (
        "1st Follow-Up", 1, 7, 1,
        "Warm & Friendly",
        "This appears to be a friendly reminder in case the invoice was overlooked.",
        "Please complete the payment at your earliest convenience.",
        False,
        "Quick Reminder – Invoice #{invoice_no} | ₹{amount} Due",
    ),
    (
        "2nd Follow-Up", 8, 14, 2,
        "Polite but Firm",
        "The payment is still pending and we would appreciate an update.",
        "Please confirm your expected payment date.",
        False,
        "Payment Follow-Up – Invoice #{invoice_no} ({days_overdue} Days Overdue)",
    ),
    (
        "3rd Follow-Up", 15, 21, 3,
        "Formal & Serious",
        "The invoice remains unpaid and requires immediate attention.",
        "Please respond within 48 hours.",
        False,
        "IMPORTANT: Outstanding Payment – Invoice #{invoice_no} ({days_overdue} Days Overdue)",
    ),
    (
        "4th Follow-Up", 22, 30, 4,
        "Stern & Urgent",
        "This is a final reminder before escalation.",
        "Please make payment immediately or contact us.",
        False,
        "FINAL NOTICE – Invoice #{invoice_no} – Immediate Action Required",
    ),
    (
        "Escalation Flag", 31, None, 5,
        "Legal Review Required",
        "The case requires human review.",
        "Assign to finance manager.",
        True,
        "Escalation Required – Invoice #{invoice_no}",
    ),
]

# Names of the stages that are not client e-mails.
STAGE_NOT_OVERDUE = "No_overdue"
STAGE_ESCALATION = "Escalation Flag"

# Tones a draft may carry.
DRAFT_TONES = [
    "Warm & Friendly",
    "Polite but Firm",
    "Formal & Serious",
    "Stern & Urgent",
    "Legal Review Required",
]

# Columns an invoice file must have.
REQUIRED_COLUMNS = ["amount", "client_name", "due_date", "invoice_number", "recipient_email"]

# Lower-case error texts worth another try.
RETRYABLE_ERROR_TEXTS = [
    "429",
    "rate limit",
    "capacity exceeded",
    "service tier capacity exceeded",
    "timeout",
    "temporarily unavailable",
    "connection error",
    "maximum retry attempts",
]

# Prefixes that mark an amount as already formatted.
CURRENCY_PREFIXES = ["INR", "USD", "EUR", "GBP", "₹", "$", "€", "£"]

# Links, contacts, texts and limits.
PAYMENT_LINK_BASE = "https://pay.company.com/"
FINANCE_CONTACT = "finance@company.com"
NO_FEEDBACK = "None"
MAX_ATTEMPTS = 5
FIRST_WAIT_SECONDS = 2
MAX_REVISIONS = 3
MAX_QUEUE_RETRIES = 5
BACKOFF_CAP_MINUTES = 60
RETRY_BATCH = 100
BATCH_SIZE = 10
ESCALATION_AFTER_DAYS = 30

# Feedback and error texts.
TEXT_NO_DRAFT = "No email draft generated."
TEXT_WRONG_RECIPIENT = "Recipient email does not match invoice contact email."
TEXT_WRONG_TONE = "Tone must be exactly '{tone}'."
TEXT_WRONG_SUBJECT = "Subject must be exactly: '{subject}'"
TEXT_MISSING_VALUE = "Email must include: {value}"
TEXT_NOT_OVERDUE = "Invoice is not overdue."
TEXT_ESCALATED_DAYS = "{days} days overdue — flagged for legal/finance review"
TEXT_ESCALATED_DRAFT = "Email validation failed after {n} retries — manual review required"
TEXT_ATTEMPTS_SPENT = "Maximum retry attempts ({n}) exceeded."
TEXT_UNKNOWN_ERROR = "Unknown processing error."
TEXT_NOTHING_TO_SEND = "No email draft available to send."
TEXT_SEND_FAILED = "Send failed via {provider}: {message}"
TEXT_TONE_UNSPECIFIED = "Unspecified"

# Accepted status names.
JOB_STATUSES = ["queued", "running", "completed", "failed"]
QUEUE_STATUSES = ["pending", "retried", "resolved", "permanent_failure"]

# Characters counted as white space when text is stripped.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
