"""Raw invoice rows to typed, staged invoices."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duebook import fixed_values as fv
from duebook.functions.dates import days_overdue, parse_due_date
from duebook.functions.money import to_double
from duebook.functions.text import is_blank, strip
from duebook.schemas import MONEY, stage_table


def normalize_invoices(raw: DataFrame, date_mode: str = "dayfirst") -> DataFrame:
    """Rename, type and default the columns of raw invoices.

    ``due_date`` may be text or already a date; ``amount`` text or a number. A missing ``job_id``
    becomes 0.
    """
    due_is_date = isinstance(raw.schema["due_date"].dataType, T.DateType)
    amount_is_text = isinstance(raw.schema["amount"].dataType, T.StringType)
    due = F.col("due_date") if due_is_date else parse_due_date(F.col("due_date"), date_mode)
    amount = to_double(strip(F.col("amount"))) if amount_is_text else F.col("amount").cast("double")
    money = (strip(F.col("amount")) if amount_is_text else F.col("amount")).try_cast(MONEY)
    job_id = F.col("job_id").cast("long") if "job_id" in raw.columns else F.lit(0).cast("long")
    kept = [c for c in raw.columns if c not in {*fv.REQUIRED_COLUMNS, "job_id"}]
    read = [money.alias("amount"), amount.alias("amount_raw"), due.alias("due_date")]
    if not due_is_date:
        # Out of inline, so that filters on the results do not read every date and amount again.
        read = [F.inline(F.array(F.struct(*read)))]
    rows = raw.select(
        job_id.alias("job_id"),
        F.col("invoice_number").cast("string").alias("invoice_no"),
        F.col("client_name").alias("client"),
        F.col("due_date").cast("string").alias("due_date_text"),
        F.col("recipient_email").alias("contact_email"),
        *kept,
        *read,
    )
    return rows.select(
        "job_id",
        "invoice_no",
        "client",
        "amount",
        "amount_raw",
        "due_date_text",
        "due_date",
        "contact_email",
        F.lit(1).alias("followup_count"),
        F.lit(0).alias("retry_count"),
        F.lit(fv.MAX_REVISIONS).alias("max_retries"),
        *kept,
    )


def stage_for(days: Column) -> Column:
    """Stage name for a number of days overdue."""
    stage = F.when(days <= 0, F.lit(fv.STAGE_NOT_OVERDUE))
    for name, first, last, *_ in fv.STAGES[1:]:
        stage = stage.when(days >= first if last is None else days.between(first, last), F.lit(name))
    return stage


def stage_invoices(invoices: DataFrame, as_of: Column) -> DataFrame:
    """Add days overdue, stage name and the stage's wording."""
    staged = invoices.withColumn("days_overdue", days_overdue(F.col("due_date"), as_of))
    staged = staged.withColumn("stage_key", stage_for(F.col("days_overdue")))
    return staged.join(F.broadcast(stage_table(invoices.sparkSession)), "stage_key", "left")


def faults() -> Column:
    """Names of everything wrong with a normalized row, as an array. Nulls are only cut out of it where something is wrong."""
    def blank(name: str) -> Column:
        return is_blank(F.col(name))

    wrong = {
        "missing invoice_no": blank("invoice_no"),
        "missing client": blank("client"),
        "missing contact_email": blank("contact_email"),
        "unreadable amount": F.col("amount_raw").isNull() | F.isnan("amount_raw") | F.col("amount").isNull(),
        "missing due_date": blank("due_date_text"),
        "unreadable due_date": ~blank("due_date_text") & F.col("due_date").isNull(),
    }
    found = F.array_compact(F.array(*[F.when(is_wrong, F.lit(name)) for name, is_wrong in wrong.items()]))
    return F.when(reduce(or_, wrong.values()), found).otherwise(F.array().cast("array<string>"))


def with_faults(invoices: DataFrame) -> DataFrame:
    return invoices.withColumn("faults", faults())


def split_faulty(
    invoices: DataFrame, on_bad_date: str = "quarantine"
) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with ``faults``).

    ``on_bad_date='fail'`` counts unreadable due dates first and stops the job if there are any.
    """
    return split_marked(with_faults(invoices), on_bad_date)


def split_marked(marked: DataFrame, on_bad_date: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """The same of rows that have their ``faults``."""
    if on_bad_date not in ("quarantine", "fail"):
        raise ValueError("on_bad_date must be 'quarantine' or 'fail'")
    if on_bad_date == "fail":
        bad = marked.agg(F.count_if(F.col("due_date").isNull())).first()[0]
        if bad:
            raise ValueError(f"{bad} invoices have an unreadable due date")
    good = marked.filter(F.size("faults") == 0).drop("faults")
    return good, marked.filter(F.size("faults") > 0)


def duplicate_invoices(invoices: DataFrame) -> DataFrame:
    """Invoice numbers used more than once in a job."""
    return (
        invoices.groupBy("job_id", "invoice_no")
        .agg(F.count("*").alias("copies"))
        .filter(F.col("copies") > 1)
    )
