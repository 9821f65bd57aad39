"""Number expressions: reading, formatting and rounding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from duebook import fixed_values as fv


def to_double(text: Column) -> Column:
    return text.try_cast("double")


def grouped_amount(amount: Column, digits: int) -> Column:
    """Thousands separated by commas, ties to even on the binary value."""
    return F.format_number(amount.cast("double"), digits)


def currency_text(amount: Column) -> Column:
    """Text that already names a currency passes through; a bare number becomes INR."""
    bare = F.btrim(amount.cast("string"), F.lit(fv.WHITE_SPACE))
    marked = reduce(
        lambda a, b: a | b, [bare.startswith(F.lit(prefix)) for prefix in fv.CURRENCY_PREFIXES]
    )
    return F.when(marked, bare).otherwise(
        F.concat(F.lit("INR "), grouped_amount(to_double(bare), 2))
    )


def currency_from_number(amount: Column) -> Column:
    return F.concat(F.lit("INR "), grouped_amount(amount, 2))


def rounded(value: Column, digits: int) -> Column:
    """Round as printing does: ties go by the binary value, not by the decimal text."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit("")).cast("double")


def percent(part: Column, whole: Column, digits: int) -> Column:
    """100 * part / whole, rounded; 0 for an empty whole."""
    ratio = part.cast("double") / F.nullif(whole, F.lit(0)).cast("double") * F.lit(100.0)
    return F.coalesce(rounded(ratio, digits), F.lit(0.0))


def mean_of(total: Column, count: Column, digits: int) -> Column:
    ratio = total.cast("double") / F.nullif(count, F.lit(0)).cast("double")
    return F.coalesce(rounded(ratio, digits), F.lit(0.0))


def count_or_zero(text: Column) -> Column:
    """Read a counter; anything unreadable is 0, fractions are cut."""
    number = to_double(text)
    return F.coalesce(F.when(F.isnan(number), F.lit(0.0)).otherwise(number), F.lit(0.0)).cast("long")


def live_progress(processed: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(
        F.least(processed.cast("double") / F.nullif(total, F.lit(0)).cast("double"), F.lit(1.0))
    )


def outcome_shares(total: Column, sent: Column, escalated: Column, failed: Column) -> dict[str, Column]:
    """Shares of one job's bar, in percent, and the invoices still to come."""
    done = sent + escalated + failed
    base = F.greatest(total, done, F.lit(1)).cast("double")
    shares = {
        name: rounded(part.cast("double") / base * 100.0, 2)
        for name, part in (
            ("sent_share", sent), ("escalated_share", escalated), ("failed_share", failed)
        )
    }
    return shares | {"remaining": F.greatest(total - done, F.lit(0))}
