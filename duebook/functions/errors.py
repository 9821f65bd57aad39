"""Error classes and waiting times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from duebook import fixed_values as fv


#: Twice two to this power is the largest power of two that a long holds.
LAST_DOUBLING = 61


def is_retryable(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return reduce(lambda a, b: a | b, [low.contains(F.lit(t)) for t in fv.RETRYABLE_ERROR_TEXTS])


def error_class(message: Column) -> Column:
    return F.when(is_retryable(message), F.lit("retryable")).otherwise(F.lit("permanent"))


def backoff_minutes(retry_count: Column, cap: int = fv.BACKOFF_CAP_MINUTES) -> Column:
    """min(cap, 2^n) minutes; n is held at 30 first so the power stays small."""
    power = F.pow(F.lit(2.0), F.least(retry_count, F.lit(30)))
    return F.least(F.lit(float(cap)), power).cast("int")


def next_retry_at(now: Column, retry_count: Column, cap: int = fv.BACKOFF_CAP_MINUTES) -> Column:
    return now + F.make_dt_interval(F.lit(0), F.lit(0), backoff_minutes(retry_count, cap))


def wait_before_retry(attempt: Column, first: int = fv.FIRST_WAIT_SECONDS) -> Column:
    """Seconds to wait after failed attempt ``attempt`` (0-based); no more than fit a long from the 62nd on."""
    return (F.lit(float(first)) * F.pow(F.lit(2.0), F.least(attempt, F.lit(LAST_DOUBLING)))).cast("long")


def waited_until(attempt: Column, first: int = fv.FIRST_WAIT_SECONDS) -> Column:
    """Seconds waited in all before attempt ``attempt`` (0-based) starts; the doubling ends with the 62nd."""
    return (F.lit(float(first)) * (F.pow(F.lit(2.0), F.least(attempt, F.lit(LAST_DOUBLING))) - 1)).cast("long")
