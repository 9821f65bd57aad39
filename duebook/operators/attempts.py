"""Fold over processing attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook import fixed_values as fv
from duebook.functions.errors import is_retryable, waited_until
from duebook.operators.hot_keys import HotKeys, spread_join
from duebook.operators.validation import KEY


def fold_attempts(attempts: DataFrame, limit: int = fv.MAX_ATTEMPTS) -> DataFrame:
    """One row per invoice: how its attempts 0, 1, ... ended.

    A success (no error) or an error not worth another try ends it; so does the last attempt
    allowed. ``attempt_state`` is succeeded, failed or in_flight.
    """
    tried = attempts.filter(F.col("attempt") < limit)
    error = F.col("error_message")
    ends = error.isNull() | ~is_retryable(error) | (F.col("attempt") == limit - 1)
    folded = tried.groupBy(*KEY).agg(
        F.min(F.when(ends, F.struct("attempt", "error_message"))).alias("_end"),
        F.max("attempt").alias("_last"),
    )
    ended = F.col("_end.error_message")
    spent = is_retryable(ended)
    spent_text = fv.TEXT_ATTEMPTS_SPENT.replace("{n}", str(limit))
    used = F.coalesce(F.col("_end.attempt"), F.col("_last"))
    return folded.select(
        *KEY,
        F.when(F.col("_end").isNull(), F.lit("in_flight"))
        .when(ended.isNull(), F.lit("succeeded"))
        .otherwise(F.lit("failed"))
        .alias("attempt_state"),
        F.when(ended.isNotNull(), F.when(spent, F.lit(spent_text)).otherwise(ended)).alias(
            "attempt_error"
        ),
        (used + 1).alias("attempts_used"),
        waited_until(used).alias("waited_seconds"),
    )


def resolve_attempts(
    invoices: DataFrame,
    attempts: DataFrame,
    limit: int = fv.MAX_ATTEMPTS,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Give every invoice its attempt outcome; one never attempted has failed."""
    joined = spread_join(invoices, fold_attempts(attempts, limit), KEY, hot)
    never = F.col("attempt_state").isNull()
    return joined.withColumns(
        {
            "attempt_state": F.when(never, F.lit("failed")).otherwise(F.col("attempt_state")),
            "attempt_error": F.when(never, F.lit(fv.TEXT_UNKNOWN_ERROR)).otherwise(
                F.col("attempt_error")
            ),
            "attempts_used": F.coalesce("attempts_used", F.lit(0)),
            "waited_seconds": F.coalesce("waited_seconds", F.lit(0).cast("long")),
        }
    )
