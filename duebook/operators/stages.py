"""Counts and order of stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_summary(staged: DataFrame, *by: str) -> DataFrame:
    """Invoices and amounts per stage."""
    return staged.groupBy(*by, "stage_key").agg(
        F.count("*").alias("invoices"), F.sum("amount").alias("total_amount")
    )
