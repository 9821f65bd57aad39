"""Running totals inside keys, however many of the rows one key holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duebook.llm.scratch import Scratch


def running(
    rows: DataFrame, key: list[str], order: list[str], totals: dict[str, tuple[str, Column]], scratch: Scratch, name: str
) -> DataFrame:
    """The rows with, for each of ``totals`` (an aggregate's name and its column), the total of the rows before them.

    ``key`` and ``order`` together have to tell every row apart and ``key`` must not be null. Rows are
    sorted into ranges of about one size and stored; inside a range a window adds up, and what the ranges
    before hold of the key is added from one row per range and key. So no task gets more than a range.
    Nulls come first in the order; before the first row of a key a total is 0.
    """
    sort = [*key, *order]
    stored = scratch.put(
        rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_slot", F.monotonically_increasing_id()), name
    ).withColumn("_range", F.shiftright("_slot", 33))
    group = [*key, "_range"]
    of_range = {n: getattr(F, kind)(column) for n, (kind, column) in totals.items()}
    runs = stored.groupBy(*group).agg(*(c.alias(f"_of_{n}") for n, c in of_range.items()))
    earlier = W.partitionBy(*key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(*group).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    before = {
        n: F.coalesce(getattr(F, kind)(f"_of_{n}").over(earlier), F.lit(0)).alias(f"_of_{n}") for n, (kind, _) in totals.items()
    }
    own = {n: F.coalesce(c.over(inside), F.lit(0)) for n, c in of_range.items()}
    combined = {
        n: (F.col(n) + F.col(f"_of_{n}")) if kind == "sum" else F.col(n).bitwiseXOR(F.col(f"_of_{n}"))
        for n, (kind, _) in totals.items()
    }
    joined = stored.withColumns(own).join(runs.select(*group, *before.values()), group)
    return joined.select(*rows.columns, *(c.alias(n) for n, c in combined.items()))
