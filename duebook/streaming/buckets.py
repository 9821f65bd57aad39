"""Many keys in one state: a call to the state store costs far more than the work on a row.

A stream's state machines are grouped by a hash of the key and not by the key, and keep all that is known of a
bucket's keys in one value. So a micro-batch pays its calls per bucket it touches, not per key. A checkpoint
belongs to one number of buckets; with n keys stored, a touched bucket reads and writes n / buckets of them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from duebook.operators.validation import KEY

BUCKETS = 1 << 12


def bucket(buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")


def in_buckets(rows: DataFrame, buckets: int = BUCKETS):
    """The rows grouped by the bucket of their key, as input of a state machine."""
    return rows.withColumn("_bucket", bucket(buckets)).groupBy("_bucket")


def by_key(rows: Iterable[Row]) -> dict[tuple, list[Row]]:
    """A bucket's rows of one micro-batch by key, which stands in front; two nulls are one key."""
    found: dict[tuple, list[Row]] = {}
    for row in rows:
        found.setdefault((row[0], row[1]), []).append(row)
    return found
