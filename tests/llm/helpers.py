"""Small tables with the awkward cases, and plain versions to compare with."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def documents(spark: SparkSession, texts: list, first: int = 0, lang: str | None = "en") -> DataFrame:
    rows = [(first + k, t, lang, "s", len(t) if t is not None else None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


def words(rng: random.Random, n: int, letters: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def groups_of(links: list[tuple], nodes: list) -> dict:
    """The smallest node reachable from each node."""
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}
