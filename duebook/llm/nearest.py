"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Vectors are centred, rotated at random and kept as one sign bit per dimension, with two numbers that
correct the estimate: the distance to the centre, and the inner product of the unit vector with its
own code. The estimate of an inner product comes with an error bound; a vector is computed exactly if
its upper bound reaches the ``k``-th largest lower bound of the same block, so what the bounds leave
out is all that can be missed.

Rows are dealt into blocks by a hash of their id and queries into blocks of their own; each pair of
blocks is one group of bounded size. Vectors that are null, zero, of another dimension than most, or
hold a null or a number that isn't finite take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duebook.session import write_and_read


def usable(vector: Column, dimension: int) -> Column:
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce((F.size(vector) == dimension) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def main_dimension(rows: DataFrame, vector: str) -> int:
    """The dimension that most vectors have, the larger one of equals; 0 without any."""
    sizes = rows.select(F.size(vector).alias("d")).where("d > 0").groupBy("d").count()
    first = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return int(first["d"]) if first else 0


def rotation(dimension: int, seed: int = 42) -> np.ndarray:
    """A random orthogonal matrix, the same for the same seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def centre(rows: DataFrame, dimension: int) -> np.ndarray:
    """The mean of all vectors (column ``vector``): summed by task, then by dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dimension)
        for batch in batches:
            if batch.num_rows:
                n += batch.num_rows
                total += _matrix(batch.column(0)).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dimension), pa.int32()), pa.array(total), pa.array([n] * dimension, pa.int64())],
            names=["d", "total", "n"],
        )

    sums = rows.select("vector").mapInArrow(partial, "d int, total double, n long").groupBy("d")
    table = sums.agg((F.sum("total") / F.greatest(F.sum("n"), F.lit(1))).alias("mean")).toPandas()
    return table.sort_values("d")["mean"].to_numpy()


def encode(rows: DataFrame, middle: np.ndarray, turn: np.ndarray) -> DataFrame:
    """``id``, ``is_query``, ``code`` (packed bits), ``far`` (distance to the centre), ``own`` (unit vector times code) and the vector's bytes."""
    dimension = len(middle)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(1))
            turned = (vectors - middle) @ turn
            far = np.sqrt((turned * turned).sum(axis=1))
            bits = turned >= 0
            own = np.abs(turned).sum(axis=1) / np.sqrt(dimension) / np.where(far > 0, far, 1)
            packed = np.packbits(bits, axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([p.tobytes() for p in packed], pa.binary()),
                    pa.array(far),
                    pa.array(np.where(far > 0, own, 1.0)),
                    pa.array([v.tobytes() for v in vectors], pa.binary()),
                ],
                names=["id", "is_query", "code", "far", "own", "vector"],
            )

    return rows.select("id", "vector", "is_query").mapInArrow(
        coded, "id long, is_query boolean, code binary, far double, own double, vector binary"
    )


def _decode(frame: pd.DataFrame, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(frame["vector"]), np.float64).reshape(len(frame), dimension)


def _search_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int, middle, turn, sure: float) -> pd.DataFrame:
    """The ``k`` nearest of a block's rows for each of its queries, from estimates, bounds and exact products."""
    d = len(middle)
    rows = rows.sort_values("id").reset_index(drop=True)
    ids, vectors = rows["id"].to_numpy(), _decode(rows, d)
    packed = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
    signs = np.unpackbits(packed, axis=1, count=d).astype(np.float32) * 2 - 1
    far, own = rows["far"].to_numpy(), rows["own"].to_numpy()
    scale = (far / (own * np.sqrt(d))).astype(np.float32)
    slack = far * np.sqrt(np.clip(1 - own * own, 0, None)) / own * (sure / np.sqrt(max(d - 1, 1)))
    wide = slack.astype(np.float32)
    found = []
    for at in range(0, len(queries), 512):
        some = queries.iloc[at : at + 512]
        q = _decode(some, d)
        turned = (q @ turn).astype(np.float32)
        estimate = (turned @ signs.T) * scale + (q @ middle).astype(np.float32)[:, None]
        error = wide[None, :] * np.sqrt((q * q).sum(axis=1)).astype(np.float32)[:, None]
        low = estimate - error
        for i, query_id in enumerate(some["id"].to_numpy()):
            bound = low[i].copy()
            bound[np.searchsorted(ids, query_id, "left") : np.searchsorted(ids, query_id, "right")] = -np.inf
            at_least = np.partition(bound, len(bound) - k)[len(bound) - k] if len(bound) > k else -np.inf
            near = np.flatnonzero((estimate[i] + error[i] >= at_least) & (ids != query_id))
            scores = np.cumsum(vectors[near] * q[i], axis=1)[:, -1]  # summed from the first dimension on
            if len(near) > k:
                least = np.partition(scores, len(near) - k)[len(near) - k]
                near, scores = near[scores >= least], scores[scores >= least]
            best = np.lexsort((ids[near], -scores))[:k]
            found.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[near[best]], "score": scores[best]}))
    empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    return pd.concat(found or [empty]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def nearest(
    rows: DataFrame,
    queries: Column,
    id_col: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    sure: float = 1.9,
    rows_in_block: int = 8192,
    queries_in_block: int = 4096,
    seed: int = 42,
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score`` for the rows that ``queries`` holds for, against all others.

    A row is never its own neighbour (nor is another row with its id). Equal scores go to the smaller
    id. ``sure`` is the width of the error bound; a larger one computes more products and misses less.
    With fewer than ``k`` candidates all are returned. Work grows with rows times queries, in blocks.
    """
    dimension = main_dimension(rows, vector)
    good = rows.where(F.col(id_col).isNotNull() & usable(F.col(vector), dimension)).select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector).cast("array<double>").alias("vector"),
        F.coalesce(queries, F.lit(False)).alias("is_query"),
    )
    middle, turn = centre(good, dimension), rotation(dimension, seed)
    if not len(middle):
        middle = np.zeros(dimension)
    coded = write_and_read(encode(good, middle, turn), "codes")
    counts = coded.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q")).first()
    blocks = max(1, -(-counts["n"] // rows_in_block))
    query_blocks = max(1, -(-counts["q"] // queries_in_block))

    def dealt(n: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    base = coded.select(
        "id", "code", "far", "own", "vector", dealt(blocks, 1).alias("block"), all_of(query_blocks).alias("query_block")
    )
    asked = coded.where("is_query").select(
        "id", "vector", dealt(query_blocks, 2).alias("query_block"), all_of(blocks).alias("block")
    )

    def search(queries_of: pd.DataFrame, rows_of: pd.DataFrame) -> pd.DataFrame:
        if not len(queries_of) or not len(rows_of):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "float64"}
            )
        return _search_block(queries_of, rows_of, k, middle, turn, sure)

    near = (
        asked.groupBy("query_block", "block")
        .cogroup(base.groupBy("query_block", "block"))
        .applyInPandas(search, "query_id long, vec_id long, score double")
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        near.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
