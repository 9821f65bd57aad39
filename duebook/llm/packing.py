"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Lengths are at most the sequence's, so the whole corpus is described by how many pieces there are of
each length. The bins are planned on those counts: one is filled greedily, then its smallest piece is
replaced by the two unpacked ones that fit the gap it leaves more tightly, and the bin is repeated for
as long as its pieces last. The plan has at most a few thousand kinds of bins, whatever the number
of documents. Pieces are numbered within their length and look up their place in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duebook.llm import tokens
from duebook.session import write_and_read


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 0,
    longest: int = 2048,
    id_col: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of each document's token ids and the end id: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``.

    Only documents longer than ``longest`` are cut: the first piece takes what is left over, the others
    are full. A null text is empty and is one piece with the end id. ``with_ids`` adds the ids.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    width = longest * 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_py() for t in batch.column(1))
            rows: list[tuple] = []
            for key, ids in zip(batch.column(0), tokens.encode_stream(tokenizer_path, texts, end_id), strict=True):
                start = 0
                for piece in range(-(-len(ids) // width)):
                    stop = start + (len(ids) - start - 1) % width + 1 if piece == 0 else start + width
                    part = ids[start:stop]
                    rows.append((key.as_py(), piece, start // 4, len(part) // 4, zlib.crc32(part), part))
                    start = stop
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(
                arrays if with_ids else arrays[:5],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5],
            )

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col), F.col(text)).mapInArrow(cut, schema)


def _longest(left: np.ndarray, room: int) -> int:
    """The longest length left that fits, 0 if none does."""
    fits = np.flatnonzero(left[: room + 1])
    return int(fits[-1]) if len(fits) else 0


def plan_bins(counts: dict[int, int], room: int) -> list[tuple[int, list[int]]]:
    """Bins as (how many, lengths in order of their place). Every piece is in exactly one bin."""
    if any(length < 1 or length > room for length in counts):
        raise ValueError("a piece doesn't fit")
    left, bins = np.zeros(room + 1, np.int64), []
    for length, n in counts.items():
        left[length] = n
    while (first := _longest(left, room)) > 0:
        used, gap, fit = [], room, first
        while fit:
            used.append(fit)
            left[fit] -= 1
            gap -= fit
            fit = _longest(left, gap)
        if gap and len(used) > 1:
            used = _two_for_the_smallest(left, used, gap)
        lengths, each = np.unique(used, return_counts=True)
        more = int((left[lengths] // each).min())
        left[lengths] -= more * each
        bins.append((more + 1, used))
    return bins


def _two_for_the_smallest(left: np.ndarray, used: list[int], gap: int) -> list[int]:
    """The bin with its smallest piece replaced by the two that leave the smallest gap, if they leave a smaller one."""
    smallest = used[-1]
    wide = gap + smallest
    free = np.flatnonzero(left[:wide])
    if not len(free):
        return used
    at = np.searchsorted(free, np.minimum(wide - free, free), side="right") - 1
    alone = (at >= 0) & (free[at] == free) & (left[free] < 2)
    at = np.where(alone, at - 1, at)
    sums = np.where(at >= 0, free + free[at], 0)
    best = int(sums.argmax())
    if sums[best] <= smallest:
        return used
    pair = [int(free[best]), int(free[at[best]])]
    left[smallest] += 1
    for length in pair:
        left[length] -= 1
    return [*used[:-1], *pair]


def plan_table(bins: list[tuple[int, list[int]]]) -> pd.DataFrame:
    """For each length, runs of piece numbers: where a run starts, its first bin, and the place in the bin.

    The pieces of one place in the bins of a kind are numbered one after the other.
    """
    rows, next_bin, seen = [], 0, {}
    for times, lengths in bins:
        offset = 0
        for length in lengths:
            rows.append((length, seen.get(length, 0), next_bin, offset))
            seen[length] = seen.get(length, 0) + times
            offset += length
        next_bin += times
    return pd.DataFrame(rows, columns=["length", "first_number", "first_bin", "offset"]).astype("int64")


def number_within_length(rows: DataFrame, *order: str) -> tuple[DataFrame, str, dict[int, int]]:
    """Rows with a column of their number, from 0 within their length, its name, and the number of rows of each length.

    Rows are counted by stored file and length; a file's rows are numbered on their own, and what the
    files before hold is added. So a length that most pieces have is not gathered anywhere. The columns
    added have names that none of the rows' columns has.
    """
    lead = "_"
    while any(c.lower().startswith(lead) for c in rows.columns):
        lead += "_"
    part, block, own, before, number = (lead + c for c in ("part", "block", "own", "before", "number"))
    stored = write_and_read(rows, "pieces")
    place = stored.metadataColumn("_metadata")  # the scan's own, also where the rows have a column of that name
    stored = stored.select("*", place["file_name"].alias(part), place["file_block_start"].alias(block))
    per_file = stored.groupBy(part, block, "length").agg(F.count(F.lit(1)).alias("n"))
    per_file = write_and_read(per_file, "counts")
    totals = {r[0]: r[1] for r in per_file.groupBy("length").agg(F.sum("n")).collect()}
    earlier = per_file.withColumn(
        before, F.sum("n").over(Window.partitionBy("length").orderBy(part, block)) - F.col("n")
    ).drop("n")
    in_file = Window.partitionBy(part, block, "length").orderBy(*order)
    numbered = (
        stored.withColumn(own, F.row_number().over(in_file) - 1)
        .join(earlier.hint("merge"), [part, block, "length"])
        .withColumn(number, F.col(own) + F.col(before))
        .drop(part, block, own, before)
    )
    return numbered, number, totals


def pack(rows: DataFrame, room: int = 2048, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """The rows with ``sequence_id`` and ``offset``; ``length`` has their tokens, from 1 to ``room``.

    Offsets of a sequence follow one another from 0 without a gap. An empty table stays empty. The plan
    sent to the tasks has a row per place and kind of bin; its size depends on ``room``, not on the rows.
    Other columns pass; those named ``sequence_id`` or ``offset`` are replaced.
    """
    rows = rows.drop("sequence_id", "offset")
    numbered, number, totals = number_within_length(rows, *order)
    table = plan_table(plan_bins(totals, room)).sort_values(["length", "first_number"])
    runs = {
        int(length): tuple(part[c].to_numpy() for c in ("first_number", "first_bin", "offset"))
        for length, part in table.groupby("length")
    }

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths, numbers = batch[tokens_in].to_numpy(), batch["number"].to_numpy()
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                starts, first_bins, offsets = runs[int(length)]
                run = np.searchsorted(starts, numbers[at], side="right") - 1
                sequence[at] = first_bins[run] + numbers[at] - starts[run]
                offset[at] = offsets[run]
            yield batch.drop(columns="number").assign(sequence_id=sequence, offset=offset)

    plain = [f"c{k}" for k in range(len(rows.columns))]  # mapInPandas can't read names with a dot
    tokens_in = plain[rows.columns.index("length")]
    schema = ", ".join(f"{c} {t}" for c, (_, t) in zip(plain, rows.dtypes, strict=True))
    slim = numbered.select(*(F.col(f"`{c}`").alias(p) for c, p in zip(rows.columns, plain, strict=True)), F.col(number).alias("number"))
    return slim.mapInPandas(placed, f"{schema}, sequence_id long, offset long").toDF(*rows.columns, "sequence_id", "offset")
