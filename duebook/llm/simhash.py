"""SimHash near-duplicates: fingerprints linked at few differing bits, found by a generalised pigeonhole.

The 64 bits are dealt into partitions that keep correlated bits together. If two fingerprints differ
in at most ``most`` bits, then for any thresholds that add up to ``most - partitions + 1`` they differ
in no more bits than the threshold in at least one partition. Each fingerprint gets the thresholds
with the fewest estimated candidates (a small dynamic programme per row), probes the partitions for
the values within them, and the pairs found are verified on all 64 bits.

A fingerprint whose probes would meet more than ``most_candidates`` others stands in a crowd. A crowd
isn't paired: its fingerprints are linked through shared values that are at most ``most / 2`` bits away
from each, which gives the same components with a fixed number of rows per fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.llm.components import connected_components
from duebook.session import write_and_read

BITS = 64
SEED = 42


def fingerprint(text: bytes | None, words_in_shingle: int = 3) -> int:
    """The SimHash of a UTF-8 text: a bit is set if over half of the shingles' hashes set it.

    A-Z are lower-cased; words are cut at space and the characters 9 to 13 (what ``bytes.split``
    does). Shorter texts are one shingle; without words the fingerprint is zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= words_in_shingle:
        hashes = digest(line, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-words_in_shingle].tolist()]
        stops = (ends[words_in_shingle - 1 :] - 1).tolist()
        hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)])
    bytes_ = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(bytes_), 65536):
        counts += np.unpackbits(bytes_[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(bytes_)).tobytes(), "big")


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", words_in_shingle: int = 3
) -> DataFrame:
    """``id_col`` and ``fp``, the fingerprint as a signed long with the same bits. A null text counts as empty."""
    rows = docs.select(F.col(id_col), F.col(text).cast("binary").alias("_text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter(
                (fingerprint(t.as_py(), words_in_shingle) for t in batch.column(1)), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], [id_col, "fp"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(hashed, f"`{id_col}` {kind}, fp long")


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, how often each bit is set, and how often each two are (64 by 64 numbers)."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            for at in range(0, len(batch), 8192):
                values = batch["fp"].to_numpy(np.int64)[at : at + 8192].astype(">i8")
                bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
                both += bits.T @ bits
                n += len(values)
        rows, cols = np.divmod(np.arange(BITS * BITS), BITS)
        yield pd.DataFrame({"a": rows, "b": cols, "both": both.ravel().astype(np.int64), "n": n})

    sums = prints.select("fp").mapInPandas(partial, "a int, b int, both long, n long")
    table = sums.groupBy("a", "b").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).toPandas()
    both = np.zeros((BITS, BITS))
    if len(table):
        both[table["a"], table["b"]] = table["both"]
    return int(table["n"].max()) if len(table) else 0, np.diag(both).copy(), both


def partition_bits(n: int, ones: np.ndarray, both: np.ndarray, partitions: int) -> list[list[int]]:
    """Bits dealt into equal partitions, each grown by the bit most correlated with those it has.

    Correlated bits say little about each other, so they are better kept together than spread.
    """
    p = ones / max(n, 1)
    spread = np.sqrt(np.clip(p * (1 - p), 1e-9, None))
    related = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    free, dealt = list(range(BITS)), []
    for k in range(partitions):
        size = BITS // partitions + (k < BITS % partitions)
        part = [max(free, key=lambda b: (related[b][free].max(initial=0), -b))]
        free.remove(part[0])
        while len(part) < size:
            best = max(free, key=lambda b: (related[b][part].mean(), -b))
            part.append(best)
            free.remove(best)
        dealt.append(sorted(part))
    return dealt


def _mask(bits: list[int] | tuple[int, ...]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def allot_thresholds(costs: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds with the least cost for each row.

    ``costs[row, part, t + 1]`` is the estimated number of candidates of threshold ``t`` (-1: the
    partition isn't probed). Returns the thresholds and their cost; they add up to ``total``.
    """
    rows, parts, choices = costs.shape
    reach = total + parts  # thresholds counted from -1 add up to this
    best = np.full((rows, reach + 1), np.inf)
    best[:, 0] = 0
    chosen = np.zeros((rows, parts, reach + 1), np.int8)
    for part in range(parts):
        after = np.full_like(best, np.inf)
        for t in range(min(choices, reach + 1)):
            with_t = np.full_like(best, np.inf)
            with_t[:, t:] = best[:, : reach + 1 - t] + costs[:, part, t][:, None]
            better = with_t < after
            after = np.where(better, with_t, after)
            chosen[:, part][better] = t
        best = after
    thresholds, left = np.zeros((rows, parts), np.int64), np.full(rows, reach)
    for part in reversed(range(parts)):
        thresholds[:, part] = chosen[np.arange(rows), part, left]
        left -= thresholds[:, part]
    return thresholds - 1, best[:, reach]


def _nearby(bits: list[int], distance: int) -> np.ndarray:
    """What turns a partition's value into those at exactly this distance."""
    return np.array([_mask(c) for c in combinations(bits, distance)], np.int64)


def _chance(n: int, p: np.ndarray, bits: list[int], values: np.ndarray, most: int) -> np.ndarray:
    """Expected fingerprints at distance 0 to ``most`` in these bits, if bits were independent."""
    ways = np.zeros((len(values), most + 1))
    ways[:, 0] = n
    for b in bits:
        same = np.where((values >> b) & 1 == 1, p[b], 1 - p[b])[:, None]
        moved = np.hstack([np.zeros((len(values), 1)), ways[:, :-1]])
        ways = ways * same + moved * (1 - same)
    return ways


def links(
    prints: DataFrame, most: int = 2, partitions: int = 3, most_candidates: int = 200
) -> DataFrame:
    """Links ``u``, ``v`` that connect all fingerprints (column ``fp``, distinct) at most ``most`` bits apart.

    Outside crowds every pair within the distance is a link. Inside a crowd, fingerprints are linked
    to the smallest one around each shared value, which are at most ``most`` bits apart too.
    """
    n, ones, both = bit_statistics(prints)
    parts = partition_bits(n, ones, both, partitions)
    p = ones / max(n, 1)
    total, masks = most - partitions + 1, [_mask(part) for part in parts]
    reach = total + partitions - 1  # the largest threshold a partition can get
    values = F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))
    index = prints.select("fp", F.posexplode(values).alias("part", "value"))
    buckets = index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("size"))
    buckets = write_and_read(buckets, "buckets")  # read back, the joins can split a crowded one
    sized = (
        index.join(buckets, ["part", "value"])
        .groupBy("fp")
        .agg(*(F.max(F.when(F.col("part") == k, F.col("size"))).alias(f"s{k}") for k in range(partitions)))
    )

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = [[_nearby(part, d) for d in range(reach + 1)] for part in parts]
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64)
            costs = np.zeros((len(fp), partitions, reach + 2))
            for k, part in enumerate(parts):
                ways = _chance(n, p, part, fp, reach)
                ways[:, 0] = batch[f"s{k}"].to_numpy()
                tried = np.cumsum([len(s) for s in steps[k]])
                costs[:, k, 1:] = np.cumsum(ways, axis=1) + 0.1 * (tried - 1)
            thresholds, _ = allot_thresholds(costs, total)
            for k in range(partitions):
                own = fp & np.int64(masks[k])
                for d, step in enumerate(steps[k]):
                    rows = np.flatnonzero(thresholds[:, k] >= d)
                    for at in range(0, len(rows), 4096):
                        some = rows[at : at + 4096]
                        yield pd.DataFrame(
                            {
                                "fp": np.repeat(fp[some], len(step)),
                                "part": k,
                                "value": (own[some][:, None] ^ step[None, :]).ravel(),
                            }
                        )

    probe = sized.mapInPandas(probes, "fp long, part int, value long").join(buckets, ["part", "value"])
    probe = write_and_read(probe, "probes")
    wide = probe.groupBy("fp").agg(F.sum("size").alias("met")).where(F.col("met") > most_candidates).select("fp")
    wide = write_and_read(wide, "crowd")
    met = (
        probe.join(wide, "fp", "left_anti")
        .drop("size")
        .join(index.withColumnRenamed("fp", "other"), ["part", "value"])
        .where(F.col("fp") != F.col("other"))
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= most)
        .select(F.col("fp").alias("u"), F.col("other").alias("v"))
    )
    return met.union(crowd_links(wide, most))


def crowd_links(prints: DataFrame, most: int) -> DataFrame:
    """Links within a crowd, without its pairs: values around each fingerprint stand between them.

    Two fingerprints at distance ``d`` share a value at most ``ceil(d / 2)`` bits from one and
    ``floor(d / 2)`` from the other. For an odd ``most`` a value counts only if the distances of the
    two add up to ``most``, so the nearer ones of a value link to all, the farther ones to the nearer.
    """
    far, near = (most + 1) // 2, most // 2
    steps = [(0, 0)] + [
        (_mask(c), d) for d in range(1, far + 1) for c in combinations(range(BITS), d)
    ]
    around = F.array(
        *(
            F.struct(F.col("fp").bitwiseXOR(F.lit(m).cast("long")).alias("value"), F.lit(d).alias("d"))
            for m, d in steps
        )
    )
    rows = prints.select("fp", F.inline(around))
    low = rows.where(F.col("d") <= near).groupBy("value").agg(F.min("fp").alias("low"))
    return rows.join(low, "value").where("fp <> low").select(F.col("fp").alias("u"), F.col("low").alias("v"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    words_in_shingle: int = 3,
    most: int = 2,
    partitions: int = 3,
    most_candidates: int = 200,
) -> DataFrame:
    """``id_col``, ``fp`` and ``component_id`` (the smallest id reachable) for every row of ``docs``.

    Copies share a fingerprint and are counted once: links are looked for between distinct
    fingerprints, which are the nodes of the graph. Null and empty texts have fingerprint zero and
    are linked like any other. Rows with the same id each get a result, and so do rows with a null
    id: they link others as any row does, and their component is named by its smallest id that isn't
    null; only a component without any id has a null one. An empty table gives none.
    """
    prints = write_and_read(fingerprints(docs, id_col, text, words_in_shingle), "fingerprints")
    classes = write_and_read(prints.groupBy("fp").agg(F.min(id_col).alias("low_id")), "classes")
    components = connected_components(links(classes.select("fp"), most, partitions, most_candidates), "u", "v")
    components = components.select(F.col("node").alias("fp"), "component")
    lowest = components.join(classes, "fp").groupBy("component").agg(F.min("low_id").alias("lowest"))
    lowest = write_and_read(lowest, "lowest_ids")  # read back, the join can split a component with many
    linked = components.join(lowest, "component").select("fp", "lowest")
    labelled = classes.join(linked, "fp", "left").select("fp", F.coalesce("lowest", "low_id").alias("component_id"))
    labelled = write_and_read(labelled, "labels")  # as above, for a fingerprint with many copies
    return prints.join(labelled, "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Exactly one row of each component of ``docs``, that with the smallest id; all columns as they were.

    Rows with a null id come last: one is kept where no row of its component has an id. Of rows with
    the same id the one with the least hash of its columns is kept (maps aren't hashed), so of
    repeated rows any one. Rows that share an id but not a component stand for one component each.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    rows = write_and_read(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    hashed = F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind))
    key = F.struct(
        F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), hashed.alias("hash"), F.col(name).alias("row")
    )
    found = near_duplicates(rows.select(key.alias("key"), F.col(text).alias("text")), "key", "text", **options)
    kept = found.where("key.row = component_id.row").select(F.col("key.row").alias(name))
    return rows.join(kept, name, "left_semi").drop(name)
