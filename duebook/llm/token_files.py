"""Token ids in files of independent blocks, coded by a static range asymmetric numeral system.

A folder holds a frequency table (scaled to 2**20) that all blocks share, and the blocks as rows of
Parquet files, in order of the document id. A block holds whole documents. Its ids are dealt over
2048 interleaved coders, so a step codes 2048 ids at once; the coders' states are kept at the block's
start and every 128 steps, with the place of the next word and a checksum of the ids up to the next
checkpoint, and decoding can start at each of these. Every block carries a checksum of its bytes too.

Blocks are read in parallel. One that is much longer than others, because it holds a very long document,
is cut at its checkpoints, which are dealt over the tasks and decoded on their own.

A block's bytes: magic, version, lanes, ids, steps between checkpoints, checkpoints, words; then per
checkpoint the word offsets, the crc32 of the ids and the states; then the words; then the crc32 of all
that stands before. All numbers are little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duebook.llm import tokens
from duebook.llm.scratch import Scratch
from duebook.session import fresh_dir

MAGIC, VERSION = b"RANS", 2
SCALE_BITS = 20
LOW = np.uint64(1 << 31)
LANES = 2048
STEPS_BETWEEN = 128
BLOCK_IDS = 1 << 19
_ZEROS = bytes(1 << 20)
HEADER = struct.Struct("<4sHHQIIQ")


class CorruptBlock(ValueError):
    """A block whose checksum, or that of its ids, isn't right."""


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2**20, at least 1 for each id that occurs; all 0 if none does.

    What rounding leaves over or takes too much is settled with the largest frequencies.
    """
    total, room = counts.sum(), 1 << SCALE_BITS
    found = np.flatnonzero(counts)
    if not len(found):
        return np.zeros(len(counts), np.int64)
    if len(found) > room:
        raise ValueError("more ids occur than the table has places")
    freq = np.zeros(len(counts), np.int64)
    freq[found] = np.maximum(1, np.floor(counts[found] / total * room).astype(np.int64))
    order = found[np.argsort(-freq[found], kind="stable")]
    left = room - int(freq.sum())
    at = 0
    while left:
        one = order[at % len(order)]
        step = left if left > 0 else -min(-left, int(freq[one]) - 1, max(1, int(freq[one]) // 2))
        freq[one] += step
        left -= step
        at += 1
    return freq


class Table:
    """The shared table: frequency and start of each id, and the id of each of the 2**20 places."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self._ids = None

    @property
    def ids(self) -> np.ndarray:
        if self._ids is None:
            self._ids = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._ids

    def __getstate__(self):
        return {"freq": self.freq, "start": self.start, "_ids": None}


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, between: int = STEPS_BETWEEN) -> bytes:
    """One block's bytes. Ids without a frequency are an error."""
    n = len(ids)
    steps = -(-n // lanes)
    if n and not table.freq[ids].all():
        raise ValueError("an id isn't in the table")
    x = np.full(lanes, LOW, np.uint64)
    words, states = [], []
    wide = np.uint64(32)
    freq, start = table.freq[ids], table.start[ids]
    limit, rest = freq << np.uint64(63 - SCALE_BITS), np.uint64(1 << SCALE_BITS) - freq
    for step in range(steps - 1, -1, -1):
        some = slice(step * lanes, min(n, (step + 1) * lanes))
        now = x[: some.stop - some.start]
        full = np.flatnonzero(now >= limit[some])
        out = now[full]
        words.append(out.astype(np.uint32))
        now[full] = out >> wide
        now += start[some] + now // freq[some] * rest[some]
        if step % between == 0:
            states.append(x.copy())
    words.reverse()
    states.reverse()
    sizes = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype("<u8")
    offsets = sizes[0:steps:between]
    some = lanes * between
    checks = np.array([zlib.crc32(ids[k : k + some].astype("<u4").tobytes()) for k in range(0, n, some)], "<u4")
    body = b"".join(
        [
            HEADER.pack(MAGIC, VERSION, lanes, n, between, len(states), int(sizes[-1])),
            offsets.tobytes(),
            checks.tobytes(),
            *(s.astype("<u8").tobytes() for s in states),
            *(w.astype("<u4").tobytes() for w in words),
        ]
    )
    return body + struct.pack("<I", zlib.crc32(body))


@dataclass
class Checkpoint:
    """What decoding from one checkpoint up to the next needs: coders' states, words, the ids' number and checksum."""

    first: int
    n: int
    lanes: int
    states: bytes
    words: bytes
    check: int

    def decode(self, table: Table) -> np.ndarray:
        """The ids; if they don't match their checksum, that is an error."""
        x = np.frombuffer(self.states, "<u8").astype(np.uint64)
        words = np.frombuffer(self.words, "<u4").astype(np.uint64)
        out, at = np.empty(self.n, np.uint32), 0
        mask, shift = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
        for done in range(0, self.n, self.lanes):
            now = x[: min(self.lanes, self.n - done)]
            place = now & mask
            ids = table.ids[place.astype(np.int64)]
            now = table.freq[ids] * (now >> shift) + place - table.start[ids]
            low = np.flatnonzero(now < LOW)
            if at + len(low) > len(words):
                raise CorruptBlock("the ids don't match their checksum")
            now[low] = (now[low] << np.uint64(32)) | words[at : at + len(low)]
            at += len(low)
            x[: len(now)] = now
            out[done : done + len(now)] = ids
        if at != len(words) or zlib.crc32(out.astype("<u4").tobytes()) != self.check:
            raise CorruptBlock("the ids don't match their checksum")
        return out


def checkpoints(data: bytes) -> Iterator[Checkpoint]:
    """The checkpoints of a block. A damaged block is an error."""
    if len(data) < HEADER.size + 4 or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise CorruptBlock("the bytes don't match their checksum")
    magic, version, lanes, n, between, points, n_words = HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise CorruptBlock("not a block of this format")
    at = HEADER.size
    offsets = np.frombuffer(data, "<u8", points, at).tolist()
    checks = np.frombuffer(data, "<u4", points, at + 8 * points).tolist()
    states = at + 12 * points
    words = states + 8 * points * lanes
    for k, (a, b) in enumerate(zip(offsets, [*offsets, n_words][1:], strict=True)):
        first = k * between * lanes
        state = data[states + 8 * k * lanes : states + 8 * (k + 1) * lanes]
        yield Checkpoint(first, min(n - first, between * lanes), lanes, state, data[words + 4 * a : words + 4 * b], checks[k])


def decode_block(data: bytes, table: Table) -> np.ndarray:
    """The block's ids."""
    return np.concatenate([np.zeros(0, np.uint32), *(point.decode(table) for point in checkpoints(data))])


def joined_crc32(first: int, second: int, n_second: int) -> int:
    """The crc32 of two byte strings, one after the other, from that of each and the length of the second."""
    while n_second > len(_ZEROS):
        first = zlib.crc32(_ZEROS, first) ^ zlib.crc32(_ZEROS)
        n_second -= len(_ZEROS)
    zeros = memoryview(_ZEROS)[:n_second]
    return zlib.crc32(zeros, first) ^ zlib.crc32(zeros) ^ second


def _blocks(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text: str, block_ids: int) -> DataFrame:
    """Documents in order of their id as blocks of plain ids: ``part``, ``block``, ``before`` (ids of the
    part's earlier blocks), ``docs``, ``lengths``, ``ids``. The last row of a part has ``counts`` only: how
    often each id occurs in the part."""
    kind = docs.schema[id_col].dataType

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        keys, lengths, parts, size = [], [], [], 0
        counts = np.zeros(most, np.int64)
        key_type = pa.list_(pa.int64() if kind.simpleString() in ("bigint", "int") else pa.string())

        def row(*values) -> pa.RecordBatch:
            types = [pa.int32(), pa.int32(), pa.int64(), key_type, pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, types, strict=True)],
                names=["part", "block", "before", "docs", "lengths", "ids", "counts"],
            )

        def whole() -> pa.RecordBatch:
            nonlocal counts
            ids = np.frombuffer(b"".join(parts), np.uint32)
            counts += np.bincount(ids, minlength=most)
            return row(part, block, before, keys, lengths, ids.astype(np.uint16 if small else np.uint32).tobytes(), None)

        for batch in batches:
            texts = (t.as_py() for t in batch.column(1))
            for key, ids in zip(batch.column(0), tokens.encode_stream(tokenizer_path, texts, end_id), strict=True):
                keys.append(key.as_py())
                lengths.append(len(ids) // 4)
                parts.append(ids)
                size += lengths[-1]
                if size >= block_ids:
                    yield whole()
                    block, before = block + 1, before + size
                    keys, lengths, parts, size = [], [], [], 0
        if keys:
            yield whole()
        if counts.any():
            yield row(part, None, None, None, None, None, counts.tobytes())

    from tokenizers import Tokenizer

    most = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    small = most <= 1 << 16
    key = F.col(id_col) if kind.simpleString() in ("bigint", "int") else F.col(id_col).cast("string")
    ordered = (
        docs.select(key.alias("doc"), F.col(text).alias("text"))
        .repartitionByRange("doc", F.xxhash64("text"))
        .sortWithinPartitions("doc", F.xxhash64("text"))
    )
    key_kind = "long" if kind.simpleString() in ("bigint", "int") else "string"
    rows = ordered.mapInArrow(
        dealt,
        f"part int, block int, before long, docs array<{key_kind}>, lengths array<long>, ids binary, counts binary",
    )
    return rows.withColumn("width", F.lit(2 if small else 4))


def count_ids(parts: DataFrame, most: int) -> np.ndarray:
    """How often each id occurs, from the counts of all parts: summed by task, then by id."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(most, np.int64)
        for batch in batches:
            for data in batch.column(0):
                counts += np.frombuffer(data.as_py(), np.int64)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["id", "n"])

    rows = parts.select("counts").where("counts IS NOT NULL").mapInArrow(partial, "id long, n long")
    table = rows.groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(most, np.int64)
    counts[table["id"].to_numpy(np.int64)] = table["n"]
    return counts


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text: str = "text",
    block_ids: int = BLOCK_IDS,
) -> None:
    """Encode every whole text and its end id into ``folder``, in ascending order of the id.

    A null text counts as empty and has the end id only. Rows with the same id follow one another, by a hash
    of their text; different texts of one id may go to different tasks. Ids that are neither int nor
    long are put in the order of their text form. An empty table gives an empty folder that reads back as no rows.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    scratch = Scratch(spark, "token-blocks")
    plain = scratch.put(_blocks(docs, tokenizer_path, end_id, id_col, text, block_ids), "plain", "uncompressed")
    most = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    freq = scaled(count_ids(plain, most))
    found = np.flatnonzero(freq)
    spark.createDataFrame(
        [(most, found.tolist(), freq[found].tolist())], "ids int, id array<int>, frequency array<int>"
    ).coalesce(1).write.parquet(f"{folder}/table")
    table = Table(freq)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: k for k, name in enumerate(batch.schema.names)}
            data = [
                encode_block(np.frombuffer(ids.as_py(), f"<u{width.as_py()}"), table)
                for ids, width in zip(batch.column(at["ids"]), batch.column(at["width"]), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(at[c]) for c in ("part", "block", "before", "docs", "lengths")), pa.array(data, pa.binary())],
                names=["part", "block", "before", "docs", "lengths", "data"],
            )

    key_kind = plain.schema["docs"].dataType.simpleString()
    plain.where("ids IS NOT NULL").drop("counts").mapInArrow(
        coded, f"part int, block int, before long, docs {key_kind}, lengths array<bigint>, data binary"
    ).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    scratch.drop("plain")


def _document_pieces(
    blocks: DataFrame, base: dict[int, int], table: Table, key: pa.DataType, key_kind: str, with_ids: bool
) -> DataFrame:
    """Long blocks cut at their checkpoints, each decoded on its own: per document and checkpoint ``doc_id``, ``start``,
    ``n_tokens``, ``at`` (the piece's place in the document), ``n`` (its ids), ``crc`` and, if asked for, ``ids``."""
    places = f"docs array<{key_kind}>, starts array<long>, sizes array<long>, ats array<long>, ns array<long>"
    listed = [pa.list_(key), *[pa.list_(pa.int64())] * 4]
    names = [c.split()[0] for c in places.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, docs, lengths, data in zip(*(batch.column(k) for k in range(5)), strict=True):
                sizes = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(sizes)
                starts, offset, found = ends - sizes, base[part.as_py()] + before.as_py(), 0
                for point in checkpoints(data.as_py()):
                    beyond = point.first + point.n
                    found += point.n
                    a, b = np.searchsorted(ends, point.first, "right"), np.searchsorted(starts, beyond)
                    low = np.maximum(starts[a:b], point.first)
                    here = [docs.values[a:b].to_pylist(), starts[a:b] + offset, sizes[a:b], low - starts[a:b]]
                    here.append(np.minimum(ends[a:b], beyond) - low)
                    values = [point.first, point.n, point.lanes, point.states, point.words, point.check]
                    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], t) for v, t in zip([*values, *here], [*types, *listed], strict=True)],
                        names=["first", "n", "lanes", "states", "words", "check", *names],
                    )
                if found != int(ends[-1]):
                    raise CorruptBlock("the documents' lengths don't match the ids")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                values = [column[k].as_py() for column in batch.columns[:6]]
                docs, starts, sizes, ats, ns = (column[k].values for column in batch.columns[6:])
                ids = Checkpoint(*values).decode(table).astype("<u4").tobytes()
                ends = np.cumsum(ns.to_numpy()).tolist()
                pieces = [ids[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)]
                crc = pa.array([zlib.crc32(p) for p in pieces], pa.int64())
                columns, titles = [docs, starts, sizes, ats, ns, crc], ["doc_id", "start", "n_tokens", "at", "n", "crc"]
                if with_ids:
                    columns, titles = [*columns, pa.array(pieces, pa.binary())], [*titles, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=titles)

    slices = blocks.mapInArrow(
        cut, f"first long, n long, lanes int, states binary, words binary, check long, {places}"
    ).repartition(F.xxhash64("starts", "first"))
    kind = f"doc_id {key_kind}, start long, n_tokens long, at long, n long, crc long" + ", ids binary" * with_ids
    return slices.mapInArrow(decoded, kind)


def _documents_of(pieces: DataFrame, key_kind: str, with_ids: bool) -> DataFrame:
    """Documents put together from their pieces: the checksums are joined, so no ids are moved unless asked for."""
    columns = ["at", "n", "crc", *["ids"] * with_ids]
    whole = pieces.groupBy("start").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_tokens").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct(*columns))).alias("pieces"),
    )
    kind = f"doc_id {key_kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, ids = [], []
            for size, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if sum(p["n"] for p in found) != size:
                    raise CorruptBlock("a piece of a document is missing")
                check = 0
                for p in found:
                    check = joined_crc32(check, p["crc"], 4 * p["n"])
                sums.append(check)
                if with_ids:
                    ids.append(b"".join(p["ids"] for p in found))
            columns = [*batch.columns[:3], pa.array(sums, pa.int64()), *[pa.array(ids, pa.binary())] * with_ids]
            names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return whole.select("doc_id", "start", "n_tokens", "pieces").mapInArrow(joined, kind)


def read_token_files(
    spark: SparkSession, folder: str, with_ids: bool = False, whole_up_to: int = 2 * BLOCK_IDS
) -> DataFrame:
    """Per document ``doc_id``, ``start`` (ids before it in the files), ``n_tokens`` and ``ids_crc32``; ``with_ids`` adds the ids.

    Blocks are decoded on their own, by as many tasks as there are splits; how many ids stand before
    each part is the only thing gathered first. A block of more than ``whole_up_to`` ids, which
    a long document makes, is cut at its checkpoints and those are decoded by different tasks. Ids are checked
    against the checksum of every checkpoint.
    """
    one = spark.read.parquet(f"{folder}/table").first()
    freq = np.zeros(one["ids"], np.int64)
    freq[one["id"]] = one["frequency"]
    table = Table(freq)
    blocks = spark.read.parquet(f"{folder}/blocks")
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)
    sizes = blocks.select("part", size.alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"), F.max("n").alias("longest")).orderBy("part").collect()
    base, total = {}, 0
    for row in parts:
        base[row["part"]] = total
        total += row["n"]
    key_kind = blocks.schema["docs"].dataType.elementType.simpleString()
    kind = f"doc_id {key_kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, docs, lengths, data in zip(*(batch.column(k) for k in range(5)), strict=True):
                ids = decode_block(data.as_py(), table).astype("<u4").tobytes()
                sizes = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(sizes)
                if int(ends[-1]) * 4 != len(ids):
                    raise CorruptBlock("the documents' lengths don't match the ids")
                pieces = [ids[4 * a : 4 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                columns = [
                    docs.values,
                    pa.array(base[part.as_py()] + before.as_py() + ends - sizes),
                    pa.array(sizes),
                    pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(pieces, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    columns = ["part", "before", "docs", "lengths", "data"]
    short = blocks.where(size <= whole_up_to).select(*columns).mapInArrow(decoded, kind)
    if not any(row["longest"] > whole_up_to for row in parts):
        return short
    key = pa.int64() if key_kind == "bigint" else pa.string()
    long = blocks.where(size > whole_up_to).select(*columns)
    return short.union(_documents_of(_document_pieces(long, base, table, key, key_kind, with_ids), key_kind, with_ids))


def new_folder(spark: SparkSession) -> str:
    """A folder for token files in the shared one."""
    return fresh_dir(spark, "token-files")
