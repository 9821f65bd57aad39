"""Removes every byte of a string that also starts elsewhere, by a distributed difference cover.

A suffix array of all bytes would move each byte many times. Here the sampled positions are a cover
that the text itself defines: of every ``length``-byte string, the place of its least 32-byte hash.
Equal strings have their sampled place at the same offset, which is what a difference cover is for:
two strings can be compared by what stands before the sampled place and by the rank of what follows.

1. Sample. Each string belongs to one sampled place; strings next to each other share it, so a
   place stands for a run of starts, and there is about one for every 130 bytes. Places whose 32
   bytes occur once can't be part of a repeat and fall out.
2. Sort triples and name them. What stands between two sampled places is a phrase. Triples of
   phrases are sorted and named by their rank, only those that occur twice. The names of places one
   triple apart are a shorter string, whose triples are named in turn, until the names span
   ``length`` bytes. Texts of ordinary words need one or two rounds, runs of the same few letters more.
3. Merge the remaining suffixes. A start before a sampled place is told by the bytes up to the place
   and the name there. Where a place's whole run of starts agrees with another's, all of its strings repeat.
4. Compare neighbours. Ends of repeats are left, where part of a run agrees. Their starts are put
   in order in blocks of 64 with the bytes they all share, and compared with their neighbours there.

Nothing is compared pair by pair, and a group of copies counts as one after step 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duebook.llm.scratch import Scratch

SEGMENT = 1 << 15
BLOCK = 64
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
GROUP_AT_ONCE = 20_000


def gram_size(length: int) -> int:
    """Bytes of a sampled place: 32, or half of a short ``length``."""
    return min(32, length // 2)


def _gram_hashes(data: np.ndarray, size: int, count: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each of ``count`` places."""
    if size < 32:
        h = np.zeros(count, np.uint64)
        for k in range(size):
            h = (h ^ data[k : k + count]) * np.uint64(MIX[0])
            h ^= h >> np.uint64(29)
        return h
    words = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,)).astype(np.uint64)
    h = words[:count] * np.uint64(MIX[0])
    for k in range(1, 4):
        h ^= words[8 * k : 8 * k + count] * np.uint64(MIX[k])
        h *= np.uint64(MIX[3 - k] | 1)
        h ^= h >> np.uint64(31)
    return h


def sample(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled places of a text: place, first and last start of the strings it stands for, hash of its bytes."""
    starts, size = len(data) - length + 1, gram_size(length)
    window = length - size + 1
    places, lows, grams = [], [], []
    for at in range(0, max(starts, 0), SEGMENT):
        here = min(SEGMENT, starts - at)
        part = np.frombuffer(data, np.uint8, here + length - 1, at)
        h = _gram_hashes(part, size, here + window - 1)
        least = (h & np.uint64(0xFFFFFFFFFFFF0000)) | np.arange(len(h), dtype=np.uint64) if len(h) <= 65536 else None
        if least is None:  # very long strings: the order of the hashes stands for them
            order = np.argsort(h, kind="stable")
            least = np.empty(len(h), np.uint64)
            least[order] = np.arange(len(h), dtype=np.uint64)
            back = order
        wide = 1
        while wide < window:
            step = min(wide, window - wide)
            least = np.minimum(least[:-step], least[step:])
            wide += step
        place = (least & np.uint64(0xFFFF)).astype(np.int64) if len(h) <= 65536 else back[least.astype(np.int64)]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        places.append(place[first] + at)
        lows.append(first + at)
        grams.append(h[place[first]])
    if not places:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    place, low, gram = np.concatenate(places), np.concatenate(lows), np.concatenate(grams)
    new = np.concatenate([[True], place[1:] != place[:-1]])
    place, low, gram = place[new], low[new], gram[new]
    return place, low, np.concatenate([low[1:] - 1, [starts - 1]]), gram


def _hash(data: bytes, seed: int = 0) -> int:
    value = xxhash.xxh64_intdigest(data, seed)
    return value - (1 << 64) if value >> 63 else value


PLACES = "doc_id long, j int, place int, low int, high int, gram long, phrase long, phrases int, before long"


def places(docs: DataFrame, length: int) -> DataFrame:
    """Sampled places: their order ``j``, the starts they stand for, hashes of their bytes, of the phrase from
    them to the end of the next place, and of the bytes before, and how many phrases their strings need."""

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, columns = [], [[] for _ in range(8)]
            phrase, before = [], []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = value.as_py() or b""
                if len(data) < length:
                    continue
                p, low, high, gram = sample(data, length)
                ends = np.append(p[1:] + gram_size(length), len(data))
                last = np.searchsorted(ends, high + length)
                starts = p.tolist()
                phrase += [_hash(data[a:b]) for a, b in zip(starts[:-1], ends[:-1].tolist(), strict=True)]
                phrase.append(_hash(data[starts[-1] :], 1))
                before += [_hash(data[a:b]) for a, b in zip(low.tolist(), starts, strict=True)]
                ids.append(np.full(len(p), key, np.int64))
                j = np.arange(len(p))
                for column, values in zip(columns, (j, p, low, high, gram.view(np.int64), last - j + 1), strict=False):
                    column.append(values)
            if ids:
                j, p, low, high, gram, need = (np.concatenate(c) for c in columns[:6])
                small = [pa.array(x.astype(np.int32)) for x in (j, p, low, high)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(ids)),
                        *small,
                        pa.array(gram),
                        pa.array(phrase, pa.int64()),
                        pa.array(need.astype(np.int32)),
                        pa.array(before, pa.int64()),
                    ],
                    names=[c.split()[0] for c in PLACES.split(", ")],
                )

    return docs.where("doc_id IS NOT NULL").select("doc_id", "data").mapInArrow(sampled, PLACES)


def _ranked(triples: DataFrame) -> DataFrame:
    """Triples that occur twice or more, with ``name`` in their sorted order."""
    twice = triples.groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return (
        twice.repartitionByRange("a", "b", "c")
        .sortWithinPartitions("a", "b", "c")
        .withColumn("name", F.monotonically_increasing_id())
    )


def spans(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id``, ``j`` and a triple ``a``, ``b``, ``c`` of names of one ``round`` that together span the row's phrases.

    In round ``r`` a name stands for ``3 ** r`` phrases. A row whose phrases are at most three names
    long gets the names at its start, one further (or as far as needed), and at its end, which may
    overlap. The others wait for the next round, where triples of names have become names. A row
    that meets a name that occurs once, or a place left out, gets no triple: its string is unique.
    """
    current = rows.select("doc_id", "j", "phrases", F.col("phrase").alias("name"))
    done, round_ = [], 0
    while True:
        width = 3**round_
        order = Window.partitionBy("doc_id").orderBy("j")
        if round_ == 0:
            ahead = F.array(
                F.struct("j", "name"),
                *(F.struct(F.lead("j", k).over(order).alias("j"), F.lead("name", k).over(order).alias("name")) for k in (1, 2)),
            )
        else:
            ahead = F.collect_list(F.struct("j", "name")).over(
                order.rowsBetween(Window.currentRow, 2 * width)
            )
        near = current.withColumn("ahead", ahead)

        def at(offset):
            found = F.get("ahead", offset)
            return F.when(found["j"] == F.col("j") + offset, found["name"])

        fits = F.col("phrases") <= 3 * width
        middle = F.when(fits, F.least(F.lit(width), F.col("phrases") - width)).otherwise(F.lit(width))
        last = F.when(fits, F.col("phrases") - width).otherwise(F.lit(2 * width))
        near = near.select(
            "doc_id", "j", "phrases", F.col("name").alias("a"), at(middle).alias("b"), at(last).alias("c"), fits.alias("fits"),
            at(F.lit(width)).alias("next_b"), at(F.lit(2 * width)).alias("next_c"),
        )
        near = scratch.put(near, f"triples{round_}")
        due = near.where(F.col("phrases") > 3 ** (round_ - 1) * 3 if round_ else F.lit(True))
        done.append(
            due.where("fits AND b IS NOT NULL AND c IS NOT NULL").select(
                "doc_id", "j", F.lit(round_).alias("round"), "phrases", "a", "b", "c"
            )
        )
        if near.where("NOT fits").isEmpty():
            break
        longer = near.where("NOT fits").select("doc_id").distinct()
        triples = (
            near.join(longer, "doc_id", "left_semi")
            .where("next_b IS NOT NULL AND next_c IS NOT NULL")
            .select("doc_id", "j", "phrases", "a", F.col("next_b").alias("b"), F.col("next_c").alias("c"))
        )
        triples = scratch.put(triples, f"waiting{round_}")
        names = scratch.put(_ranked(triples), f"names{round_}")
        current = triples.join(names, ["a", "b", "c"]).select("doc_id", "j", "phrases", "name")
        round_ += 1
    whole = done[0]
    for more in done[1:]:
        whole = whole.union(more)
    return whole


def _blocks(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The starts of the wanted places in blocks of 64 by their distance to the place.

    ``shared`` is the hash of the bytes that all strings of a full block hold; ``left`` and ``right``
    are the 63 bytes on either side that only some of them hold.
    """
    by_doc = wanted.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "low", "high", "whole"))).alias("places")
    )
    rows = docs.join(by_doc, "doc_id").select("doc_id", "packed", "places")
    kind = "doc_id long, place int, block int, near int, far int, whole boolean, shared long, left binary, right binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, packed, found in zip(*(batch.column(k) for k in range(3)), strict=True):
                doc, data = key.as_py(), unpack(packed.as_py())
                for one in found.as_py():
                    p = one["place"]
                    for block in range((p - one["high"]) // BLOCK, (p - one["low"]) // BLOCK + 1):
                        first = p - block * BLOCK  # the block's last start
                        near, far = max(first - one["high"], 0), min(first - one["low"], BLOCK - 1)
                        inner = data[first : first - BLOCK + 1 + length]
                        left = data[max(first - BLOCK + 1, 0) : first].rjust(BLOCK - 1, b"\0")
                        right = data[first - BLOCK + 1 + length : first + length].ljust(BLOCK - 1, b"\0")
                        out.append((doc, p, block, near, far, one["whole"], _hash(inner, block), left, right))
                if len(out) >= 5000:
                    yield _batch(out, kind)
                    out = []
            if out:
                yield _batch(out, kind)

    return rows.mapInArrow(cut, kind)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def _batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
    fields = [f.split() for f in kind.split(", ")]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields]
    )


def _string_hashes(frame: pd.DataFrame) -> np.ndarray:
    """A hash of each of a block's 64 strings, as rows by distance: of the shared bytes and what each adds."""
    n = len(frame)
    shared = frame["shared"].to_numpy(np.int64).view(np.uint64)
    sides = []
    for name, step in (("left", -1), ("right", 1)):
        bytes_ = np.frombuffer(b"".join(frame[name]), np.uint8).reshape(n, BLOCK - 1)[:, ::step].astype(np.uint64)
        sums = np.zeros((n, BLOCK), np.uint64)
        h = np.full(n, 0x27D4EB2F165667C5, np.uint64)
        for k in range(BLOCK - 1):
            h = (h ^ (bytes_[:, k] + np.uint64(1))) * np.uint64(MIX[0])
            h ^= h >> np.uint64(32)
            sums[:, k + 1] = h
        sums[:, 0] = 0x27D4EB2F165667C5
        sides.append(sums)
    left, right = sides[0], sides[1][:, ::-1]
    mixed = (left * np.uint64(MIX[1])) ^ ((right ^ (right >> np.uint64(29))) * np.uint64(MIX[2])) ^ shared[:, None]
    mixed = (mixed ^ (mixed >> np.uint64(33))) * np.uint64(MIX[3])
    mixed ^= np.arange(BLOCK, dtype=np.uint64)[None, :] * np.uint64(MIX[0])
    at = np.arange(BLOCK)[None, :]
    inside = (at >= frame["near"].to_numpy()[:, None]) & (at <= frame["far"].to_numpy()[:, None])
    return mixed, inside


def _runs(frame: pd.DataFrame, repeated: np.ndarray, length: int) -> pd.DataFrame:
    """Byte ranges covered by the repeated strings of each block, one range per run of starts."""
    edge = np.diff(np.pad(repeated.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, nearest = np.nonzero(edge == 1)
    _, beyond = np.nonzero(edge == -1)
    first = frame["place"].to_numpy()[row] - frame["block"].to_numpy()[row] * BLOCK
    return pd.DataFrame(
        {"doc_id": frame["doc_id"].to_numpy()[row], "start": first - beyond + 1, "stop": first - nearest + length}
    )


def _partial_repeats(blocks: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """Ranges of strings of the blocks that are found in another block too.

    Blocks in the order of what they share are compared with their neighbours as they pass. What more
    than 20,000 blocks share is counted string by string over all tasks.
    """
    crowded = blocks.groupBy("shared").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP_AT_ONCE)
    crowded = scratch.put(crowded.select("shared"), "crowded")
    kind = "doc_id long, start int, stop int"

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def judged(frame: pd.DataFrame) -> pd.DataFrame:
            keys = frame["shared"].to_numpy()
            alone = np.concatenate([[True], keys[1:] != keys[:-1]]) & np.concatenate([keys[1:] != keys[:-1], [True]])
            frame = frame[~alone]
            if not len(frame):
                return pd.DataFrame({"doc_id": [], "start": [], "stop": []})
            hashes, inside = _string_hashes(frame)
            flat = np.flatnonzero(inside)
            order = np.argsort(hashes.ravel()[flat], kind="stable")
            values = hashes.ravel()[flat][order]
            same = values[1:] == values[:-1]
            twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            repeated = np.zeros(inside.size, bool)
            repeated[flat[order[twice]]] = True
            repeated = repeated.reshape(inside.shape) & ~frame["whole"].to_numpy()[:, None]
            return _runs(frame, repeated, length)

        kept = None
        for batch in batches:
            frame = batch if kept is None or not len(kept) else pd.concat([kept, batch], ignore_index=True)
            keys = frame["shared"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                yield judged(frame.iloc[:cut])
            kept = frame.iloc[cut:]
        if kept is not None and len(kept):
            yield judged(kept)

    few = blocks.join(crowded, "shared", "left_anti")
    ordered = few.repartition("shared").sortWithinPartitions("shared")
    near = ordered.select(*(c.split()[0] for c in BLOCK_COLUMNS)).mapInPandas(compared, kind)
    if crowded.isEmpty():
        return near

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                frame = batch.iloc[at : at + 1000]
                hashes, inside = _string_hashes(frame)
                row, far = np.nonzero(inside)
                yield pd.DataFrame(
                    {
                        "hash": hashes[row, far].view(np.int64),
                        "whole": frame["whole"].to_numpy()[row],
                        "doc_id": frame["doc_id"].to_numpy()[row],
                        "start": (frame["place"] - frame["block"] * BLOCK).to_numpy()[row] - far,
                    }
                )

    many = blocks.join(crowded, "shared", "left_semi").select(*(c.split()[0] for c in BLOCK_COLUMNS))
    each = scratch.put(many.mapInPandas(strings, "hash long, whole boolean, doc_id long, start int"), "strings")
    twice = each.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    far = each.where("NOT whole").join(twice, "hash", "left_semi")
    return near.union(far.select("doc_id", "start", (F.col("start") + length).cast("int").alias("stop")))


BLOCK_COLUMNS = (
    "doc_id long", "place int", "block int", "near int", "far int", "whole boolean", "shared long", "left binary", "right binary",
)


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack(packed: bytes | None) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed) if packed else b""


def _packed(docs: DataFrame) -> DataFrame:
    """The rows with ``data`` packed, so that less is moved; other columns as they are."""
    others = [c for c in docs.columns if c not in ("doc_id", "data")]
    kind = T.StructType(
        [docs.schema[c] for c in ("doc_id", *others)] + [T.StructField("packed", T.BinaryType())]
    )

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [pack(v.as_py()) if v.is_valid and len(v.as_py()) else None for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], pa.array(data, pa.binary())], names=["doc_id", *others, "packed"]
            )

    return docs.select("doc_id", "data", *others).mapInArrow(squeezed, kind)


def repeated_ranges(docs: DataFrame, length: int = 400) -> DataFrame:
    """``doc_id``, ``start``, ``stop`` of bytes covered by strings of ``length`` that start anywhere else too.

    ``docs`` has ``doc_id`` (distinct) and ``data`` (bytes; null counts as empty). Ranges of a document
    may overlap; their union is exact up to collisions of 64-bit hashes. Documents shorter than
    ``length`` and empty tables have none.
    """
    if length < 2 * BLOCK:
        raise ValueError(f"length must be {2 * BLOCK} or more")
    scratch = Scratch(docs.sparkSession, "suffixes")
    sampled = scratch.put(places(docs, length), "places")
    twice = sampled.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    twice = scratch.put(twice, "twice")  # read back, the join can split a gram that many places have
    rows = scratch.put(sampled.join(twice, "gram"), "repeated_places")
    scratch.drop("places")
    key = ["round", "phrases", "a", "b", "c", "before"]
    told = rows.select("doc_id", "j", "place", "low", "high", "gram", "before").join(
        spans(rows, scratch).drop("phrases").join(rows.select("doc_id", "j", "phrases"), ["doc_id", "j"]), ["doc_id", "j"], "left"
    )
    told = scratch.put(told, "told")
    groups = (
        told.where("round IS NOT NULL")
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "j")).alias("one"))
        .where("n > 1")
    )
    groups = scratch.put(groups, "groups")
    judged = told.join(groups, key, "left").select(
        "doc_id", "j", "place", "low", "high", "gram", F.col("n").isNotNull().alias("whole"), "one"
    )
    judged = scratch.put(judged, "judged")
    scratch.drop("told", "groups", "repeated_places")
    whole = judged.where("whole").select(
        "doc_id", F.col("low").alias("start"), (F.col("high") + length).cast("int").alias("stop")
    )
    unsure = scratch.put(judged.where("NOT whole").select("gram").distinct(), "unsure")
    wanted = judged.where(
        ~F.col("whole") | ((F.col("one.doc_id") == F.col("doc_id")) & (F.col("one.j") == F.col("j")))
    ).join(unsure, "gram", "left_semi")
    blocks = scratch.put(_blocks(_packed(docs), wanted, length), "blocks")
    return scratch.put(whole.union(_partial_repeats(blocks, scratch, length)), "ranges")


def _without(data: bytes, ranges: list[dict] | None) -> tuple[bytes, int]:
    """What is left without the ranges (sorted by their start), and how many separate pieces were cut out."""
    kept, at, pieces = [], 0, 0
    covered = -1
    for one in ranges or ():
        if one["start"] > covered:
            kept.append(data[at : one["start"]])
            pieces += 1
        covered = at = max(covered, one["stop"])
    kept.append(data[at:])
    return b"".join(kept), pieces


def _with_ranges(data: DataFrame, length: int) -> DataFrame:
    """The rows packed, with the sorted ``ranges`` of each.

    Ranges are found and joined by a number of the row's own, ``doc_id`` here; it is written, so that
    it stays the same. So rows may share an id or have none.
    """
    data = data.withColumn("doc_id", F.monotonically_increasing_id())
    data = Scratch(data.sparkSession, "rows").put(data, "numbered")
    ranges = repeated_ranges(data.select("doc_id", "data"), length).groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("ranges")
    )
    return _packed(data).join(ranges, "doc_id", "left")


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``doc_id``, ``kept`` (the bytes left, joined), ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``.

    Strings are judged on the input as UTF-8 bytes and never cross documents; all copies go, the first
    one too. A null or empty text has 0 bytes. Ids are whole numbers or null; each row is compared and cut
    on its own, rows that share an id or have none too, so repeated rows lose what they share.
    """
    data = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("data"))
    rows = _with_ranges(data, length).select("id", "packed", "ranges")
    kind = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, packed, found in zip(*batch.columns, strict=True):
                data = unpack(packed.as_py())
                kept, pieces = _without(data, found.as_py())
                out.append(
                    (key.as_py(), kept, len(data), len(data) - len(kept), pieces, hashlib.sha256(kept).hexdigest())
                )
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return rows.mapInArrow(cut, kind)


def strip_repeats(
    docs: DataFrame, length: int = 400, id_col: str = "doc_id", text: str = "text", chars: str = "n_chars"
) -> DataFrame:
    """The rows with repeated strings cut out of their text, other columns as they were.

    Where a cut splits a letter, its other bytes go too. ``chars``, if there is such a column, gets
    the new number of letters. A null text stays null; a text that is all repeats becomes empty.
    Rows are told apart by numbers of their own, not by ``id_col``: they may share an id or have none.
    """
    others = [c for c in docs.columns if c != text]
    data = docs.select(
        F.col(text).cast("binary").alias("data"),
        F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"),
        F.col(text).isNull().alias("none"),
    )
    rows = _with_ranges(data, length).select("row", "none", "packed", "ranges")
    kind = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                None if none.as_py() else _without(unpack(packed.as_py()), found.as_py())[0].decode("utf-8", "ignore")
                for none, packed, found in zip(*batch.columns[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    cleaned = rows.mapInArrow(cut, kind)

    def column(c: str):
        if c == text:
            return F.col("text").alias(c)
        return F.length("text").cast(docs.schema[c].dataType).alias(c) if c == chars else F.col(f"row.`{c}`").alias(c)

    return cleaned.select(*(column(c) for c in docs.columns))
