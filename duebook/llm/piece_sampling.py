"""Sampled segmentations into sentencepiece pieces: forward filtering, backward sampling.

A text is cut at its blanks into units. Over the lattice of a unit's pieces the forward sums are taken
once per distinct unit of a chunk, and not again for units that a chunk before held twice; then each occurrence walks back from its end and draws the piece
that ends there in proportion to its share. Draws are a hash of the row's key, the unit's place and
the position, so a row gets the same pieces wherever and however often it is encoded. Nothing is
normalised: pieces and byte pieces spell the text exactly, and decoding gives it back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.llm.lattice import BLANK, LITERAL_BLANK, Matcher, load_vocabulary, rank_log_probabilities

CHUNK = 4 << 20
#: Letters of the lattices that a process keeps, about 60 bytes each.
MOST_KEPT = 3 << 20
_MODELS: dict[tuple, Sampler] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _put(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """The array with the values from ``at`` on, in a larger or smaller one where that is needed."""
    end = at + len(values)
    if not end <= len(array) <= max(4 * end, 1 << 20):
        array = np.concatenate([array[:at], np.empty(max(end, 2 * at) - at, array.dtype)])
    array[at:end] = values
    return array


class Lattices:
    """Units' lattices, ready to be walked back; those of units that a chunk holds twice are kept for later chunks.

    ``first`` and ``size`` are per unit: its first position and its letters. The edges that end at a position
    start at ``into``; per edge there are the letters of its ``piece`` and the sum of its share and those before it
    (``bound``), which is beyond 1 for the position's last. If more than ``most`` letters are kept, all are forgotten.
    """

    def __init__(self, matcher: Matcher, log_p: np.ndarray, most: int = MOST_KEPT):
        self.matcher, self.log_p, self.most = matcher, log_p, most
        self.forget()

    def forget(self) -> None:
        self.kept: dict[str, int] = {}
        self.positions = self.edges = 0
        self.first, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.into = np.empty(0, np.int64)
        self.letters, self.piece, self.bound = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0)

    def numbers(self, units: list[str], counts: np.ndarray) -> np.ndarray:
        """The number of each unit's lattice, given how often it occurs. Numbers hold until the next call."""
        if self.positions > self.most:
            self.forget()
        found = np.fromiter((self.kept.get(u, -1) for u in units), np.int64, len(units))
        fresh = np.flatnonzero(found < 0)
        fresh = fresh[np.argsort(counts[fresh] < 2, kind="stable")]
        if len(fresh):
            at, more = len(self.kept), int((counts[fresh] > 1).sum())
            found[fresh] = at + np.arange(len(fresh))
            self._add(at, [units[k] for k in fresh.tolist()], more)
            self.kept.update((units[k], at + j) for j, k in enumerate(fresh[:more].tolist()))
        return found

    def _add(self, at: int, units: list[str], more: int) -> None:
        """Put the units' lattices behind those that are kept, and keep the first ``more`` of them."""
        edges = self.matcher.match(units)
        weights = edges.weights(self.log_p)
        forward = edges.forward(weights)
        bound = np.exp(forward[edges.tail] + weights - forward[edges.head])
        into = np.concatenate([[0], np.cumsum(np.bincount(edges.head, minlength=len(forward)))])
        rank = np.arange(len(bound)) - into[edges.head]
        later, k = np.flatnonzero(rank), 1
        while len(later):
            now = later[rank[later] == k]
            bound[now] += bound[now - 1]
            later, k = later[rank[later] > k], k + 1
        bound[into[1:][into[1:] > into[:-1]] - 1] = 2
        self.first = _put(self.first, at, self.positions + edges.first)
        self.size = _put(self.size, at, edges.sizes)
        self.into = _put(self.into, self.positions, self.edges + into[:-1])
        self.letters = _put(self.letters, self.edges, edges.head - edges.tail)
        self.piece = _put(self.piece, self.edges, edges.piece)
        self.bound = _put(self.bound, self.edges, bound)
        positions = int(edges.first[more]) if more < len(units) else len(forward)
        self.positions, self.edges = self.positions + positions, self.edges + int(into[positions])


class Sampler:
    """Draws segmentations with probability proportional to the product of the pieces' probabilities to ``alpha``."""

    def __init__(self, path: str, alpha: float = 0.5, seed: int = 42):
        vocabulary = load_vocabulary(path)
        self.matcher, self.seed = Matcher(vocabulary), seed
        self.log_p = alpha * rank_log_probabilities(vocabulary)
        self.lattices = Lattices(self.matcher, self.log_p)
        self.surfaces = np.array(vocabulary.surfaces(), object)

    def encode(self, keys: list, texts: list[str]) -> list[np.ndarray]:
        """The sampled ids of each text."""
        if not texts:
            return []
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        starts = split.offsets.to_numpy()
        words = split.flatten().dictionary_encode()
        distinct = [w.replace(BLANK, LITERAL_BLANK) for w in words.dictionary.to_pylist()]
        word = words.indices.to_numpy()
        first = np.zeros(len(word), bool)
        first[starts[:-1]] = True
        there = np.ones(len(word), bool)  # all but the nothing before a text's first blank
        there[first] = [distinct[k] != "" for k in word[first].tolist()]
        counts = np.bincount(word[~first], minlength=len(distinct))
        rest = np.flatnonzero(counts)
        heads, of_head, head_counts = np.unique(word[first & there], return_inverse=True, return_counts=True)
        units = [BLANK + distinct[k] for k in rest.tolist()] + [distinct[k] for k in heads.tolist()]
        numbers = self.lattices.numbers(units, np.concatenate([counts[rest], head_counts]))
        of_word = np.zeros(len(distinct), np.int64)
        of_word[rest] = numbers[: len(rest)]
        unit = of_word[word]
        unit[first & there] = numbers[len(rest) :][of_head]
        sizes = np.add.reduceat(there, starts[:-1], dtype=np.int64)
        seeds = np.array([xxhash.xxh64_intdigest(str(k), self.seed) for k in keys], np.uint64)
        ends = np.cumsum(sizes)
        place = np.arange(int(ends[-1])) - np.repeat(ends - sizes, sizes)
        draw = _mixed(np.repeat(seeds, sizes) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        ids, stops = self._walk(unit[there], draw)
        return np.split(ids, np.concatenate([[0], stops])[ends[:-1]])

    def _walk(self, unit: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all occurrences, one after the other, and where each occurrence ends."""
        own = self.lattices
        base, place, who = own.first[unit], own.size[unit], np.arange(len(unit))
        total = np.zeros(len(unit), np.int64)
        walked, steps = [], []
        while len(who):
            u = _mixed(draw + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
            u = (u >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = own.into[base + place]
            beyond = np.flatnonzero(u >= own.bound[edge])
            while len(beyond):
                edge[beyond] += 1
                beyond = beyond[u[beyond] >= own.bound[edge[beyond]]]
            walked.append(who)
            steps.append(own.piece[edge])
            total[who] += 1
            place = place - own.letters[edge]
            more = np.flatnonzero(place)
            base, place, who, draw = base[more], place[more], who[more], draw[more]
        pieces = np.concatenate([np.zeros(0, np.int32), *steps])
        bare, letter = np.unique(pieces[pieces < 0], return_inverse=True)
        spelled = [self.matcher.bytes_of(int(b)) for b in bare]
        wide = np.array([len(s) for s in spelled], np.int64)
        table = np.array([s + [0] * (4 - len(s)) for s in spelled], np.uint32).reshape(-1, 4)
        by_step = np.split(letter, np.cumsum([int((p < 0).sum()) for p in steps])[:-1]) if steps else []
        for who, piece, letter in zip(walked, steps, by_step, strict=True):
            total[who[piece < 0]] += wide[letter] - 1
        ends = np.cumsum(total)
        out, at = np.zeros(int(total.sum()), np.uint32), ends.copy()
        for who, piece, letter in zip(walked, steps, by_step, strict=True):
            at[who] -= 1
            spelt = who[piece < 0]
            at[spelt] -= wide[letter] - 1
            out[at[who]] = piece.astype(np.uint32)
            for k in range(4):
                long = wide[letter] > k
                out[at[spelt[long]] + k] = table[letter[long], k]
        return out, ends

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes that ids spell."""
        return b"".join(self.surfaces[ids].tolist())


def sampler(path: str, alpha: float, seed: int) -> Sampler:
    """The sampler of this process."""
    key = (path, alpha, seed)
    if key not in _MODELS:
        _MODELS[key] = Sampler(path, alpha, seed)
    return _MODELS[key]


def sample_stream(own: Sampler, rows: Iterable[tuple]) -> Iterator[tuple]:
    """Key, text and ids of (key, text) rows, about 4 million letters at a time. A null text has no ids."""
    keys, texts, size = [], [], 0

    def done():
        return zip(keys, texts, own.encode(keys, [t or "" for t in texts]), strict=True)

    for key, text in rows:
        keys.append(key)
        texts.append(text)
        size += len(text or "")
        if size >= CHUNK:
            yield from done()
            keys, texts, size = [], [], 0
    if keys:
        yield from done()


def encode(
    docs: DataFrame,
    model_path: str,
    alpha: float = 0.5,
    seed: int = 42,
    id_col: str = "doc_id",
    text: str = "text",
    digest: bool = False,
) -> DataFrame:
    """``doc_id`` and ``ids`` (unsigned 32-bit, little-endian), or with ``digest`` their number, their crc32 and
    whether decoding gave the text's bytes back (``lossless``).

    A null or empty text has no ids. Rows with the same id and text get the same ids.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    columns = "n_pieces long, ids_crc32 long, lossless boolean" if digest else "ids binary"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(model_path, alpha, seed)
        for batch in batches:
            rows = ((k.as_py(), t.as_py()) for k, t in zip(batch.column(0), batch.column(1), strict=True))
            keys, out = [], []
            for key, value, ids in sample_stream(own, rows):
                keys.append(key)
                data = ids.astype("<u4").tobytes()
                out.append((len(ids), zlib.crc32(data), own.decode(ids) == (value or "").encode()) if digest else (data,))
            types = [pa.int64(), pa.int64(), pa.bool_()] if digest else [pa.binary()]
            values = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batch.schema.field(0).type), *(pa.array(v, t) for v, t in zip(values, types, strict=True))],
                names=["doc_id", *(c.split()[0] for c in columns.split(", "))],
            )

    return docs.select(F.col(id_col), F.col(text)).mapInArrow(encoded, f"doc_id {kind}, {columns}")


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id`` and ``text`` of encoded rows; null ids give a null text."""
    kind = rows.schema[id_col].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(model_path, 0.5, 42)
        for batch in batches:
            texts = [
                own.decode(np.frombuffer(v.as_py(), "<u4")).decode() if v.is_valid else None for v in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col), F.col(ids)).mapInArrow(decoded, f"doc_id {kind}, text string")
