"""Lattices of subword pieces over many words at once.

A unit is what a piece can't reach beyond: a run without blanks, with the blank before it as its first
letter. The pieces that fit into a batch of distinct units are found together by hashes of letter
runs, one length after the other; sums over all segmentations go through the units' positions
together, in log space. A letter that no piece spells is spelled by the pieces of its UTF-8 bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLANK = "▁"
#: Stands for a blank sign that is really in the text; no text of valid UTF-8 holds it.
LITERAL_BLANK = "\ud800"
_PRIME = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 20


class Numbered(dict):
    """Numbers things in the order they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


@dataclass
class Vocabulary:
    """Pieces by id, those of single bytes, and which ids may stand in a lattice."""

    pieces: list[str]
    byte_ids: list[int]
    ranks: np.ndarray

    @property
    def usable(self) -> list[int]:
        return [i for i, p in enumerate(self.pieces) if p]

    def surfaces(self) -> list[bytes]:
        """The bytes each id stands for."""
        out = [p.replace(BLANK, " ").encode() for p in self.pieces]
        for value, one in enumerate(self.byte_ids):
            out[one] = bytes([value])
        return out


def load_vocabulary(path: str, lower_case: bool = False) -> Vocabulary:
    """The pieces of a sentencepiece model with byte pieces, ranked by the order of its scores.

    Control pieces, unknown, and pieces with a blank after their first letter can't stand in a lattice.
    ``lower_case`` leaves out pieces with A-Z.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, scores = [], [0] * 256, []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:-1], 16)] = i
        fine = not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        fine = fine and BLANK not in piece[1:] and not (lower_case and any("A" <= c <= "Z" for c in piece))
        pieces.append(piece if fine else "")
        scores.append(model.get_score(i))
    ranks = np.empty(len(pieces), np.int64)
    ranks[np.argsort(-np.array(scores), kind="stable")] = np.arange(len(pieces))
    return Vocabulary(pieces, byte_ids, ranks)


def rank_log_probabilities(vocabulary: Vocabulary) -> np.ndarray:
    """Natural log probabilities that fall with the rank of a piece; byte pieces get the least of them."""
    log_p = np.full(len(vocabulary.pieces), -np.inf)
    usable = np.array(vocabulary.usable)
    log_p[usable] = -np.log(vocabulary.ranks[usable] + 10.0)
    log_p[vocabulary.byte_ids] = -np.log(len(log_p) + 10.0)
    return log_p - np.logaddexp.reduce(log_p[np.isfinite(log_p)])


class Matcher:
    """Finds the pieces in batches of units. Small enough to be sent to tasks."""

    def __init__(self, vocabulary: Vocabulary):
        by_length: dict[int, list[int]] = {}
        for i in vocabulary.usable:
            by_length.setdefault(len(vocabulary.pieces[i]), []).append(i)
        self.byte_ids = np.array(vocabulary.byte_ids)
        self.tables = {}
        self.prefixes = {}
        for length, ids in by_length.items():
            codes = np.frombuffer("".join(vocabulary.pieces[i] for i in ids).encode("utf-32-le"), np.uint32)
            h = np.zeros(len(ids), np.uint64)
            for place, column in enumerate(codes.reshape(-1, length).T, 1):
                h = (h + column + np.uint64(1)) * _PRIME
                self.prefixes[place] = np.union1d(self.prefixes.get(place, h[:0]), h)
            order = np.argsort(h)
            self.tables[length] = (h[order], np.array(ids)[order], codes.reshape(-1, length)[order])
        self._filters: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return {"byte_ids": self.byte_ids, "tables": self.tables, "prefixes": self.prefixes, "_filters": {}}

    def _filter(self, length: int) -> np.ndarray:
        """By a run's hash: 0 if no piece starts with it, 2 if a piece of this length may be it, else 1."""
        if length not in self._filters:
            seen = np.zeros(1 << FILTER_BITS, np.uint8)
            seen[(self.prefixes[length] * _MIX) >> np.uint64(64 - FILTER_BITS)] = 1
            if length in self.tables:
                seen[(self.tables[length][0] * _MIX) >> np.uint64(64 - FILTER_BITS)] = 2
            self._filters[length] = seen
        return self._filters[length]

    def match(self, units: list[str]) -> Edges:
        """All pieces in the units as edges between positions, sorted by the position they end at."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum(sizes) - sizes
        unit = np.repeat(np.arange(len(units)), sizes)
        room = np.repeat(first + sizes, sizes) - np.arange(len(codes))  # letters from here to the unit's end
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        starts, lengths, ids = [], [], []
        spelled = np.zeros(len(codes), bool)
        for length in range(1, max(self.tables, default=0) + 1):
            fits = room[at] >= length
            at, h = at[fits], h[fits]
            if not len(at):
                break
            h = (h + codes[at + length - 1] + np.uint64(1)) * _PRIME
            kind = self._filter(length)[(h * _MIX) >> np.uint64(64 - FILTER_BITS)]
            starting = np.flatnonzero(kind)
            at, h, kind = at[starting], h[starting], kind[starting]
            if length not in self.tables:
                continue
            keys, pieces, letters = self.tables[length]
            maybe = np.flatnonzero(kind == 2)
            found = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
            true = keys[found] == h[maybe]
            maybe, found = maybe[true], found[true]
            if len(maybe):
                same = (codes[at[maybe][:, None] + np.arange(length)] == letters[found]).all(axis=1)
                maybe, found = maybe[same], found[same]
            starts.append(at[maybe])
            lengths.append(np.full(len(maybe), length))
            ids.append(pieces[found])
            if length == 1:
                spelled[at[maybe]] = True
        bare = np.flatnonzero(~spelled)
        starts.append(bare)
        lengths.append(np.ones(len(bare), np.int64))
        ids.append(-1 - codes[bare].astype(np.int64))
        start, length, piece = np.concatenate(starts), np.concatenate(lengths), np.concatenate(ids)
        tail = start + unit[start]  # positions: one more than letters in each unit
        head = tail + length
        order = np.argsort(head, kind="stable")
        return Edges(units, first + np.arange(len(units)), sizes, tail[order], head[order], piece[order], self)

    def bytes_of(self, piece: int) -> list[int]:
        """The byte pieces that spell the letter of an edge without a piece."""
        letter = chr(-1 - piece)
        if letter == LITERAL_BLANK:
            letter = BLANK
        elif letter == BLANK:
            letter = " "
        return [int(self.byte_ids[b]) for b in letter.encode("utf-8")]


@dataclass
class Edges:
    """``tail`` and ``head`` are positions of all units, one unit after the other, from ``first``."""

    units: list[str]
    first: np.ndarray
    sizes: np.ndarray
    tail: np.ndarray
    head: np.ndarray
    piece: np.ndarray
    matcher: Matcher

    def weights(self, log_p: np.ndarray) -> np.ndarray:
        """The log probability of each edge; an edge without a piece has that of its bytes."""
        out = log_p[np.maximum(self.piece, 0)]
        bare, which = np.unique(self.piece[self.piece < 0], return_inverse=True)
        own = np.array([log_p[self.matcher.bytes_of(int(b))].sum() for b in bare])
        if len(bare):
            out[self.piece < 0] = own[which]
        return out

    def forward(self, weights: np.ndarray) -> np.ndarray:
        """For every position, the log of the summed probability of all ways from its unit's start."""
        return _recursion(self.first, self.sizes, self.tail, self.head, weights, False)

    def backward(self, weights: np.ndarray) -> np.ndarray:
        """For every position, the log of the summed probability of all ways to its unit's end."""
        return _recursion(self.first, self.sizes, self.tail, self.head, weights, True)

    def totals(self, forward: np.ndarray) -> np.ndarray:
        """The log probability of each unit over all its segmentations."""
        return forward[self.first + self.sizes]


def _recursion(first, sizes, tail, head, weights, backward: bool) -> np.ndarray:
    """Sums position by position, for all units at the same distance from their start (or end) together."""
    n = int(sizes.sum() + len(sizes))
    value = np.full(n, -np.inf)
    value[first + sizes if backward else first] = 0
    source, target = (head, tail) if backward else (tail, head)
    unit_of = np.repeat(np.arange(len(sizes)), sizes + 1)
    place = target - first[unit_of[target]] if len(target) else target
    step = sizes[unit_of[target]] - place if backward and len(target) else place
    order = np.lexsort((target, step)) if backward or (np.diff(step) < 0).any() else np.arange(len(step))
    source, target, step, weights = source[order], target[order], step[order], weights[order]
    bounds = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]])) if len(step) else np.zeros(0, np.int64)
    for a, b in zip(bounds, np.append(bounds[1:], len(step)), strict=True):
        terms = value[source[a:b]] + weights[a:b]
        new = np.concatenate([[True], target[a + 1 : b] != target[a : b - 1]])
        at = np.flatnonzero(new)
        most = np.maximum.reduceat(terms, at)
        most = np.where(np.isfinite(most), most, 0)
        sums = np.add.reduceat(np.exp(terms - np.repeat(most, np.diff(np.append(at, b - a)))), at)
        with np.errstate(divide="ignore"):
            value[target[a:b][at]] = most + np.log(sums)
    return value
