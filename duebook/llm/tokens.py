"""Token ids of whole texts by a public tokenizer file, with the ids of frequent pieces of text kept.

Byte-level BPE cuts a text before every run of blanks that follows something else, and between
letters and marks, so a text's ids are those of its pieces, one after the other.
Pieces met before are looked up, others are encoded by the tokenizers library; pieces between single
blanks are numbered over many texts, so that each different one is looked up once, and kept if it
occurs twice among them. Texts with rarer
blanks, whose cuts depend on what stands next to them, are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Between single blanks a text can be cut by ``split``; with runs of blanks, pieces are looked for.
RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\r")
PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
OTHER_BLANKS = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B))
)
#: A line end, letters and marks: letters are never cut, nor are marks up to a blank, so the model's
#: merges can be asked for at once. The apostrophe isn't among the marks, it starts pieces of its own.
WORD = re.compile(r"(\n?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
LONGEST_KEPT = 40
#: Letters of the texts whose pieces are numbered together.
CHUNK = 8 << 20
_ENCODERS: dict[tuple, Encoder] = {}


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it can be seen, else from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in seen}
    hidden = (b for b in range(256) if b not in letters)
    return letters | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Pieces(dict):
    """Ids by piece, in two generations of at most ``most`` pieces: one that is met again stays.

    A piece stands without the blank before it if ``blank`` is given.
    """

    def __init__(self, tokenizer, most: int, blank: str = ""):
        super().__init__()
        self.tokenizer, self.most, self.blank, self.old = tokenizer, most, blank, {}
        self.model = tokenizer.model
        self.letter_of = byte_letters()
        self.spelled_blank = self.letter_of[32] if blank else ""
        self.marks: dict[str, bytes] = {}
        self.line_end = self._ids("\n")

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _merged(self, blank: str, letters: str) -> bytes:
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(self.letter_of)
        spelled = self.spelled_blank + letters if blank else letters
        return array("I", [token.id for token in self.model.tokenize(spelled)]).tobytes()

    def _mark_ids(self, marks: str) -> bytes:
        ids = self._ids(marks)
        if len(self.marks) < 10_000:
            self.marks[marks] = ids
        return ids

    def _fresh(self, piece: str) -> bytes:
        word = WORD.fullmatch(piece)
        if not word:
            return self._ids(piece if piece[:1] == "\n" else self.blank + piece)
        line, letters, marks = word.groups()
        if not line and not marks:
            return self._merged(self.blank, letters)
        ids = self.line_end + self._merged("", letters) if line else self[letters]
        return ids + (self.marks.get(marks) or self._mark_ids(marks)) if marks else ids

    def ids(self, piece: str, keep: bool) -> bytes:
        """A piece's ids, kept for later if asked to."""
        return self[piece] if keep or piece in self.old else self._fresh(piece)

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self._fresh(piece)
            if len(piece) > LONGEST_KEPT:
                return ids
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Ids of a text as unsigned 32-bit numbers in native (little-endian) bytes.

    They are those of the library with ``add_special_tokens=False``: a special token's text gives its id.
    It holds no blank, so a text can be cut at blanks all the same, and a piece with it is encoded whole.
    """

    def __init__(self, path: str, most_kept: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.after_blank = _Pieces(self.tokenizer, most_kept, " ")
        self.others = _Pieces(self.tokenizer, most_kept // 4)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; pieces between single blanks are looked up once for all texts, and kept if met twice."""
        out, single = [b""] * len(texts), []
        for k, text in enumerate(texts):
            if not text or any(run in text for run in RUNS) or any(blank in text for blank in OTHER_BLANKS):
                out[k] = self.encode(text)
            else:
                single.append(k)
        if not single:
            return out
        split = pc.split_pattern(pa.array([texts[k].replace("\n", " \n") for k in single], pa.large_string()), " ")
        pieces = split.flatten().dictionary_encode()
        starts, distinct = split.offsets.to_numpy(), pieces.dictionary.to_pylist()
        piece = pieces.indices.to_numpy().astype(np.int64)
        firsts = [distinct[k] for k in piece[starts[:-1]].tolist()]
        piece[starts[:-1]] = len(distinct) + np.arange(len(single))
        used = np.bincount(piece, minlength=len(distinct))[: len(distinct)]
        met, known = self.after_blank.get, self.after_blank.ids
        ids = [(met(p) or known(p, n > 1)) if n else b"" for p, n in zip(distinct, used.tolist(), strict=True)]
        ids += [self.others[p] if p else b"" for p in firsts]
        flat = np.frombuffer(b"".join(ids), np.uint32)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin, lengths_here = (np.cumsum(lengths) - lengths)[piece], lengths[piece]
        ends = np.cumsum(lengths_here)
        # a batch's texts have less than 2**31 bytes, and no more ids than bytes
        place = np.repeat((begin - (ends - lengths_here)).astype(np.int32), lengths_here)
        place += np.arange(len(place), dtype=np.int32)
        data = flat[place].tobytes()
        bounds = (4 * np.concatenate([[0], ends])[starts]).tolist()
        for k, a, b in zip(single, bounds, bounds[1:], strict=False):
            out[k] = data[a:b]
        return out

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(blank in text for blank in OTHER_BLANKS):
            return self.others._ids(text)
        if any(run in text for run in RUNS):
            return b"".join(map(self.others.__getitem__, PIECE.findall(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        start = self.others[first] if first else b""
        if rest and not rest[-1]:
            return start + b"".join(map(self.after_blank.__getitem__, rest[:-1])) + self.others[" "]
        return start + b"".join(map(self.after_blank.__getitem__, rest))


def encoder(path: str, most_kept: int = 800_000) -> Encoder:
    """The encoder of this process for a file."""
    key = (path, most_kept)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, most_kept)
    return _ENCODERS[key]


def encode_stream(path: str, texts: Iterable[str | None], end_id: int | None) -> Iterator[bytes]:
    """The ids of each text in turn (null: none), with ``end_id`` after them."""
    own = encoder(path)
    end = b"" if end_id is None else array("I", [end_id]).tobytes()
    some, size = [], 0
    for text in texts:
        some.append(text or "")
        size += len(some[-1])
        if size >= CHUNK:
            yield from (ids + end for ids in own.encode_many(some))
            some, size = [], 0
    yield from (ids + end for ids in own.encode_many(some))
