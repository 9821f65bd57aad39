"""Language-model scores of texts: the marginal probability over all segmentations into subword pieces.

The pieces are those of an existing vocabulary. Their probabilities start from its scores and are
fitted by expectation-maximisation over the lattices of all distinct training words; a word's
probability is the sum over all its segmentations (forward recursion in log space). A word of the
training documents is itself one more piece of its lattice: with absolute discounting, of the N
training tokens with V distinct ones, c occurrences weigh (c - D) / N and the subword lattice D V / N.
A text's probability is the product over its words and the end. These are probabilities: over all
words and the end they add up to one. Beside it stands a base: the add-one unigram of words.

Documents are packed into batches once. A batch asks for the counts and probabilities of its distinct
words, gets them back by a join, and scores its documents on its own; so words travel once per batch,
not per use, and only words that no training document has are segmented there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook.llm.lattice import (
    BLANK,
    LITERAL_BLANK,
    Edges,
    Matcher,
    Numbered,
    load_vocabulary,
    rank_log_probabilities,
)
from duebook.llm.scratch import Scratch

BATCH_BYTES = 16 << 20
WORDS_AT_ONCE = 30_000


def _batches(docs: DataFrame) -> DataFrame:
    """Documents (``doc``, ``text`` bytes, ``held_out``) as rows of about 16 MB: lower-cased, joined and packed."""
    kind = docs.schema["doc"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, texts, size = [], [], [], 0
        key_type = None

        def whole() -> pa.RecordBatch:
            data = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([keys], pa.list_(key_type)),
                    pa.array([held], pa.list_(pa.bool_())),
                    pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                    pa.array([data], pa.binary()),
                ],
                names=["docs", "held_out", "lengths", "packed"],
            )

        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, text, out in zip(*batch.columns, strict=True):
                keys.append(key.as_py())
                held.append(out.as_py())
                texts.append((text.as_py() or b"").lower())
                size += len(texts[-1])
                if size >= BATCH_BYTES:
                    yield whole()
                    keys, held, texts, size = [], [], [], 0
        if keys:
            yield whole()

    rows = docs.select("doc", "text", "held_out").mapInArrow(
        packed, f"docs array<{kind}>, held_out array<boolean>, lengths array<bigint>, packed binary"
    )
    return rows.withColumn("batch", F.monotonically_increasing_id())


def _texts(lengths, packed: bytes) -> Iterator[bytes]:
    data = zstandard.ZstdDecompressor().decompress(packed) if sum(lengths) else b""
    at = 0
    for n in lengths:
        yield data[at : at + n]
        at += n


def _batch_words(batches: DataFrame) -> DataFrame:
    """``batch``, ``word`` and how often it occurs in the batch's training documents, for its distinct words."""

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in rows:
            for batch, held, lengths, packed in zip(*record.columns, strict=True):
                found: Counter = Counter()
                others: set = set()
                for text, out in zip(_texts(lengths.as_py(), packed.as_py()), held.as_py(), strict=True):
                    if out:
                        others.update(text.split())
                    else:
                        found.update(text.split())
                words = [*found, *others.difference(found)]
                counts = [*found.values(), *[0] * (len(words) - len(found))]
                for at in range(0, len(words), 50_000):
                    some = words[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([batch.as_py()] * len(some), pa.int64()),
                            pa.array(some, pa.binary()),
                            pa.array(counts[at : at + 50_000], pa.int64()),
                        ],
                        names=["batch", "word", "n"],
                    )

    return batches.select("batch", "held_out", "lengths", "packed").mapInArrow(
        counted, "batch long, word binary, n long"
    )


def _units(words: list[bytes]) -> list[str]:
    return [BLANK + w.decode().replace(BLANK, LITERAL_BLANK) for w in words]


def expected_pieces(edges: Edges, log_p: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the units, each taken ``times`` often."""
    weights = edges.weights(log_p)
    forward, backward = edges.forward(weights), edges.backward(weights)
    unit = np.repeat(np.arange(len(edges.sizes)), edges.sizes + 1)[edges.tail]
    share = np.exp(forward[edges.tail] + weights + backward[edges.head] - edges.totals(forward)[unit]) * times[unit]
    plain = edges.piece >= 0
    out = np.bincount(edges.piece[plain], share[plain], minlength=len(log_p))
    for piece in np.unique(edges.piece[~plain]):
        for one in edges.matcher.bytes_of(int(piece)):
            out[one] += share[edges.piece == piece].sum()
    return out


def fit_pieces(
    words: DataFrame, matcher: Matcher, log_p: np.ndarray, rounds: int = 2, prior: float = 0.01
) -> np.ndarray:
    """Log probabilities of pieces, from all distinct training words (column ``word``).

    Each round takes the expected pieces of every word under the last probabilities, summed by task
    and then by piece. Each distinct word counts once: the lattice has to tell which words there
    are, how frequent the known ones are is told by their counts. ``prior`` is added to every piece
    that may stand in a lattice, so without words all are equally likely.
    """
    usable = np.isfinite(log_p)
    for _ in range(rounds):

        def partial(batches: Iterator[pa.RecordBatch], log_p=log_p) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(log_p))
            for batch in batches:
                for at in range(0, batch.num_rows, WORDS_AT_ONCE):
                    some = _units(batch.column(0).slice(at, WORDS_AT_ONCE).to_pylist())
                    total += expected_pieces(matcher.match(some), log_p, np.ones(len(some)))
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["piece", "n"])

        sums = words.select("word").mapInArrow(partial, "piece long, n double")
        table = sums.groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.where(usable, prior, 0.0)
        counts[table["piece"].to_numpy(np.int64)] += table["n"]
        with np.errstate(divide="ignore"):
            log_p = np.log(counts / counts.sum())
    return log_p


def log_marginals(words: list[bytes], matcher: Matcher, log_p: np.ndarray) -> np.ndarray:
    """The log probability of each word, summed over its segmentations."""
    out = np.zeros(len(words))
    for at in range(0, len(words), WORDS_AT_ONCE):
        edges = matcher.match(_units(words[at : at + WORDS_AT_ONCE]))
        out[at : at + WORDS_AT_ONCE] = edges.totals(edges.forward(edges.weights(log_p)))
    return out


def with_marginals(words: DataFrame, matcher: Matcher, log_p: np.ndarray) -> DataFrame:
    """The counted words with ``marginal``, so that a word is segmented once and not in each batch."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = log_marginals(batch.column(0).to_pylist(), matcher, log_p)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=["word", "c", "marginal"])

    return words.select("word", "c").mapInArrow(marked, "word binary, c long, marginal double")


def discount(once: int, twice: int) -> float:
    """What is taken from each count: by how many words occur once and twice, between 0.1 and 0.9."""
    return min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5


def score(
    docs: DataFrame,
    model_path: str,
    held_out: Column,
    id_col: str = "doc_id",
    text: str = "text",
    rounds: int = 2,
) -> DataFrame:
    """Per document ``doc_id``, ``held_out``, ``n_tokens`` (words and the end), ``n_known``, ``train_tokens``,
    ``base_score``, ``score`` and ``lattice_score`` (words by subwords alone), log10 probabilities of the whole text.

    Learns from rows for which ``held_out`` is false. A-Z are lower-cased; words are cut at space and
    the characters 9 to 13. A null or empty text is the end alone. Rows with the same id each get a
    score. Without training rows all counts are 0 and words have their lattice's probability.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lattice-lm")
    rows = docs.select(
        F.col(id_col).alias("doc"), F.col(text).cast("binary").alias("text"), F.coalesce(held_out, F.lit(True)).alias("held_out")
    )
    batches = scratch.put(_batches(rows), "batches")
    asked = scratch.put(_batch_words(batches), "batch_words")
    words = asked.where("n > 0").groupBy("word").agg(F.sum("n").alias("c"))
    words = scratch.put(words, "words")
    sums = words.agg(
        F.count(F.lit(1)).alias("v"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
        F.count_if(F.col("c") == 1).alias("once"),
        F.count_if(F.col("c") == 2).alias("twice"),
    ).first()
    ends = batches.select(F.explode("held_out").alias("h")).where("NOT h").count()
    n, v = sums["n"] + ends, sums["v"] + (ends > 0)
    vocabulary = load_vocabulary(model_path, lower_case=True)
    matcher = Matcher(vocabulary)
    log_p = fit_pieces(words, matcher, rank_log_probabilities(vocabulary), rounds)
    taken = discount(sums["once"], sums["twice"])
    log_rest = float(np.log(taken * v / n)) if n else 0.0
    words = scratch.put(with_marginals(words, matcher, log_p), "marginals")
    scratch.drop("words")
    known = asked.select("batch", "word").join(words, "word")
    kind = rows.schema["doc"].dataType.simpleString()
    per_ten = 1 / np.log(10)

    def base_of(c):
        return np.log10((c + 1) / (n + v + 1))

    def of_counts(c):
        with np.errstate(divide="ignore"):
            return np.log(np.maximum(c - taken, 0) / max(n, 1))

    def scored(packed: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score"]
        if not len(packed):
            return pd.DataFrame({c: [] for c in names})
        row = packed.iloc[0]
        place = Numbered()
        texts = []
        for text in _texts(row["lengths"], row["packed"]):
            found = text.split()
            texts.append(np.fromiter(map(place.__getitem__, found), np.int32, len(found)))
        own = list(place)
        c, whole = np.zeros(len(own), np.int64), np.zeros(len(own))
        found = [place[w] for w in counts["word"]]
        c[found], whole[found] = counts["c"].to_numpy(), counts["marginal"].to_numpy()
        new = np.flatnonzero(c == 0)
        whole[new] = log_marginals([own[k] for k in new], matcher, log_p)
        base, end_base = base_of(c), float(base_of(ends))
        marginal = np.logaddexp(of_counts(c), log_rest + whole)
        log_end = float(of_counts(ends)) if ends else log_rest
        out = []
        for key, held, at in zip(row["docs"], row["held_out"], texts, strict=True):
            out.append(
                (
                    key,
                    bool(held),
                    len(at) + 1,
                    int((c[at] > 0).sum()) + (ends > 0),
                    n,
                    float(base[at].sum()) + end_base,
                    float(marginal[at].sum() + log_end) * per_ten,
                    float(whole[at].sum() + log_end) * per_ten,
                )
            )
        return pd.DataFrame(out, columns=names)

    return (
        batches.groupBy("batch")
        .cogroup(known.groupBy("batch"))
        .applyInPandas(
            scored,
            f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double",
        )
    )
