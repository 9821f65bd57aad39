"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts become counts of hashed letter n-grams (one to three, over lower-cased letters with everything
else as one blank). Document frequencies come from all training rows. The weights are trained by
follow-the-regularised-leader with an elastic-net penalty on a bounded sample per language, and a
temperature, fitted on a part of the sample that the weights don't see, turns the scores into
probabilities. Prediction reads each whole text once and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
UNKNOWN = "und"
BLANK = 32
_FOLD: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """The lower-case letter of each of the first 65,536 characters, a blank for what isn't a letter."""
    if not _FOLD:
        table = np.full(0x10000, BLANK, np.uint32)
        for code in range(0x10000):
            letter = chr(code)
            if letter.isalpha():
                low = letter.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _FOLD.append(table)
    return _FOLD[0]


def ngram_counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in a whole text."""
    table = _fold_table()
    counts = np.zeros(BUCKETS, np.int64)
    last = np.full(2, BLANK, np.uint32)
    for at in range(0, len(text), 1 << 20):
        codes = np.frombuffer(text[at : at + (1 << 20)].encode("utf-32-le", "surrogatepass"), np.uint32)
        folded = np.where(codes < 0x10000, table[np.minimum(codes, 0xFFFF)], codes)
        folded = folded[np.concatenate([[True], (folded[1:] != BLANK) | (folded[:-1] != BLANK)])]
        c = np.concatenate([last, folded])
        one, two = c * np.uint32(0x9E3779B1), c * np.uint32(0x85EBCA6B)
        pair = two[:-1] ^ (one[1:] >> np.uint32(3)) ^ one[1:]
        triple = (pair[:-1] * np.uint32(0xC2B2AE35)) ^ (two[2:] >> np.uint32(5)) ^ one[2:]
        for grams in (one[2:], pair[1:] * np.uint32(0x27D4EB2F), triple * np.uint32(0x165667B1)):
            counts += np.bincount(grams >> np.uint32(32 - BUCKET_BITS), minlength=BUCKETS)
        last = c[-2:]
    return counts


@dataclass
class LanguageModel:
    """Weights by bucket and language, the buckets' inverse document frequencies, and the temperature."""

    languages: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0
    info: dict = field(default_factory=dict)

    def vector(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[buckets]
        return x / max(np.sqrt(x @ x), 1e-12)

    def classify(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        counts = ngram_counts(text)
        buckets = np.flatnonzero(counts)
        scores = self.vector(buckets, counts[buckets]) @ self.weights[buckets] / self.temperature
        scores = np.exp(scores - scores.max())
        best = int(scores.argmax())
        return self.languages[best], float(scores[best] / scores.sum())


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """Rows with a text, and in how many of them each bucket occurs: all rows, summed by task and then by bucket."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for value in batch.column(0):
                if (whole := value.as_py()) is not None:
                    n += 1
                    found += ngram_counts(whole) > 0
        buckets = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(buckets, -1)), pa.array(np.append(found[buckets], n))], ["bucket", "n"]
        )

    rows = (
        docs.select(F.col(text))
        .mapInArrow(partial, "bucket long, n long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    found = np.zeros(BUCKETS)
    real = rows[rows["bucket"] >= 0]
    found[real["bucket"].to_numpy(np.int64)] = real["n"]
    return int(rows.loc[rows["bucket"] < 0, "n"].sum()), found


def _sample(docs: DataFrame, counts: dict[str, int], per_language: int, id_col: str, text: str, lang: str):
    """About ``per_language`` rows of each language, chosen by a hash of the id, as bucket counts."""
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col(lang) == name, F.lit(min(1.0, per_language / n))).otherwise(share)
    place = (F.xxhash64(F.col(id_col).cast("string")) / F.lit(float(1 << 64))) + 0.5

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [ngram_counts(t) for t in batch["_text"]]
            buckets = [np.flatnonzero(c) for c in found]
            yield pd.DataFrame(
                {
                    "place": batch["_place"],
                    "lang": batch["_lang"],
                    "buckets": [b.astype(np.int32) for b in buckets],
                    "counts": [c[b].astype(np.int32) for c, b in zip(found, buckets, strict=True)],
                }
            )

    rows = docs.where(place < share).select(
        place.alias("_place"), F.col(lang).alias("_lang"), F.col(text).alias("_text")
    )
    return (
        rows.mapInPandas(counted, "place double, lang string, buckets array<int>, counts array<int>")
        .toPandas()
        .sort_values(["place", "lang"], kind="stable")
    )


def train_weights(
    examples: list[tuple[np.ndarray, np.ndarray, int]],
    classes: int,
    epochs: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.02,
) -> np.ndarray:
    """Follow-the-regularised-leader, one step per example; weights the l1 term holds back are zero."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return -np.sign(zs) * np.maximum(np.abs(zs) - l1, 0) / ((beta + np.sqrt(ns)) / alpha + l2)

    for _ in range(epochs):
        for buckets, x, label in examples:
            zs, ns = z[buckets], n[buckets]
            w = weights(zs, ns)
            scores = x @ w
            p = np.exp(scores - scores.max())
            p /= p.sum()
            p[label] -= 1
            g = np.outer(x, p)
            step = (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha
            z[buckets] = zs + g - step * w
            n[buckets] = ns + g * g
    return weights(z, n)


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature between 0.05 and 20 with the smallest log loss."""
    if not len(labels):
        return 1.0
    grid = np.geomspace(0.05, 20, 121)
    losses = []
    for t in grid:
        s = scores / t
        top = s.max(axis=1)
        total = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        losses.append((total - s[np.arange(len(labels)), labels]).mean())
    return float(grid[int(np.argmin(losses))])


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = 1000,
    **options,
) -> LanguageModel:
    """A model from all rows with a text and a language.

    ``per_language`` bounds the rows of each language that the weights are trained on; counts and
    document frequencies take all rows. Every fifth sampled row is kept for the temperature. Without
    any labelled row the model knows no language and predicts ``und``.
    """
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(id_col, text, lang)
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    languages = sorted(counts)
    n, found = document_frequencies(labelled, text)
    model = LanguageModel(languages, np.zeros((BUCKETS, len(languages))), np.log((1 + n) / (1 + found)) + 1)
    if not languages:
        return model
    rows = _sample(labelled, counts, per_language, id_col, text, lang)
    examples = [
        (b := np.asarray(r.buckets, np.int64), model.vector(b, np.asarray(r.counts)), languages.index(r.lang))
        for r in rows.itertuples()
    ]
    held = examples[::5]
    model.weights = train_weights([e for k, e in enumerate(examples) if k % 5], len(languages), **options)
    scores = np.array([x @ model.weights[b] for b, x, _ in held]).reshape(len(held), len(languages))
    labels = np.array([label for *_, label in held], np.int64)
    model.temperature = fit_temperature(scores, labels)
    model.info = {
        "rows": n,
        "sampled": len(examples),
        "held_accuracy": float((scores.argmax(axis=1) == labels).mean()) if len(held) else None,
        "zero_weights": float((model.weights == 0).mean()),
    }
    return model


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows with ``lang_pred`` and ``score``; ``und`` and 0 where a text is null or has no letter.

    Nothing but the text is looked at. Columns of these names are replaced, others are passed through.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*(F.col(f"`{c}`") for c in names), F.col(text).alias("_text"))

    def classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.classify(t.as_py()) for t in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(names)],
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                names=[*names, "lang_pred", "score"],
            )

    kind = T.StructType(
        [docs.schema[c] for c in names]
        + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    return rows.mapInArrow(classified, kind)


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """True for rows no model may learn from: by the crc32 of the id's text. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(True))


def keep(docs: DataFrame, least_score: float = 0.5, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose text is in one of the languages with at least ``least_score``; columns as they were."""
    model = fit(docs.where(~held_out(id_col)), id_col, text, lang)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    judged = predict(docs.select(whole, F.col(text).alias("_judged")), model, "_judged")
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("_row.*")
