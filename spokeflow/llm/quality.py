"""Quality classifier: regularised quadratic discriminant analysis on statistics of whole texts.

Each text gives a few shares (upper case, symbols, repeated words, ...), smoothed for short texts and transformed to be near
normal. Every class has a mean and a covariance; the covariance is drawn towards that of both classes together, and then
towards equal variances without correlation, so it can be inverted whatever the labels are. The score is the probability of
label 1, from the difference of the log-densities, whose Mahalanobis distances use Cholesky factors computed once.

Means and covariances come from sums that Spark combines, over all labelled rows; what reaches the driver is one row per
class of a fixed number of sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeflow.llm import words
from spokeflow.session import checkpointed

FEATURES = (
    "word_length", "upper", "symbols", "stops", "repeats", "near_repeats", "signs_only", "short", "line_ends"
)
# Weight of both classes' covariance in each one's, and of equal variances in the result.
POOLED, SPHERICAL = 0.05, 0.01
HOLD_OUT = 5
THRESHOLD = 0.3

CODES = np.arange(256)
UPPER = (CODES >= 0x41) & (CODES <= 0x5A)
LETTER = UPPER | ((CODES >= 0x61) & (CODES <= 0x7A)) | (CODES >= 0xC0)
DIGIT = (CODES >= 0x30) & (CODES <= 0x39)
STOP = np.isin(CODES, [ord(c) for c in ".,"])
SYMBOL = (CODES > 0x20) & (CODES < 0x7F) & ~LETTER & ~DIGIT & ~STOP & ~np.isin(CODES, [ord(c) for c in "'-"])
CONTINUED = (CODES & 0xC0) == 0x80


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[at])


def statistics(scan: words.Scan, codes: np.ndarray) -> np.ndarray:
    """One row of features per text; an empty text has the value each share is smoothed towards."""
    data, at = scan.data, scan.text_at
    chars, letters = _per_text(~CONTINUED[data], at), _per_text(LETTER[data], at)
    n = np.diff(scan.word_at)
    hashes = scan.hashes(codes)
    text_of = np.repeat(np.arange(len(n)), n)

    def same(lag: int) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        out[lag:] = (hashes[lag:] == hashes[:-lag]) & (text_of[lag:] == text_of[:-lag])
        return out

    wordy = np.concatenate(([0], np.cumsum(LETTER[data] | DIGIT[data], dtype=np.int64)))
    signs = wordy[scan.ends] == wordy[scan.starts]
    starts = np.concatenate(([0], np.cumsum(~CONTINUED[data], dtype=np.int64)))
    length = starts[scan.ends] - starts[scan.starts]
    share = lambda count, of, usual, weight: np.sqrt((count + usual * weight) / (of + weight))
    again = same(1)
    return np.column_stack(
        [
            np.log((_per_text(length, scan.word_at) + 5.0 * 10) / (n + 10)),
            share(_per_text(UPPER[data], at), letters, 0.02, 30),
            share(_per_text(SYMBOL[data], at), chars, 0.001, 150),
            share(_per_text(STOP[data], at), chars, 0.025, 50),
            share(_per_text(again, scan.word_at), n, 0.01, 20),
            share(_per_text((same(2) | same(3)) & ~again, scan.word_at), n, 0.02, 20),
            share(_per_text(signs, scan.word_at), n, 0.001, 20),
            share(_per_text(length <= 3, scan.word_at), n, 0.35, 20),
            share(_per_text(data == 10, at), chars, 0.005, 50),
        ]
    )


def features(text: str | Column) -> Column:
    """The features of each text as an array of doubles. NULL is empty."""

    @F.arrow_udf("array<double>")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codes = words.byte_codes(words.BETWEEN_SPACES)
        for texts in batches:
            rows = [statistics(scan, codes) for scan in words.scans(texts, words.BETWEEN_SPACES)]
            flat = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
            offsets = np.arange(len(flat) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))

    return compute(text)


@dataclass
class Discriminant:
    """Per class (label 0, label 1): log of the prior, mean, inverse Cholesky factor of the covariance, its log-determinant."""

    priors: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        log = [
            prior - 0.5 * (((x - mean) @ factor.T) ** 2).sum(axis=1) - 0.5 * log_det
            for prior, mean, factor, log_det in zip(self.priors, self.means, self.factors, self.log_dets, strict=True)
        ]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Per label: rows, sums and sums of products of the features (``label``, ``x``)."""
    p = len(FEATURES)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    x = [F.get("x", F.lit(i)) for i in range(p)]
    found = rows.groupBy("label").agg(
        F.count("*"), *[F.sum(v) for v in x], *[F.sum(x[i] * x[j]) for i, j in pairs]
    )
    out = {}
    for label, n, *sums in found.collect():  # a row per class
        products = np.zeros((p, p))
        for (i, j), value in zip(pairs, sums[p:], strict=True):
            products[i, j] = products[j, i] = value
        out[label] = n, np.array(sums[:p]), products
    return out


def fit(rows: DataFrame, pooled: float = POOLED, spherical: float = SPHERICAL) -> Discriminant | None:
    """Learn from rows of ``label`` (0 or 1) and ``x``; None unless there are rows of both."""
    found = moments(rows.where("label in (0, 1)"))
    if len(found) < 2:
        return None
    n, sums, products = (np.array([found[label][i] for label in (0, 1)]) for i in range(3))
    means = sums / n[:, None]
    scatter = products - n[:, None, None] * means[:, :, None] * means[:, None, :]
    own, both = scatter / n[:, None, None], scatter.sum(axis=0) / n.sum()
    shrunk = (1 - pooled) * own + pooled * both
    size = np.trace(shrunk, axis1=1, axis2=2) / len(FEATURES)
    shrunk = (1 - spherical) * shrunk + spherical * np.maximum(size, 1e-9)[:, None, None] * np.eye(len(FEATURES))
    factors = np.linalg.cholesky(shrunk)
    log_dets = 2 * np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1)
    return Discriminant(np.log(n / n.sum()), means, np.linalg.inv(factors), log_dets)


def scored(x: str | Column, model: Discriminant | None) -> Column:
    """The probability of label 1; 0.5 without a model."""
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            values = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.array(model.score(values), pa.float64())

    return score(x)


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HOLD_OUT == 0, F.lit(False))


def learned(rows: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant | None:
    """A model of ``label`` from rows of ``doc_id`` and ``x``; held-out rows are never looked at. A document that is labelled
    several times counts as often."""
    wanted = labels.where(~held_out("doc_id")).select("doc_id", F.col(label).alias("label"))
    return fit(rows.join(wanted, "doc_id").select("label", "x"))


def classified(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``documents`` (``doc_id``, ``text``).

    Each row is judged by its own text, repeated ones too. NULL and empty texts have the features of a text of no remarkable
    share.
    """
    rows = checkpointed(documents.select("doc_id", features("text").alias("x")))
    model = learned(rows, labels)
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), scored("x", model).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that the classifier does not reject; all columns."""
    model = learned(documents.select("doc_id", features("text").alias("x")), labels)
    return documents.where(scored(features("text"), model) >= THRESHOLD)
