"""Quality classifier: regularised quadratic discriminant on document statistics.

Each text gives a small vector of transformed statistics (``STATISTICS``).  Each
class of the labelled rows has a mean and a covariance; the covariance is shrunk
towards the pooled one and towards a multiple of the identity, and factorised by
Cholesky once.  A score is the sigmoid of the difference of the two Gaussian
log-densities (Mahalanobis terms by triangular solves) plus the log prior ratio.

Defined cases: a null text is an empty one, and an empty text has the zero vector
and a score like any other.  Null labels and labels other than 0 and 1 teach
nothing; repeated rows count as often as they occur.  With labels of one class
only, the score is 0.99 (label 1) or 0.01 everywhere, without labels 0.5.  An empty table
gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlens.llm._tables import held_out, materialize
from fraudlens.llm._words import Words, as_bytes, blocks

STATISTICS = ["log_words", "log_word_length", "spread_of_length", "symbols", "capitals", "digits", "stops",
              "repeats_previous", "log_distinct", "top_word", "symbol_words", "symbol_ends", "lines", "non_ascii"]

_KIND = {k: np.zeros(256, dtype=np.float32) for k in ("symbol", "capital", "letter", "digit", "stop", "line", "high")}
_KIND["symbol"][[ord(c) for c in "!#$%&*|@^~<>{}[]\\/=+_`"]] = 1
_KIND["capital"][ord("A"):ord("Z") + 1] = 1
_KIND["letter"][ord("A"):ord("Z") + 1] = _KIND["letter"][ord("a"):ord("z") + 1] = 1
_KIND["letter"][128:] = 0.5
_KIND["high"][128:] = 0.5
_KIND["digit"][ord("0"):ord("9") + 1] = 1
_KIND["stop"][[ord(c) for c in ".,;:?"]] = 1
_KIND["line"][10] = 1


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS a text."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for lo, hi in blocks(texts):
        out[lo:hi] = _block(texts[lo:hi])
    return out


def _block(texts: list[bytes]) -> np.ndarray:
    w = Words(texts)
    n = len(texts)
    raw = np.frombuffer(w.data, dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = ends - [len(t) + 1 for t in texts]

    def per_text(kind: str) -> np.ndarray:
        return np.add.reduceat(_KIND[kind][raw], starts, dtype=np.float64)

    words = np.diff(w.first).astype(float)
    some = np.maximum(words, 1)
    doc = np.repeat(np.arange(n), np.diff(w.first))
    length = (w.end - w.start).astype(float)
    mean = np.bincount(doc, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(doc, length * length, n) / some - mean * mean, 0))
    size = np.maximum(np.array([len(t) for t in texts], dtype=float), 1)
    again = np.zeros(len(doc))
    if len(doc) > 1:
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((w.hash, doc))
    new = np.ones(len(doc), dtype=bool)
    if len(doc) > 1:
        new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(doc)))
    top = np.zeros(n)
    np.maximum.at(top, doc[order][at], times)
    distinct = np.bincount(doc[order][at], minlength=n)
    letters_to = np.concatenate(([0], np.cumsum(_KIND["letter"][raw] + _KIND["digit"][raw], dtype=np.float64)))
    bare = letters_to[w.end] == letters_to[w.start]
    tail = _KIND["symbol"][raw[w.end - 1]] if len(doc) else np.zeros(0)
    letters = np.maximum(per_text("letter"), 1)
    return np.column_stack([
        np.log1p(words), np.log1p(mean), np.log1p(spread), np.sqrt(per_text("symbol") / size),
        np.sqrt(per_text("capital") / letters), np.sqrt(per_text("digit") / size), np.sqrt(per_text("stop") / some),
        np.sqrt(np.bincount(doc, again, n) / some), np.log((distinct + 1) / (words + 1)), np.sqrt(top / some),
        np.sqrt(np.bincount(doc, bare, n) / some), np.sqrt(np.bincount(doc, tail, n) / some),
        np.log1p(10 * per_text("line") / some), np.sqrt(per_text("high") / size)])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and its vector ``x``, for every row."""
    def run(batches):
        for b in batches:
            x = statistics(as_bytes(b.column("text")))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()),
                 pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())],
                names=["doc_id", "x"])
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, x array<double>")


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and constants of the two classes."""

    mean: np.ndarray
    whiten: np.ndarray
    constant: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        at = [self.constant[k] - 0.5 * (((x - self.mean[k]) @ self.whiten[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return at[1] - at[0]


def fit(rows: DataFrame, pooled: float = 0.1, ridge: float = 0.02) -> Discriminant | float:
    """From rows of (label, x).  ``pooled`` and ``ridge`` are the shares of the
    pooled covariance and of the identity (scaled to its mean variance).  Without
    both classes: the score that holds everywhere."""
    d = len(STATISTICS)

    def sums(batches):
        total = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
        for b in batches:
            label = np.asarray(b.column("label"))
            x = np.asarray(b.column("x").flatten()).reshape(-1, d)
            for k in (0, 1):
                own = x[label == k]
                total[k] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.int32([0, 1]), len(total[0]))),
                                          pa.array(np.tile(np.arange(len(total[0]), dtype=np.int32), 2)),
                                          pa.array(np.concatenate((total[0], total[1])))], names=["label", "at", "v"])

    # 2 * (1 + d + d*d) sums reach the driver, whatever the input.
    got = rows.mapInArrow(sums, "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for r in got:
        total[r.label, r.at] = r.v
    n = total[:, 0]
    if n.min() < 1:
        return 0.5 if n.max() < 1 else float(0.99 if n[1] else 0.01)
    mean = total[:, 1:d + 1] / n[:, None]
    cov = [total[k, d + 1:].reshape(d, d) / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)]
    both = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    whiten, constant = [], []
    for k in (0, 1):
        s = (1 - pooled) * cov[k] + pooled * both
        s = (1 - ridge) * s + ridge * max(np.trace(both) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky((s + s.T) / 2)
        whiten.append(np.linalg.inv(factor))
        constant.append(np.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(mean, np.array(whiten), np.array(constant))


def score(stats: DataFrame, model: Discriminant | float, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of rows of ``document_statistics``."""
    d = len(STATISTICS)

    def run(batches):
        for b in batches:
            x = np.asarray(b.column("x").flatten()).reshape(-1, d)
            p = np.full(len(x), model) if isinstance(model, float) else \
                1 / (1 + np.exp(-np.clip(model.log_odds(x), -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])
    return stats.mapInArrow(run, "doc_id bigint, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Score every row of ``docs``; learn from the labelled rows not held out."""
    stats = materialize(document_statistics(docs), "quality-statistics")
    known = (labels.filter(F.col("quality").isin(0, 1) & ~held_out())
             .select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("label")))
    model = fit(stats.join(known, "doc_id").select("label", "x"))
    return score(stats, model, threshold).withColumn("held_out", held_out())
