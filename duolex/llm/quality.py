"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the covariance pooled
over the classes and then towards its own diagonal. A document's score is the
logistic of the difference of the two log densities (Mahalanobis distances by
cached inverse Cholesky factors) and of the classes' shares.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, text_key

STATISTICS = ("words", "word_length", "distinct", "upper", "symbols", "digits", "points", "repeated_lines", "commonest", "adjacent", "line_length", "odd_ends")
#: Shrinkage towards the pooled covariance, then towards the diagonal; the least variance.
POOLED, DIAGONAL, LEAST = 0.2, 0.05, 1e-4
#: Log density differences are divided by this before the logistic, as statistics aren't quite normal.
SOFTEN = 3.0
KEEP = 0.3
#: Added to the counts that shares are taken of, so that a few words decide little.
PRIOR = 8

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-()?"]] = True


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text, in STATISTICS' order; shares by square roots, counts by logarithms."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    chars = sum(map(len, words))
    ends = sum(not x[-1].isalnum() and x[-1] not in ".,;:'\")?!" for x in counts)
    return [
        np.log1p(n),
        np.log(chars / n),
        np.log(len(counts) + PRIOR) / np.log(n + PRIOR),
        (sum(map(str.isupper, words)) / (n + PRIOR)) ** 0.5,
        (raw[_SYMBOLS].sum() / (chars + PRIOR)) ** 0.5,
        (raw[48:58].sum() / (chars + 5 * PRIOR)) ** 0.5,
        ((raw[44] + raw[46]) / (n + PRIOR)) ** 0.5,
        ((len(lines) - len(set(lines))) / (len(lines) + PRIOR)) ** 0.5,
        (max(counts.values()) / (n + PRIOR)) ** 0.5,
        (sum(map(eq, words, words[1:])) / (n + PRIOR)) ** 0.5,
        np.log1p(n / len(lines)),
        (ends / (len(counts) + PRIOR)) ** 0.5,
    ]


def with_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text_key and the statistics as columns, for every row; null and empty texts have zeros."""
    source = df.select(id_col, text_col, text_key(text_col).alias("text_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            x = np.array([statistics(t) for t in texts], np.float64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(c) for c in x.T)], names=[id_col, "text_key", *STATISTICS])

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, ", ".join([f"`{id_col}` {kind}", "text_key binary", *(f"{x} double" for x in STATISTICS)]))


@dataclass
class Discriminant:
    """Mean, inverse Cholesky factor and half log determinant of class 0 and class 1, and the log ratio of their shares."""

    means: np.ndarray
    factors: np.ndarray
    half_logs: np.ndarray
    log_odds: float

    def differences(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, and the log odds."""
        z = [(x - m) @ f.T for m, f in zip(self.means, self.factors)]
        logs = [-0.5 * (a * a).sum(axis=1) - h for a, h in zip(z, self.half_logs)]
        return (logs[1] - logs[0]) + self.log_odds

    def score(self, columns: tuple[str, ...] = STATISTICS) -> Column:
        """The score as a column expression over the statistics."""
        at = [F.col(c) for c in columns]

        def log_density(k: int) -> Column:
            total = F.lit(-float(self.half_logs[k]))
            for row in self.factors[k]:
                z = sum((float(w) * (c - float(m)) for w, c, m in zip(row, at, self.means[k]) if w), F.lit(0.0))
                total = total - 0.5 * z * z
            return total

        margin = (log_density(1) - log_density(0) + float(self.log_odds)) / SOFTEN
        return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), margin))))


def fit(learned: DataFrame, label: str, columns: tuple[str, ...] = STATISTICS) -> Discriminant | None:
    """Moments of each class over all rows whose label is 0 or 1, summed where the rows are; two rows of sums come to the driver. None without both classes."""
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)] + [F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"p{i}_{j}") for i, j in pairs]
    rows = {r[label]: r for r in learned.filter(F.col(label).isin(0, 1)).groupBy(label).agg(F.count("*").alias("n"), *sums).collect()}
    if set(rows) != {0, 1}:
        return None
    counts, means, covariances = [], [], []
    for k in (0, 1):
        r = rows[k]
        m = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
        c = np.zeros((d, d))
        for i, j in pairs:
            c[i, j] = c[j, i] = r[f"p{i}_{j}"] / r["n"] - m[i] * m[j]
        counts.append(r["n"])
        means.append(m)
        covariances.append(c)
    pooled = sum(n * c for n, c in zip(counts, covariances)) / sum(counts)
    factors, half_logs = [], []
    for c in covariances:
        c = (1 - POOLED) * c + POOLED * pooled
        c = (1 - DIAGONAL) * c + DIAGONAL * np.diag(np.diag(c)) + LEAST * np.eye(d)
        cholesky = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(cholesky))
        half_logs.append(np.log(np.diag(cholesky)).sum())
    return Discriminant(np.array(means), np.array(factors), np.array(half_logs), float(np.log(counts[1] / counts[0])))


def score_quality(df: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """id_col, text_key (MD5 of the text) and score (0 to 1, higher: label 1 likelier) of every row of df.

    labels: id_col and the label; rows with null or other labels and ids that
    df lacks teach nothing; an id with several labels teaches each. learn: a
    condition on id_col; labels of other rows aren't used. The statistics are
    computed once and written, as the fit and the scores both read them. If one
    class has no rows every score is 0.5.
    """
    scratch = Scratch(df.sparkSession)
    stats = scratch.save(with_statistics(df, id_col, text_col), "statistics")
    known = labels.select(F.col(id_col), F.col(label).alias("__label")).filter(learn & F.col(id_col).isNotNull())
    model = fit(stats.join(known, id_col), "__label")
    return stats.select(id_col, "text_key", (model.score() if model else F.lit(0.5)).alias("score"))
