"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, small_batches

#: Families (fixed values; a parameter). A language in none is a family of its own.
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance"}
UNKNOWN = "und"
#: Hash buckets of byte pairs and triples.
WIDTH = 2048
#: Different texts of each language that are learned from at most (the first by a hash of id and text), and those of all
#: languages together: where many languages would exceed it, each has an equal part, one at least.
FIT_ROWS, FIT_ALL = 1000, 32_000
STEPS, RIDGE = 200, 1e-4

LETTER = re.compile(r"[^\W\d_]")


def vector(text: str) -> np.ndarray:
    """Damped counts of hashed byte pairs and triples of the text in lower case, of length 1 (0 for no text)."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    b = b[(b < 48) & (b != 32) & (b != 10) ^ True] if len(b) else b
    b = b.astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(263) + b[2:] + np.uint32(1 << 20)
    shift = np.uint32(32 - WIDTH.bit_length() + 1)
    found = np.bincount(two * np.uint32(2654435761) >> shift, minlength=WIDTH) + np.bincount(three * np.uint32(2654435761) >> shift, minlength=WIDTH)
    out = np.sqrt(found, dtype=np.float32)
    return out / max(float(np.linalg.norm(out)), 1e-9)


def svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear support vector machine with squared hinge loss, by accelerated gradient steps. y: -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = last = np.zeros(x.shape[1], np.float32)
    rate = 0.25
    for k in range(STEPS):
        v = w + (k / (k + 3)) * (w - last)
        gap = np.maximum(0, 1 - y * (x @ v))
        last, w = w, v - rate * (RIDGE * v - 2 * x.T @ (weight * y * gap))
    return w


@dataclass
class Hierarchy:
    """families: each family's languages. over: family against the rest. within: pair of languages, the first is positive."""

    families: dict[str, list[str]] = field(default_factory=dict)
    over: dict[str, np.ndarray] = field(default_factory=dict)
    within: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row: the logistic of the winner's least margin."""
        n = len(x)
        if not self.families:
            return np.full(n, UNKNOWN, object), np.zeros(n)
        x = np.hstack([x, np.ones((n, 1), np.float32)])
        names = list(self.families)
        margins = np.stack([x @ self.over[f] for f in names], axis=1) if self.over else np.full((n, 1), 9.0)
        best = margins.argmax(axis=1)
        least = margins.max(axis=1)
        out = np.full(n, UNKNOWN, object)
        for k, family in enumerate(names):
            rows = np.nonzero(best == k)[0]
            own = self.families[family]
            votes, sums = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
            low = np.full((len(rows), len(own)), 9.0)
            for (i, a), (j, b) in combinations(enumerate(own), 2):
                m = x[rows] @ self.within[a, b]
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                sums[:, i] += m
                sums[:, j] -= m
                low[:, i], low[:, j] = np.minimum(low[:, i], m), np.minimum(low[:, j], -m)
            win = (votes + 1e-3 * np.tanh(sums)).argmax(axis=1) if len(rows) else np.zeros(0, int)
            out[rows] = np.array(own, object)[win]
            least[rows] = np.minimum(least[rows], low[np.arange(len(rows)), win])
        return out, 1 / (1 + np.exp(-3.0 * np.clip(least, -5, 5)))


def train(x: np.ndarray, langs: list[str], families: dict[str, str] = FAMILIES) -> Hierarchy:
    if not langs:
        return Hierarchy()
    langs_of = np.array(langs, object)
    family_of = np.array([families.get(a, f"only {a}") for a in langs], object)
    made = Hierarchy({f: sorted({*langs_of[family_of == f]}) for f in sorted({*family_of})})
    if len(made.families) > 1:
        made.over = {f: svm(x, np.where(family_of == f, 1, -1).astype(np.float32)) for f in made.families}
    for own in made.families.values():
        for a, b in combinations(own, 2):
            rows = np.isin(langs_of, [a, b])
            made.within[a, b] = svm(x[rows], np.where(langs_of[rows] == a, 1, -1).astype(np.float32))
    return made


def fit(df: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, families: dict[str, str]) -> Hierarchy:
    """The machines from a bounded number of rows of each language, whose vectors come to the driver. Rows, not ids, are chosen, and equal rows once, so that an id with many rows teaches no more than others."""
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    known = df.filter(learn & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), key.alias("key"))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()}  # a row for each language
    if not sizes:
        return Hierarchy()
    each = max(1, min(FIT_ROWS, FIT_ALL // len(sizes)))
    # a cut on the hash leaves some more than are wanted of each language, so that what is ranked and sent is small
    cuts = [(lang, min(int((1.5 * each + 20) / max(1, n) * 2.0**64) - (1 << 63), (1 << 63) - 1)) for lang, n in sizes.items()]
    cuts = F.broadcast(df.sparkSession.createDataFrame(cuts, "lang string, cut long"))
    chosen = known.join(cuts, "lang").filter(F.col("key") <= F.col("cut"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for part, texts in slices(batches, 1):
            rows = [k for k, x in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist())) if not (x in seen or seen.add(x))]
            made = pa.array([vector(texts[k]).astype(np.float16).tobytes() for k in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), part.column(2).take(pa.array(rows, pa.int64())), made], names=["lang", "key", "x"])

    made = chosen.select("lang", "text", "key").mapInArrow(run, "lang string, key long, x binary").dropDuplicates(["lang", "key"])
    first = F.row_number().over(Window.partitionBy("lang").orderBy("key"))  # over some 1.5 * each rows
    data = made.withColumn("place", first).filter(F.col("place") <= each).orderBy("lang", "key").collect()
    x = np.frombuffer(b"".join(r.x for r in data), np.float16).reshape(len(data), WIDTH).astype(np.float32)
    return train(x, [r.lang for r in data], families)


def predict_language(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", families: dict[str, str] = FAMILIES) -> DataFrame:
    """id_col, lang_pred and score (0 to 1) of every row of df.

    Rows for which learn holds teach with their text and non-null language. A
    null text or one without any letter is "und" with score 0; so is every row
    if nothing can be learned. Repeated rows each get a result.
    """
    small_batches(df.sparkSession)
    source = df.select(id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(fit(df, learn, id_col, text_col, lang_col, families))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            lang, score = shared.value.predict(np.stack([vector(t) for t in texts]))
            none = np.array([LETTER.search(t) is None for t in texts])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.where(none, UNKNOWN, lang), pa.string()), pa.array(np.where(none, 0.0, score), pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
