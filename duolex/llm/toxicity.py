"""Toxicity: a logistic classifier over words and word beginnings that is held to equal scores under swapped identity terms.

The fit's objective, as objective() computes it, is

    mean of cost * logistic loss  +  FAIR * mean square of score changes  +  RIDGE / 2 * squared weights

over the labelled rows. cost makes both classes weigh alike. A score change is
that of a labelled sentence's log odds when one of the identity terms that it
names is replaced by another one or left out (counterfactual logit pairing,
Garg et al. 2019); a change of the score itself is at most a quarter of it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, small_batches

#: Neutral names of groups, swapped with each other (fixed values; a parameter of fit).
IDENTITY = (
    "women", "men", "girls", "boys", "gay", "straight", "lesbian", "bisexual", "transgender",
    "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant",
    "black", "white", "asian", "african", "european", "american", "latino", "arab", "immigrant",
    "refugee", "disabled", "deaf", "blind", "elderly", "young", "frauen", "männer", "juden",
    "muslime", "christen", "femmes", "hommes", "juifs", "musulmans", "mujeres", "hombres",
)
#: Labelled rows that are learned from at most (the first by a hash), and features that are kept.
FIT_ROWS, FEATURES = 20_000, 2048
#: Documents of the fit that a feature is in at least.
LEAST_DOCUMENTS = 3
#: Length of the word beginnings.
STEM = 5
#: Weights of the objective's other parts.
RIDGE, FAIR = 5e-5, 1.0
#: Gradient steps, their momentum, and the step sizes for weights and bias.
STEPS, MOMENTUM, RATE, BIAS_RATE = 300, 0.9, 10.0, 2.0

WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str) -> set[str]:
    """The distinct words in lower case, and the beginnings of longer words followed by a star."""
    words = set(WORD.findall(text.lower()))
    return words | {f"{w[:STEM]}*" for w in words if len(w) >= STEM}


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def margin(self, text: str) -> float:
        words = set(WORD.findall(text.lower()))
        get = self.weights.get
        own = words & self.weights.keys()
        stems = {f"{w[:STEM]}*" for w in words if len(w) >= STEM} & self.weights.keys()
        return self.bias + sum(map(get, own)) + sum(map(get, stems))


def swapped(features: set[str], term: str, other: str) -> set[str]:
    """The features of the sentence with other in term's place."""
    return (features - features_of(term)) | features_of(other)


def swap_matrix(rows: list[list[str]], at: dict[str, int], identity: tuple[str, ...]) -> np.ndarray:
    """The matrix A for which w'Aw is the mean square of the score changes of the labelled sentences under swapped terms.

    Each sentence that names groups counts once, however many variants it has:
    each of its terms replaced by each other term and left out. Sentences with
    the same features of terms have the same changes and are counted together.
    If no sentence names a group, each bare term against none is all there is.
    """
    own = {t: features_of(t) for t in identity}
    relevant = set().union(*own.values()) if own else set()
    seen = Counter(key for key in (frozenset(relevant.intersection(r)) for r in rows) if any(t in key for t in identity))
    out = np.zeros((len(at), len(at)))
    for key, times in (seen or Counter(frozenset(x) for x in own.values())).items():
        variants = [v for t in identity if t in key for v in (key - own[t], *(swapped(set(key), t, o) for o in identity if o != t))]
        for v in variants:
            signs = [(at[f], 1.0 if f in v else -1.0) for f in key ^ v]
            for i, x in signs:
                for j, y in signs:
                    out[i, j] += x * y * times / len(variants)
    return out / max(1, sum(seen.values()) or len(own))


@dataclass
class Rows:
    """Labelled rows as feature places, each row's, one after the other; cost and label of each."""

    cols: np.ndarray
    owner: np.ndarray
    cost: np.ndarray
    y: np.ndarray
    features: int

    @staticmethod
    def of(rows: list[list[str]], labels: list[int], at: dict[str, int]) -> Rows:
        y = np.array(labels, np.float64)
        share = y.mean()
        count = np.array([sum(f in at for f in r) for r in rows], np.int64)
        cols = np.fromiter((at[f] for r in rows for f in r if f in at), np.int64)
        return Rows(cols, np.repeat(np.arange(len(rows)), count), np.where(y == 1, 0.5 / share, 0.5 / (1 - share)), y, len(at))

    def loss(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        """Mean of cost * logistic loss, and its slopes in the weights and the bias."""
        z = b + np.bincount(self.owner, w[self.cols], len(self.y))
        g = self.cost * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - self.y) / len(self.y)
        return float((self.cost * np.logaddexp(0, np.where(self.y == 1, -z, z))).mean()), np.bincount(self.cols, g[self.owner], self.features), float(g.sum())


def objective(data: Rows, swap: np.ndarray, held: np.ndarray, w: np.ndarray, b: float, ridge: float = RIDGE, fair: float = FAIR) -> tuple[float, np.ndarray, float]:
    """What the fit minimises, and its slopes. swap: swap_matrix over the features at the places held."""
    value, slope, bias = data.loss(w, b)
    slope = slope + ridge * w
    slope[held] += 2 * fair * (swap @ w[held])
    return value + float(fair * w[held] @ swap @ w[held] + ridge / 2 * w @ w), slope, bias


def train(rows: list[list[str]], labels: list[int], names: list[str], identity: tuple[str, ...] = IDENTITY, ridge: float = RIDGE, fair: float = FAIR) -> Model:
    """Weights that minimise objective(). rows: each labelled sentence's features.

    The part with the score changes may be much steeper than the rest, so each
    step goes down the slope of the others and then to the exact minimum of
    that part around the point reached (a proximal step).
    """
    names = [*dict.fromkeys([*names, *(f for t in identity for f in sorted(features_of(t)))])]
    if not 0 < sum(labels) < len(labels):
        return Model({}, 0.0)
    data = Rows.of(rows, labels, {f: i for i, f in enumerate(names)})
    share = data.y.mean()
    w, b, vw, vb = np.zeros(len(names)), float(np.log(share / (1 - share))), np.zeros(len(names)), 0.0
    swap, held = swaps_of(rows, names, identity)
    nearest = np.linalg.inv(np.eye(len(held)) + RATE * 2 * fair * swap)
    for _ in range(STEPS):
        _, slope, bias = data.loss(w, b)
        after = w + MOMENTUM * vw - RATE * (slope + ridge * w)
        after[held] = nearest @ after[held]
        w, vw = after, after - w
        vb = MOMENTUM * vb - BIAS_RATE * bias
        b += vb
    return Model(dict(zip(names, w.tolist())), float(b))


def swaps_of(rows: list[list[str]], names: list[str], identity: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """swap_matrix over the identity terms' features, and their places in names."""
    terms = [*dict.fromkeys(f for t in identity for f in sorted(features_of(t)))]
    at = {f: i for i, f in enumerate(names)}
    return swap_matrix(rows, {f: i for i, f in enumerate(terms)}, identity), np.array([at[f] for f in terms], np.int64)


def fit(df: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label: str, identity: tuple[str, ...] = IDENTITY) -> Model:
    """The model from at most FIT_ROWS labelled rows; both the rows' kept features and the counts that choose features come from these.

    Rows, not ids, are chosen, and equal rows once, so that an id with many
    rows is bounded like any other.
    """
    scratch = Scratch(df.sparkSession)
    known = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__label"))
    known = known.withColumnRenamed("__id", id_col).filter(learn & F.col(id_col).isNotNull() & F.col("__label").isin(0, 1)).distinct()
    sample = known.orderBy(F.xxhash64(id_col), "__label").limit(FIT_ROWS)
    keyed = df.select(F.col(id_col), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("__key"))
    thin = keyed.drop("text").join(F.broadcast(sample), id_col).distinct()  # FIT_ROWS ids
    thin = scratch.save(thin.orderBy(F.xxhash64(id_col, "__key"), "__label").limit(FIT_ROWS), "sample")
    rows = keyed.join(F.broadcast(thin), [id_col, "__key"])  # FIT_ROWS rows and what equals them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for part, texts in slices(batches, 0):
            own = [k for k, x in enumerate(zip(*(part.column(c).to_pylist() for c in (1, 2, 3)))) if not (x in seen or seen.add(x))]
            made = pa.array([sorted(features_of(texts[k])) for k in own], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(own, pa.int64())) for c in (1, 2, 3)), made], names=["id", "label", "key", "features"])

    kind = df.schema[id_col].dataType.simpleString()
    made = rows.select("text", id_col, "__label", "__key").mapInArrow(run, f"id {kind}, label int, key long, features array<string>")
    made = scratch.save(made.dropDuplicates(["id", "label", "key"]), "features")
    size = {r.label: r["count"] for r in made.groupBy("label").count().collect()}
    if len(size) < 2:
        return Model({}, 0.0)
    seen = made.select("label", F.explode("features").alias("f")).groupBy("f").agg(F.sum("label").alias("one"), F.count("*").alias("n"))
    p1, p0 = (F.col("one") + 0.5) / (size[1] + 1), (F.col("n") - F.col("one") + 0.5) / (size[0] + 1)
    best = seen.filter(F.col("n") >= LEAST_DOCUMENTS).orderBy(F.desc(F.abs(F.log(p1 / p0)) * F.sqrt("n")), "f").limit(FEATURES)
    names = [r.f for r in best.select("f").collect()]
    kept = F.array_intersect("features", F.array(*map(F.lit, [*names, *(f for t in identity for f in features_of(t))])))
    data = made.select("label", kept.alias("kept")).collect()  # FIT_ROWS rows of kept features
    return train([r.kept for r in data], [r.label for r in data], names, identity)


def score_toxicity(df: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> DataFrame:
    """id_col and score (0 to 1, higher: label 1 likelier) of every row of df; a null text is an empty one.

    labels and learn as in score_quality. If one class has no rows every score is 0.5.
    """
    small_batches(df.sparkSession)
    source = df.select(id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(fit(df, labels, learn, id_col, text_col, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part, texts in slices(batches):
            z = np.array([model.margin(t) for t in texts])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], names=[id_col, "score"])

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, score double")
