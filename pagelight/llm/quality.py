"""Quality by positive-unlabelled learning: a linear model that minimises the non-negative unbiased risk.

Trusted positives are training documents labelled good; the unlabelled set is a sample of all other
documents, whose labels are not looked at. With class prior p and logistic loss l the risk is
``p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)])``; where the second part would turn negative, its
gradient is climbed back instead.

The class prior p is estimated from positives and unlabelled rows alone, as their smallest density ratio:
a logistic model tells a half of the positives from a half of the unlabelled rows, and over the other
halves the share of unlabelled rows above a score, divided by that of positives, is least where hardly any
negative scores (the bound of Garg et al. 2021 picks the score; it holds the noise of small shares off).

Features describe a text's form: frequencies of pairs of character classes, how often words and lines
repeat, word lengths, and shares of capitals, digits and symbols. The fit takes at most ``n_positive``
and ``n_unlabelled`` documents, chosen by a hash of their ids; their features are computed where the texts are, so the driver gets
rows of numbers, as many as these bounds allow. Every text is scored whole.

Defined results: a null or empty text scores as the model sees a text without characters; repeated rows
each give a row, and one text speaks for a doc_id in the fit; without positives every score is 0.5; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.llm import training

N_POSITIVE = 5000
N_UNLABELLED = 10_000
THRESHOLD = 0.5
STEP = 1 << 20


def _classes() -> np.ndarray:
    out = np.full(256, 9, np.uint8)  # other bytes of ASCII
    out[97:123] = 0
    out[65:91] = 1
    out[48:58] = 2
    out[[9, 11, 12, 13, 32]] = 3
    out[10] = 4
    out[[44, 46, 59, 58]] = 5
    out[[33, 63]] = 6
    out[[124, 60, 62, 123, 125, 91, 93, 92, 95, 61]] = 7
    out[[35, 36, 37, 38, 42, 43, 64, 94, 126]] = 8
    out[128:] = 10
    return out


CLASSES, N_CLASSES = _classes(), 11
N_FEATURES = N_CLASSES * N_CLASSES + N_CLASSES + 9


def features(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    pairs = np.zeros(N_CLASSES * N_CLASSES)
    for at in range(0, len(raw), STEP):
        c = CLASSES[np.frombuffer(raw[at : at + STEP + 1], np.uint8)]
        pairs += np.bincount(c[:-1] * np.uint8(N_CLASSES) + c[1:], minlength=N_CLASSES * N_CLASSES)
    single = pairs.reshape(N_CLASSES, N_CLASSES).sum(axis=1)
    total = max(1.0, single.sum())
    words = raw.split()
    n = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x]
    m = max(1, len(lines))
    same = sum(map(bytes.__eq__, words, words[1:]))
    pair_kinds = len(set(zip(words, words[1:], strict=False)))
    more = [
        len(set(words)) / n,
        same / n,
        pair_kinds / n,
        len(set(lines)) / m,
        min(1.0, sum(map(len, words)) / n / 20),
        math.log1p(len(words)) / 12,
        math.log1p(len(raw)) / 16,
        min(1.0, len(lines) / n * 5),
        float(len(words) == 0),
    ]
    return np.concatenate([np.sqrt(pairs / total), single / total, more])


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, intercept: float):
        self.weights = weights / scale
        self.intercept = intercept - float((mean / scale * weights).sum())

    def score(self, text: str | None) -> float:
        z = self.intercept + float(features(text) @ self.weights)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def constant(p: float) -> Model:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), math.log(p / (1 - p)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def shares_above(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
    return 1 - np.searchsorted(np.sort(scores), at, side="left") / len(scores)


def class_prior(p: np.ndarray, u: np.ndarray, rounds: int = 300, l2: float = 1e-3) -> float:
    """Share of positives among the rows of ``u``, by the smallest density ratio over the scores of a model of p against u."""
    if min(len(p), len(u)) < 4:
        return 0.5
    rng = np.random.default_rng(5)
    p, u = p[rng.permutation(len(p))], u[rng.permutation(len(u))]
    mean, scale = u.mean(axis=0), u.std(axis=0) + 0.02
    (p_fit, p_held), (u_fit, u_held) = (np.array_split((x - mean) / scale, 2) for x in (p, u))
    x = np.r_[p_fit, u_fit]
    y = np.r_[np.ones(len(p_fit)), np.zeros(len(u_fit))]
    share = np.where(y == 1, 0.5 / len(p_fit), 0.5 / len(u_fit))
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, rounds + 1):
        err = share * (sigmoid(x @ w + b) - y)
        g = np.append(x.T @ err + l2 * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    p_score, u_score = p_held @ w + b, u_held @ w + b
    at = np.unique(p_score)
    q_p, q_u = shares_above(p_score, at), shares_above(u_score, at)
    noise = math.sqrt(math.log(40) / 2 / len(u_held)) + math.sqrt(math.log(40) / 2 / len(p_held))
    best = np.argmin((q_u + noise) / q_p)
    return float(min(0.999, max(0.001, q_u[best] / q_p[best])))


def risk(p_scores: np.ndarray, u_scores: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the unbiased risk under logistic loss: that of positives, and that of negatives, which the method keeps from sinking below zero."""
    loss = lambda z: np.mean(np.logaddexp(0, -z))
    return float(prior * loss(p_scores)), float(loss(-u_scores) - prior * loss(-p_scores))


def gradient(xp: np.ndarray, xu: np.ndarray, w: np.ndarray, b: float, prior: float) -> np.ndarray:
    """Of the risk by the weights and the intercept; where the negatives' part is below zero, uphill on that part alone."""
    zp, zu = xp @ w + b, xu @ w + b
    part = lambda x, e: np.append(x.T @ e, e.sum()) / len(x)
    down = part(xu, sigmoid(zu)) - prior * part(xp, sigmoid(zp))
    return prior * part(xp, sigmoid(zp) - 1) + down if risk(zp, zu, prior)[1] >= 0 else -down


def fit(p: np.ndarray, u: np.ndarray, prior: float, epochs: int = 120, batch: int = 500, l2: float = 1e-4) -> Model:
    """Non-negative PU learning by Adam over mini-batches. p, u: rows of features."""
    if not len(p) or not len(u) or not 0 < prior < 1:
        return constant(0.5)
    mean, scale = u.mean(axis=0), u.std(axis=0) + 0.02
    p, u = (p - mean) / scale, (u - mean) / scale
    rng = np.random.default_rng(7)
    w, b = np.zeros(N_FEATURES), 0.0
    m, v, t = np.zeros(N_FEATURES + 1), np.zeros(N_FEATURES + 1), 0
    average, averaged = np.zeros(N_FEATURES + 1), 0
    for epoch in range(epochs):
        order = rng.permutation(len(u))
        for at in range(0, len(u), batch):
            xu = u[order[at : at + batch]]
            xp = p[rng.integers(0, len(p), batch)]
            grad = gradient(xp, xu, w, b, prior)
            grad[:-1] += l2 * w
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            step = 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
            w, b = w - step[:-1], b - step[-1]
        if epoch >= epochs // 2:
            average += np.append(w, b)
            averaged += 1
    average /= averaged
    return Model(mean, scale, average[:-1], float(average[-1]))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", n_positive: int = N_POSITIVE, n_unlabelled: int = N_UNLABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """``labels`` must hold training rows only, of which the positives are used. Unlabelled documents are drawn from all of ``docs`` without their labels."""
    own = training.labelled(labels, label_col, id_col)
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    chosen = training.by_hash(own.filter("label = 1"), n_positive, "doc_id").unionByName(training.by_hash(ids, n_unlabelled, "doc_id").withColumn("label", F.lit(0)))
    rows = training.numbers_of(docs, chosen, lambda text: features(text).astype(np.float32).tobytes(), id_col, text_col)
    part = lambda which: np.array([np.frombuffer(x, np.float32) for _, x, label in rows if label == which], float).reshape(-1, N_FEATURES)
    p, u = part(1), part(0)
    return fit(p, u, class_prior(p, u))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([model.score(x.as_py()) for x in batch.column("text")], pa.float64())], schema=schema)

    return rows.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(x.as_py()) >= threshold for x in batch.column(text_col)], pa.bool_()))

    return docs.mapInArrow(run, schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """All but the rows whose fold is 1 of 3, which are held out."""
    return labels.filter(training.fold(F.col("doc_id"), 3) != 1)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.coalesce(training.fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = train(docs, training_labels(labels))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
