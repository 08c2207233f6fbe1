"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The n-grams (3 to 6 bytes of the lower-cased text, white space and punctuation as one blank) are hashed
to ``BINS`` bins; a document has a bin or has it not. Each bin's log-count ratio between toxic and other
training documents scales its feature, and a logistic regression over the scaled features gives the
weights. A bin that fewer than ``LEAST`` training documents have, or whose ratio lies within two standard
errors of none, keeps weight zero; of the others the ``keep`` best supported get one. That bounds what the
driver holds, not which texts are read: the model has one weight for each kept bin.

The fit takes at most ``per_class`` labelled documents of each class, chosen by a hash of their ids. Bins are
counted where the texts are; the driver gets the counts of at most ``BINS`` bins, and for each document the
numbers of its kept bins. Every text is scored whole.

Defined results: a null or empty text has no n-grams and gets the score of the intercept; repeated rows
each give a row, and one text speaks for a doc_id in the fit; without training documents of both classes every score is the share of toxic labels
(0 without labels); an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.llm import training
from pagelight.llm.common import forget, written

SIZES = (3, 4, 5, 6)
BINS = 1 << 20
PER_CLASS = 3000
KEEP, LEAST = 6000, 3
THRESHOLD = 0.3
#: Text bytes that are hashed in one step.
STEP = 1 << 20
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
_PRIME = np.uint32(0x01000193)


def bins_of(text: str, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct bins of a text's n-grams; with ``wanted``, a flag for each bin, only those."""
    raw = _FOLD[np.frombuffer(f" {text} ".encode(), np.uint8)]
    if len(raw) > 2:
        raw = raw[np.r_[True, (raw[1:] != 32) | (raw[:-1] != 32)]]
    found = []
    for at in range(0, len(raw), STEP):
        part = raw[at : at + STEP + SIZES[-1] - 1].astype(np.uint32)
        h = np.full(len(part), 0x811C9DC5, np.uint32)
        for n in range(1, SIZES[-1] + 1):
            m = len(part) - n + 1
            if m <= 0:
                break
            h = (h[:m] ^ part[n - 1 :]) * _PRIME
            if n in SIZES:
                b = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(12)
                found.append(b[wanted[b]] if wanted is not None else b)
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)


class Model:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.at = np.flatnonzero(weights)
        self.values = weights[self.at]
        self.intercept = intercept
        self._dense: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self):
        return {**self.__dict__, "_dense": None}

    def score(self, text: str | None) -> float:
        if self._dense is None:
            dense = np.zeros(BINS)
            dense[self.at] = self.values
            self._dense = dense, dense != 0
        dense, flag = self._dense
        z = self.intercept + float(dense[bins_of(text or "", flag)].sum())
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def log_ratios(c1: np.ndarray, c0: np.ndarray, n1: int, n0: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Naive Bayes log-count ratios of bins that c1 and c0 documents of either class have, and how many standard errors they lie from zero."""
    ratio = np.log(((c1 + alpha) / (n1 + 2 * alpha)) / ((c0 + alpha) / (n0 + 2 * alpha)))
    return ratio, np.abs(ratio) / np.sqrt(1 / (c1 + alpha) + 1 / (c0 + alpha))


def chosen_bins(bins: np.ndarray, c1: np.ndarray, c0: np.ndarray, n1: int, n0: int, alpha: float = 1.0, keep: int = KEEP) -> tuple[np.ndarray, np.ndarray]:
    """(bins, ratios): the best supported ones, ascending."""
    ratio, strength = log_ratios(c1, c0, n1, n0, alpha)
    strength = np.where(c1 + c0 < LEAST, 0, strength)
    best = np.lexsort((bins, -strength))[:keep]
    best = best[strength[best] > 2]
    best = best[np.argsort(bins[best])]
    return bins[best], ratio[best]


def fit(rows: list[tuple[np.ndarray, int]], chosen: np.ndarray, ratio: np.ndarray, prior: float, rounds: int = 200, l2: float = 1e-3) -> Model:
    """rows: (numbers of the chosen bins that a document has, label). prior: share of label 1 among all labelled documents, which the sample may not show."""
    y = np.array([label for _, label in rows], float)
    if not len(y) or y.min() == y.max():
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BINS), math.log(p / (1 - p)))
    n1, n0 = y.sum(), (1 - y).sum()
    lengths = np.array([len(c) for c, _ in rows])
    col = np.concatenate([c for c, _ in rows]).astype(np.int32)
    row = np.repeat(np.arange(len(y), dtype=np.int32), lengths)
    value = ratio[col].astype(np.float32)
    # classes weigh as they do among all labelled documents
    share = np.where(y == 1, prior / n1, (1 - prior) / n0)
    w, b = np.zeros(len(chosen)), math.log(prior / (1 - prior)) if 0 < prior < 1 else 0.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, rounds + 1):
        z = np.clip(b + np.bincount(row, value * w[col], len(y)), -30, 30)
        err = share * (1 / (1 + np.exp(-z)) - y)
        g = np.append(np.bincount(col, value * err[row], len(chosen)) + l2 * w / max(1, len(chosen)) ** 0.5, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w, b = w - step[:-1], b - step[-1]
    weights = np.zeros(BINS)
    weights[chosen] = w * ratio
    return Model(weights, float(b))


def bin_counts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins, c1, c0): how many of the chosen documents of either class have a bin, for bins of ``LEAST`` or more."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    schema = pa.schema([("bin", pa.int32()), ("c1", pa.int64()), ("c0", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BINS), np.int64)
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                counts[label, bins_of(text.as_py())] += 1
        found = np.flatnonzero(counts.any(axis=0))
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts[1, found]), pa.array(counts[0, found])], schema=schema)

    some = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("label", "text")
    done = some.mapInArrow(run, "bin int, c1 long, c0 long").groupBy("bin").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0")).filter(F.col("c1") + F.col("c0") >= LEAST).orderBy("bin").toArrow()
    return tuple(done.column(c).to_numpy() for c in ("bin", "c1", "c0"))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled documents; ``labels`` must hold training rows only."""
    own = training.labelled(labels, label_col, id_col)
    shares = own.agg(F.avg("label")).first()[0] or 0.0
    ids = written(training.by_hash(own.filter("label = 1"), per_class, "doc_id").unionByName(training.by_hash(own.filter("label = 0"), per_class, "doc_id")), "training-ids")
    n1 = ids.filter("label = 1").count()
    chosen, ratio = chosen_bins(*bin_counts(docs, ids, id_col, text_col), n1, ids.count() - n1)
    wanted = np.zeros(BINS, bool)
    wanted[chosen] = True
    rows = training.numbers_of(docs, ids, lambda text: np.searchsorted(chosen, bins_of(text, wanted)).astype(np.uint16).tobytes(), id_col, text_col)
    forget(ids)
    return fit([(np.frombuffer(x, np.uint16), label) for _, x, label in rows], chosen, ratio, shares)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([model.score(x.as_py()) for x in batch.column("text")], pa.float64())], schema=schema)

    return rows.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows whose fold is 2 of 4 are held out."""
    held_out = F.coalesce(training.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = train(docs, labels.filter(training.fold(F.col("doc_id"), 4) != 2))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
