import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelight.llm import quality, toxicity, training

SYL = ["ta", "ro", "mi", "len", "sto", "ver", "kan", "du", "pel", "or"]


def prose(rng, n):
    return " ".join("".join(rng.choices(SYL, k=rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text, good, toxic = prose(rng, rng.randrange(15, 80)), 1, 0
        if rng.random() < 0.3:
            toxic = 1
            words = text.split()
            for w in rng.choices(["gruxnak", "zibbly", "fworp"], k=2):
                words.insert(rng.randrange(len(words)), w + rng.choice(["", "s", "ed"]))
            text = " ".join(words)
        if rng.random() < 0.25:
            good, text = 0, " ".join(w.upper() + "!!" for w in text.split())
        docs.append((i, text, 7))
        labels.append((i, good, toxic))
    return docs, labels


def remainder(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def test_fold(spark):
    got = spark.range(500).select("id", training.fold(F.col("id"), 3).alias("f")).collect()
    assert all(r.f == remainder(r.id, 3) for r in got)


def test_bins_are_those_of_every_ngram(monkeypatch):
    def brute(text):
        raw = []
        for b in f" {text} ".encode():
            c = b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
            if c != 32 or not raw or raw[-1] != 32:
                raw.append(c)
        out = set()
        for n in toxicity.SIZES:
            for i in range(len(raw) - n + 1):
                h = 0x811C9DC5
                for c in raw[i : i + n]:
                    h = ((h ^ c) * 0x01000193) & 0xFFFFFFFF
                out.add((((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF) >> 12)
        return out

    rng = random.Random(1)
    for step in (1 << 20, 17):
        monkeypatch.setattr(toxicity, "STEP", step)
        for text in ["", "a", "Été 99!", *(prose(rng, 30) for _ in range(5))]:
            assert set(toxicity.bins_of(text).tolist()) == brute(text)


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([*docs, (5000, None, 1), (None, "some text", 1)], "doc_id long, text string, label int")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for module, parts, held, column in ((toxicity, 4, 2, 2), (quality, 3, 1, 1)):
        rows = module.digest(d, lab).collect()
        assert len(rows) == len(docs) + 2 and all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out == (remainder(r.doc_id, parts) == held) for r in rows if r.doc_id is not None)
        test = [(r.predicted, labels[r.doc_id][column]) for r in rows if r.doc_id is not None and r.doc_id < 900 and r.held_out]
        assert len(test) > 150 and np.mean([a == b for a, b in test]) > 0.95


def test_held_out_labels_are_not_read(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs, "doc_id long, text string, n int")
    for module, parts, held in ((toxicity, 4, 2), (quality, 3, 1)):
        flipped = [(i, 1 - q, 1 - t) if remainder(i, parts) == held else (i, q, t) for i, q, t in labels]
        a, b = (sorted((r.doc_id, r.score) for r in module.digest(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, flipped))
        assert a == b


@pytest.mark.parametrize("module", [toxicity, quality])
def test_empty_tables(spark, module):
    none = spark.createDataFrame([], "doc_id long, text string")
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert module.digest(none, no_labels).collect() == []
    assert len(module.digest(spark.createDataFrame([(1, "x"), (1, "x")], "doc_id long, text string"), no_labels).collect()) == 2


@pytest.mark.parametrize("share", [0.1, 0.3, 0.5, 0.7, 0.9])
def test_class_prior_of_planted_shares(share):
    """Rows of the quality features: the estimate sees positives and a mixture, never a negative as such."""
    rng = random.Random(int(share * 100))
    good = lambda: quality.features(prose(rng, rng.randrange(15, 80)))
    bad = lambda: quality.features(" ".join(w.upper() + rng.choice(["!!", "!", "", " 77"]) for w in prose(rng, rng.randrange(15, 80)).split()))
    p = np.stack([good() for _ in range(800)])
    u = np.stack([good() if rng.random() < share else bad() for _ in range(1600)])
    assert abs(quality.class_prior(p, u) - share) < 0.06


def test_risk_and_gradient_against_plain_loops():
    rng = np.random.default_rng(1)
    for prior in (0.2, 0.6, 0.9):
        xp, xu, w, b = rng.normal(size=(40, 5)) + 0.5, rng.normal(size=(60, 5)), rng.normal(size=5), 0.3
        loss = lambda z: np.log1p(np.exp(-z))

        def parts(w, b):
            own = [loss(x @ w + b) for x in xp]
            against = [loss(-(x @ w + b)) for x in xp]
            other = [loss(-(x @ w + b)) for x in xu]
            return prior * sum(own) / 40, sum(other) / 60 - prior * sum(against) / 40

        assert np.allclose(quality.risk(xp @ w + b, xu @ w + b, prior), parts(w, b))
        # non-negative risk: both parts downhill, or uphill on the second where it is below zero
        sign = lambda w, b: sum(parts(w, b)) if parts(w, b)[1] >= 0 else -parts(w, b)[1]
        slope = [(sign(w + 1e-6 * e, b) - sign(w - 1e-6 * e, b)) / 2e-6 for e in np.eye(5)] + [(sign(w, b + 1e-6) - sign(w, b - 1e-6)) / 2e-6]
        assert np.allclose(quality.gradient(xp, xu, w, b, prior), slope, atol=1e-6)


def test_chosen_bins_against_plain_counts(spark, monkeypatch):
    docs, labels = corpus(120)
    d = spark.createDataFrame(docs, "doc_id long, text string, label int")
    ids = spark.createDataFrame([(i, t) for i, _, t in labels], "doc_id long, label int")
    bins, c1, c0 = toxicity.bin_counts(d, ids, "doc_id", "text")
    want = {}
    for (_, text, _), (_, _, t) in zip(docs, labels, strict=True):
        for b in toxicity.bins_of(text).tolist():
            want.setdefault(b, [0, 0])[t] += 1
    assert {b: [x, y] for b, x, y in zip(bins.tolist(), c0.tolist(), c1.tolist(), strict=True)} == {b: c for b, c in want.items() if sum(c) >= toxicity.LEAST}
    n1 = sum(t for _, _, t in labels)
    chosen, ratio = toxicity.chosen_bins(bins, c1, c0, n1, len(labels) - n1)
    for b, r in list(zip(chosen.tolist(), ratio.tolist(), strict=True))[:50]:
        assert abs(r - np.log((want[b][1] + 1) / (n1 + 2) / ((want[b][0] + 1) / (len(labels) - n1 + 2)))) < 1e-9
