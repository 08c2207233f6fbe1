import hashlib
import random

import pytest

import corpus_pipeline
from pagelight.llm import bpe, copies, quality

SYL = ["ta", "ro", "mi", "len", "sto", "ver", "kan", "du", "pel", "or"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices(SYL, k=rng.randrange(1, 4)))
    items = [" ".join(word() for _ in range(14)) for _ in range(5)]
    docs, labels = [], []
    for i in range(500):
        ws = [word() for _ in range(rng.randrange(30, 90))]
        text, good = " ".join(ws).capitalize() + ".", 1
        kind = i % 10
        if kind == 1 and i > 20:
            text = docs[i - 15][1]
        if kind == 2 and docs:
            text = docs[i - 2][1].replace(" ", "\n", 1)
        if kind == 3:
            text += " " + rng.choice(items) + "."
        if kind == 4:
            text += " Write to a.b@c.de or 10.0.0.7 now."
        if kind in (5, 6):
            text, good = " ".join(w.upper() + "!!" for w in ws), 0
        docs.append((i, text, "en", "src", len(text)))
        labels.append((i, good, 0))
    docs += [(None, docs[0][1], None, None, None), (600, None, "en", None, None), (601, "", "en", None, 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, items


def redacted(text):
    """The fixture holds two kinds of spans, which never overlap."""
    return text.replace("a.b@c.de", "<EMAIL>").replace("10.0.0.7", "<IP>")


def words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def test_stages_against_plain_versions(spark, folder):
    path, docs, items = folder
    df = spark.read.parquet(f"{path}/documents.parquet")
    model = quality.train(df, quality.training_labels(spark.read.parquet(f"{path}/labels.parquet")))
    rows = [d for d in docs if model.score(d[1]) >= quality.THRESHOLD]
    groups = []
    for d in sorted((d for d in rows if d[0] is not None), key=lambda d: d[0]):
        near = [g for g in groups if any(copies.similar((d[1] or "").encode(), (x[1] or "").encode(), 5, 0.8) for x in g)]
        merged = [d] + [x for g in near for x in g]
        groups = [g for g in groups if g not in near] + [merged]
    keep = {min(x[0] for x in g) for g in groups}
    rows = [d for d in rows if d[0] is None or d[0] in keep]
    bad = {tuple(words(t)[i : i + 10]) for t in items for i in range(len(words(t)) - 9)}
    rows = [d for d in rows if not any(tuple(words(d[1])[i : i + 10]) in bad for i in range(len(words(d[1]))))]
    tree = bpe.loaded(bpe.default_path())
    want = []
    for d in rows:
        text = redacted(d[1] or "")
        (ids, decoded), = tree.encode([text])
        want.append((d[0], len(ids) // 4, hashlib.sha256(ids).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert 150 < len(got) < 400


def test_columns_and_order(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).dtypes == docs.dtypes
