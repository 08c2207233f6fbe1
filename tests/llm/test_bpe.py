import random

import numpy as np
import pytest
from pyspark.sql import Row

from pagelight.llm import bpe


@pytest.fixture(scope="module")
def tree():
    return bpe.loaded(bpe.default_path())


def expected(tree, text):
    ids = tree.library.encode(text, add_special_tokens=False).ids
    return ids, tree.library.decode(ids, skip_special_tokens=False)


def texts(seed=5):
    rng = random.Random(seed)
    out = ["", " ", "Hello  World's DON'T 12,3!!", "<|endoftext|>x<|startoftext|> y", "ΑΣ Σ É é́ 日本語 😀 \x1c \x85 \xa0½"]
    for _ in range(60):
        out.append("".join(rng.choice("abcdeth 'srvml.,!12ÉéßÄ\n\t") for _ in range(rng.randrange(1, 400))))
        out.append("".join(rng.choice("aeiouhtn") for _ in range(rng.randrange(1, 900))))
        out.append("".join(rng.choice("ab's ΣЖ日́<|>") for _ in range(rng.randrange(1, 200))))
    return out


def test_whole_texts(tree):
    for text, (ids, decoded) in zip(texts(), tree.encode(texts()), strict=True):
        want = expected(tree, text)
        assert (np.frombuffer(ids, "<u4").tolist(), decoded) == want, repr(text)


def test_tree_of_halves(tree):
    rng = random.Random(2)
    for _ in range(150):
        word = "".join(rng.choice(rng.choice(["ab", "aeth", "abcdefghijklmnopqrstuvwxyzé"])) for _ in range(rng.randrange(60, 700)))
        assert tree.pretoken(word) == expected(tree, word)[0]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_pieces(spark, tree, size):
    rows = [Row(doc_id=i, text=t, pos=3) for i, t in enumerate(texts(size)[: 120 if size > 2 else 40])] + [Row(doc_id=None, text=None, pos=1), Row(doc_id=0, text="twice over", pos=1), Row(doc_id=0, text="twice over", pos=1)]
    got = bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, pos int"), piece_chars=size).collect()
    want = sorted(str((r.doc_id, *expected(tree, r.text or ""))) for r in rows)
    assert sorted(str((r.id, np.frombuffer(bytes(r.ids), "<u4").tolist(), r.decoded)) for r in got) == want


def test_empty_table_and_decode(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digest(empty).collect() == []
    made = bpe.encode_decode(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"))
    assert [r.decoded for r in bpe.decode_ids(made).collect()] == [r.decoded for r in made.collect()]
