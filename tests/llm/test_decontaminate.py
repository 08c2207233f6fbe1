import hashlib
import random
import re

import pytest

from pagelight.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    wins = {}
    for item, text in items:
        ws = words(text)
        for i in range(max(1, len(ws) - 9)):
            if ws:
                wins.setdefault(tuple(ws[i : i + 10]), set()).add(item if item is None else str(item))
    out = []
    for d, text in docs:
        ws = words(text)
        hit, found = set(), set()
        for win, own in wins.items():
            for i in range(len(ws) - len(win) + 1):
                if tuple(ws[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found |= own
        out.append((d, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(x for x in found if x is not None)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables(seed):
    rng = random.Random(seed)
    vocab = ["the", "of", "Été", "x", "été", "Über", "a1", "go"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 1, 2, 4, 5, 6, 9, 10, 11, 25]))) for i in range(30)] + [(99, None), (3, text(12)), (100, "the of " * 8)]
    items += [(None, text(11)), (None, text(12))]
    docs = [(i, text(rng.randrange(60))) for i in range(60)]
    for i in range(60, 120):
        ws = text(rng.randrange(5, 40)).split(" ")
        at = rng.randrange(len(ws))
        copied = (rng.choice(items)[1] or "").upper().split(" ")
        a = rng.randrange(len(copied))
        ws[at:at] = copied[a : a + rng.randrange(3, 30)]
        docs.append((i, " ".join(ws)))
    docs += [(200, None), (201, ""), (5, docs[80][1]), (6, docs[81][1]), (6, docs[81][1]), (202, "the of " * 60)]
    return docs, items


@pytest.mark.parametrize("seed,rows", [(1, 10_000), (2, 10_000), (3, 0)])
def test_against_brute_force(spark, seed, rows):
    docs, items = tables(seed)
    d = spark.createDataFrame([(i, t, 1, "g") for i, t in docs], "doc_id long, text string, n int, gram string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    done = decontaminate.contamination(d, b, inline_words=rows)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in done.collect()), key=str) == [x[:4] for x in brute(docs, items)]
    if seed == 1:
        assert sorted((tuple(r) for r in decontaminate.digest(d, b).collect()), key=str) == brute(docs, items)
        dirty = {x[0] for x in brute(docs, items) if x[5]}
        kept = decontaminate.clean(d, b)
        assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} >= {i for i, _ in docs} - dirty


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert decontaminate.digest(none, items).collect() == []
    assert [r.contaminated for r in decontaminate.digest(none.union(spark.createDataFrame([(1, "one two three")], none.schema)), items.limit(0)).collect()] == [False]


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "one two three", 5, 6, 7), (2, "other words", 5, 6, 7)], "doc_id long, text string, doc_ int, mark_ int, mark int")
    items = spark.createDataFrame([(1, "two three", 9)], "item_id long, text string, win int")
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "other words", 5, 6, 7)]


def test_items_without_id_count(spark):
    docs = spark.createDataFrame([(1, "a b c one two three four d")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two three"), (None, "two three four"), (7, "three four")], "item_id long, text string")
    r = decontaminate.digest(docs, items).collect()[0]
    assert (r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (4, 2, hashlib.sha256(b"7").hexdigest(), True)


def test_long_text_in_linear_time(spark):
    import time

    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocab, k=20))) for i in range(50)]
    ws = rng.choices(vocab, k=1_000_000)
    for i in range(50):
        ws[i * 15_000 : i * 15_000 + 12] = items[i][1].split()[3:15]
    docs = spark.createDataFrame([(1, " ".join(ws))], "doc_id long, text string")
    began = time.time()
    r = decontaminate.digest(docs, spark.createDataFrame(items, "item_id long, text string")).collect()[0]
    assert (r.n_words, r.n_hit, r.n_items) == (1_000_000, 600, 50) and time.time() - began < 90
