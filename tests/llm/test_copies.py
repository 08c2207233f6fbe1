import random

import numpy as np

from pagelight.llm import copies


def brute_near(rows, least=0.8):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, copies.shingle_set((t or "").encode(), 5))
    parent = {d: d for d in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in sets:
        for y in sets:
            if x < y and len(sets[x] & sets[y]) >= least * len(sets[x] | sets[y]):
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    return {d: root(d) for d in sets}


def test_near_copies(spark):
    rng = random.Random(6)
    vocab = [f"{a}{b}{c}" for a in ("ta", "ro", "mi") for b in ("len", "sto", "ver", "kan") for c in ("", "du", "pel", "or", "as")] + ["the", "of", "and"] * 12
    rows = []
    for i in range(60):
        ws = rng.choices(vocab, k=rng.randrange(60, 300))
        rows.append((len(rows), " ".join(ws)))
        for _ in range(rng.choice([0, 0, 1, 2, 8])):
            copy = list(ws)
            for _ in range(int(len(ws) * rng.choice([0, 0.005, 0.01]))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((len(rows), rng.choice([" ", "\n"]).join(copy).capitalize()))
    rows += [(900, None), (901, ""), (902, " "), (903, rows[5][1])]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, node int, table int").repartition(4)
    want = brute_near(rows)
    got = {r.doc_id: r.component_id for r in copies.near_copies(df).collect()}
    assert got == want
    kept = copies.drop_copies(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(want.values())


def test_near_copies_of_odd_rows(spark):
    assert copies.drop_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(None, "a b", 1), (3, "a b", 1), (3, "a b", 1), (5, "a b", 1)], "doc_id long, text string, gone int")
    assert sorted(str(r.doc_id) for r in copies.drop_copies(df).collect()) == ["3", "3", "None"]


def groups_of(spark, rows, parts=4):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return {r.doc_id: r.component_id for r in copies.near_copies(df).collect()}


def test_near_copies_behind_a_reordered_head(spark):
    """The smallest id holds the words of its neighbours in another order: same bag of words, no common shingle."""
    words = [f"w{i}" for i in range(300)]
    mixed = random.Random(1).sample(words, 300)
    rows = [(0, " ".join(mixed)), (1, " ".join(words)), (2, " ".join(words[:150] + ["new"] + words[151:]))]
    assert groups_of(spark, rows) == brute_near(rows) == {0: 0, 1: 1, 2: 1}


def test_large_groups_by_heads(spark, monkeypatch):
    """With no pairs allowed at once, all keys go through rounds of heads; a passage that many texts share joins none of them."""
    monkeypatch.setattr(copies, "FEW", 0)
    monkeypatch.setattr(copies, "HOT", 4)
    rng = random.Random(9)
    base, passage = [f"b{i}" for i in range(200)], [f"p{i}" for i in range(60)]
    rows = []
    for i in range(60):
        ws = list(base)
        for _ in range(rng.randrange(8)):
            ws[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    rows += [(100 + i, " ".join(passage + [f"o{i}x{j}" for j in range(rng.choice([10, 40]))])) for i in range(40)]
    assert groups_of(spark, rows) == brute_near(rows)


def test_near_copies_between_false_candidates(spark):
    """Reordered texts lie between two near copies by their words: candidates that fail must not stand in for the pair."""
    rng = random.Random(2)
    rows = []
    for k in range(8):
        words = [f"w{k}x{i}" for i in range(300)]
        copy = [f"n{k}x{i}" if i % 60 == 30 else w for i, w in enumerate(words)]
        rows += [(10_000 + k, " ".join(words)), (20_000 + k, " ".join(copy))]
        for i in range(40):
            mixed = [rng.choice(x) for x in zip(words, copy, strict=True)]
            rows.append((100 * k + i, " ".join(rng.sample(mixed, 300))))
    assert groups_of(spark, rows) == brute_near(rows)


def test_near_copies_with_blocks(spark):
    """Headers added and tails cut, at similarities about the limit."""
    rng = random.Random(3)
    rows = []
    for i in range(40):
        words = [f"v{rng.randrange(10**6)}" for _ in range(200)]
        block = [f"v{rng.randrange(10**6)}" for _ in range(rng.choice([20, 30, 40, 45, 49, 55]))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(block + words if i % 2 else words[: 200 - len(block) * 4 // 5]))]
    want = brute_near(rows)
    assert groups_of(spark, rows) == want and 40 < len(set(want.values())) < 80


def test_parities_never_differ_more_than_the_sets():
    rng = np.random.default_rng(5)
    for n, changed in [(1, 0), (5, 3), (200, 20), (200, 200), (3000, 40)]:
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.r_[a[changed:], rng.integers(0, 1 << 63, changed // 2, dtype=np.uint64)]
        bits = sum(int(x).bit_count() for x in (copies.parities(a) ^ copies.parities(b)).view(np.uint64))
        assert bits <= len(set(a.tolist()) ^ set(b.tolist())) and (changed or not bits)


def test_few_candidates_in_a_group_of_cousins(spark, monkeypatch):
    """Texts that share much, but not enough, share keys; they must not all be tried on their texts."""
    rng = random.Random(8)
    base, rows = [f"b{i}" for i in range(300)], []
    for i in range(60):
        ws = list(base)
        for at in range(0, 300, 30):
            if rng.random() < 0.6:
                ws[at + rng.randrange(25)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    tried, written = [], copies.written

    def counted(df, label):
        out = written(df, label)
        if label == "candidate-pairs":
            tried.append(out.count())
        return out

    monkeypatch.setattr(copies, "written", counted)
    assert groups_of(spark, rows) == brute_near(rows)
    assert sum(tried) < 400
