import random

import numpy as np
import pytest
import xxhash

from pagelight.llm import simhash


def brute_fp(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps, most=3):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and (fps[x] ^ fps[y]).bit_count() <= most:
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def clusters(seed, n):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        c = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 3, 30])):
            out.append(c)
            for _ in range(rng.randrange(6)):
                c ^= 1 << rng.randrange(64)
    return out[:n]


@pytest.mark.parametrize("bucket", [4096, 40, 5])
def test_links(spark, bucket):
    codes = sorted(set(clusters(bucket, 700)))
    nodes = spark.createDataFrame([(i * 3, simhash.signed(c)) for i, c in enumerate(codes)], "node long, fp long")
    want = brute_components({i * 3: c for i, c in enumerate(codes)})
    found = simhash.links(nodes, 3, bucket)
    for one_task in (0, 10**6):
        got = {r.node: r.component for r in simhash.components(found, one_task).collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_gray_rank():
    n = np.arange(1 << 10, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_digest(spark):
    rng = random.Random(4)
    vocab = ["The", "of", "été", "x\x0by", "to\tgo", "AND", "Éa", "longer\nwords"]
    texts = [None, "", " \n", "one", "One two", "ONE TWO three", "one two three four"]
    texts += [" ".join(rng.choices(vocab, k=rng.randrange(1, 60))) for _ in range(80)]
    texts += [texts[20] + " tail", texts[20], texts[20]]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, fp string, node int")
    fps = {i: brute_fp(t) for i, t in enumerate(texts)}
    comp = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.digest(df).collect()}
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


def test_nulls_and_empty(spark):
    assert simhash.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(None, "a b c"), (None, "only here"), (4, "a b c"), (4, "a b c")], "doc_id long, text string")
    got = sorted(str((r.doc_id, r.component_id)) for r in simhash.digest(df).collect())
    assert got == sorted(map(str, [(None, 4), (None, None), (4, 4), (4, 4)]))
