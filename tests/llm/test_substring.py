import hashlib
import random
import re

import numpy as np
import pytest

from pagelight.llm import substring


def brute(rows, k=13):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    big = float("inf")
    first = {}
    for d, ws in words:
        for i in range(len(ws) - k + 1):
            key = tuple(ws[i : i + k])
            first[key] = min(first.get(key, big), big if d is None else d)
    out = []
    for d, ws in words:
        gone = set()
        for i in range(len(ws) - k + 1):
            if first[tuple(ws[i : i + k])] < (big if d is None else d):
                gone.update(range(i, i + k))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def sample(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["É", "a\x1cb", "x y"]
    passage = [rng.choice(vocab) for _ in range(30)]
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "one two")]
    for d in range(10, 90):
        ws = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            a = rng.randrange(18)
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = passage[a : a + rng.randrange(10, 30)]
        rows.append((d, rng.choice([" ", "\n", "  \t"]).join(ws)))
    rows += [(90, rows[20][1]), (20, rows[40][1]), (20, rows[40][1]), (None, rows[30][1]), (3, " ".join(["same"] * 40)), (91, " ".join(["same"] * 50))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = sample(seed)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, key int, kind string").repartition(3)
    got = sorted((tuple(r) for r in substring.digest(df).collect()), key=str)
    assert got == brute(rows)


def plain_hashes(monkeypatch, bits):
    """Leave only ``bits`` bits of a window's polynomial."""
    full = substring.window_hashes
    monkeypatch.setattr(substring, "window_hashes", lambda words, window: (full(words, window) >> np.uint64(64 - bits)) << np.uint64(64 - bits))


@pytest.mark.parametrize("n_groups", [1, 3, 16])
@pytest.mark.parametrize("hash_bits", [64, 8, 1])
def test_steps_against_brute_force(monkeypatch, n_groups, hash_bits):
    """The five steps without Spark; also where most windows collide in their polynomial."""
    if hash_bits < 64:
        plain_hashes(monkeypatch, hash_bits)
    rows, bits = sample(9), 4
    groups = {g: substring.Group([d for d, _ in rows[g::n_groups]], [None if t is None else t.encode() for _, t in rows[g::n_groups]], bits, 13) for g in range(n_groups)}

    def deal(made):
        out = {}
        for key, source, payload in made:
            out.setdefault(key, []).append((source, payload))
        return out

    sent = deal((key, g, p) for g, own in groups.items() for key, p in substring.send_hashes(own))
    told = deal((g, key, p) for key, got in sent.items() for g, p in substring.count_hashes(key, [s for s, _ in got], [p for _, p in got]))
    sent = deal((key, g, p) for g, got in told.items() for key, p in substring.send_keys(groups[g], [p for _, p in got]))
    told = deal((g, key, p) for key, got in sent.items() for g, p in substring.count_keys([s for s, _ in got], [p for _, p in got]))
    found = []
    for g, own in groups.items():
        for (d, _), words, starts in zip(rows[g::n_groups], own.words, substring.marked(own, [p for _, p in told.get(g, [])]), strict=True):
            gone = np.zeros(len(words), bool) if starts is None else substring.removal(starts, len(words), 13)
            kept = b" ".join(w for w, c in zip(words, gone.tolist(), strict=True) if not c)
            found.append((d, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    assert sorted(found, key=str) == brute(rows)


def test_member_and_packing():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5000, 3000).astype(np.uint64)
    among = np.unique(rng.integers(0, 5000, 700)).astype(np.uint64)
    assert (substring.member(x, among) == np.isin(x, among)).all()
    assert not substring.member(x, among[:0]).any() and not len(substring.member(x[:0], among))
    wide = np.sort(rng.integers(0, 2**63, 50)).astype(np.uint64)
    assert (substring.unpack(substring.pack(wide)) == wide).all()
    ids = np.array([5, -(2**63), 2**63 - 1, 0], np.int64)
    assert (substring.unpack_ids(substring.pack_ids(ids)) == ids).all()


def test_many_rows_without_id(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(None, f"own{i} " + text) for i in range(60)] + [(None, text)] * 30 + [(4, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in substring.digest(df).collect()), key=str) == brute(rows)


def test_one_very_long_text(spark):
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(300_000))
    part = " ".join(long.split()[1000:1100])
    got = {r.doc_id: r for r in substring.remove_repeats(spark.createDataFrame([(2, long), (1, "x " + part + " y")], "doc_id long, text string")).collect()}
    assert got[2].n_words == 300_000 and [tuple(x) for x in got[2].removed] == [(1000, 1100)] and got[1].n_removed == 0


def test_intervals_and_empty(spark):
    text = " ".join(f"t{i}" for i in range(20))
    df = spark.createDataFrame([(1, text), (2, "a b " + text + " c")], "doc_id long, text string")
    got = {r.doc_id: r for r in substring.remove_repeats(df).collect()}
    assert [tuple(x) for x in got[2].removed] == [(2, 22)] and got[2].kept == "a b c" and got[1].removed == []
    assert substring.digest(df.filter("doc_id > 9")).collect() == []
