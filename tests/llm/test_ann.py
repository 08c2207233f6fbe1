import random

import numpy as np
import pytest

from pagelight.llm import ann


def brute(rows, top=20):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for q, x in ok:
        if q % 20 == 0:
            best = sorted((-float((x * y).sum()), i) for i, y in ok if i != q and len(y) == len(x))[:top]
            if best:  # a query that nothing can be compared with gives no row
                out[q] = [(i, -s) for s, i in best]
    return out


def table(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, 8))
    rows = [(i, (centres[i % 30] * rng.uniform(0.5, 2) + 0.3 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(300)]  # many equal vectors
    rows += [(9000, None), (9020, [0.0] * 8), (9040, [1.0] * 7 + [None]), (9060, [float("nan")] * 8), (9080, [float("inf")] + [1.0] * 7), (9100, [1.0, 2.0]), (None, [1.0] * 8)]
    return rows


@pytest.mark.parametrize("list_rows,chunk", [(64, 100), (512, 20_000)])
def test_recall_and_order(spark, list_rows, chunk):
    rows = table()
    df = spark.createDataFrame([(i, v, 5) for i, v in rows], "vec_id long, embedding array<float>, list int").repartition(5)
    got = {}
    for r in ann.search(df, df.filter("vec_id % 20 = 0"), list_rows=list_rows, chunk=chunk).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows)
    assert got.keys() == want.keys()
    hits = 0
    vec = dict(rows)
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert sorted(((-s, i) for _, i, s in found)) == [(-s, i) for _, i, s in found]
        assert all(abs(s - float((np.array(vec[q], float) * np.array(vec[i], float)).sum())) < 1e-12 for _, i, s in found)
        assert len({i for _, i, _ in found}) == 20 and q not in {i for _, i, _ in found}
        hits += len({i for _, i, _ in found} & {i for i, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, -1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.digest(df).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, -0.5)]
    assert ann.digest(df.filter("vec_id > 99")).collect() == []
    assert ann.digest(df.filter("vec_id = 0")).collect() == []


def test_other_lengths_are_compared_with_their_own(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(1000 + i, rng.normal(size=2 + i % 2).tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, df.filter("vec_id % 20 = 0"), list_rows=100, chunk=30).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows)
    assert got.keys() == want.keys()
    for q in (1000, 1020, 1040, 1060, 1080):
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_small_lists_still_give_all_that_is_asked(spark):
    rng = np.random.default_rng(5)
    centres = 10 * rng.normal(size=(60, 8))
    rows = [(i, (centres[i % 60] + 0.01 * rng.normal(size=8)).tolist()) for i in range(600)] + [(620, (-100 * np.ones(8)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    n = ann.search(df, df.filter("vec_id % 20 = 0"), list_rows=8, target=0.5).groupBy("query_id").count().collect()
    assert len(n) == 31 and {r["count"] for r in n} == {20}


@pytest.mark.parametrize("kind", ["tight", "noisy", "random"])
def test_recall_and_lists_read(kind):
    rng = np.random.default_rng(6)
    spread = {"tight": 0.02, "noisy": 0.5, "random": 0.0}[kind]
    x = rng.normal(size=(40, 16))[rng.integers(40, size=6000)] + spread * rng.normal(size=(6000, 16)) if spread else rng.normal(size=(6000, 16))
    lists = ann.Lists(x, 30, float(np.sqrt((x * x).sum(axis=1).max())) * (1 + 1e-9), 20, ann.TARGET)
    homes = lists.homes(lists.lifted(x))
    held = np.bincount([h[0] for h in homes], minlength=30)
    q = x[5000:5200]
    probed = lists.probes(q, held, 21)
    hits = 0
    for i, p in enumerate(probed):
        score = x @ q[i]
        score[5000 + i] = -np.inf
        best = np.argsort(-score)[:20]
        hits += sum(bool(np.isin(homes[j], p).any()) for j in best)
    assert hits / (20 * len(q)) >= 0.95
    if kind == "tight":
        assert np.mean([len(p) for p in probed]) < 6
    print(kind, "recall", hits / (20 * len(q)), "lists read", np.mean([len(p) for p in probed]), "of 30")


def test_a_region_gives_the_best_of_the_lists_that_a_query_wants():
    rng = np.random.default_rng(6)
    x, home = rng.normal(size=(400, 6)), rng.integers(0, 40, 400)
    ids = rng.permutation(400)
    ids, x, home = np.r_[ids, ids[:50]], np.r_[x, x[:50]], np.r_[home, (home[:50] + 1) % 40]  # replicas
    q = rng.normal(size=(30, 6))
    wants = [np.sort(rng.choice(40, k, replace=False)) for k in [1, 2, 9, 40] * 7 + [3, 5]]
    for i, (got, scores) in enumerate(ann.best_of_region(ids[:30], q, wants, ids, x, home, 5)):
        all_ = sorted({(-float((a * q[i]).sum()), int(j)) for j, a, h in zip(ids, x, home, strict=True) if j != ids[i] and (4 * len(wants[i]) >= 40 or h in wants[i])})[:5]
        assert got.tolist() == [j for _, j in all_] and np.allclose(scores, [-s for s, _ in all_])


def test_many_queries_are_dealt_over_tasks(spark, monkeypatch):
    """No task takes more than about ``QUERIES`` queries, however many want its lists."""
    monkeypatch.setattr(ann, "QUERIES", 20, raising=False)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    sizes = []
    apply = type(df.groupBy("vec_id").cogroup(df.groupBy("vec_id"))).applyInArrow

    def counted(groups, func, schema):
        left = groups._gd1
        sizes.extend(r["count"] for r in left.count().collect())
        return apply(groups, func, schema)

    monkeypatch.setattr(type(df.groupBy("vec_id").cogroup(df.groupBy("vec_id"))), "applyInArrow", counted)
    got = {}
    for r in ann.search(df, df.filter("vec_id % 5 = 0"), list_rows=50).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x = np.array([v for _, v in rows])
    want = {q: set(np.argsort(-np.where(np.arange(2000) == q, -np.inf, x @ x[q]), kind="stable")[:20].tolist()) for q in range(0, 2000, 5)}
    assert got.keys() == want.keys() and sum(len(got[q] & want[q]) for q in want) >= 0.9 * 20 * len(want)
    assert max(sizes) <= 50
