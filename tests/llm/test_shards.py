import random
import zlib

import pytest

from pagelight.llm import shards


def check(rows, got, n=16):
    want = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r["size"], r.crc) for r in got), key=str) == want
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    total, largest = sum(w[1] for w in want), max(w[1] for w in want)
    for s in range(n):
        assert abs(sum(r["size"] for r in by.get(s, [])) - total / n) <= largest
    order = sorted(got, key=lambda r: (r.crc, -(1 << 63) if r.doc_id is None else r.doc_id, r["size"]))
    assert [r.shard for r in order] == sorted(r.shard for r in order)


@pytest.mark.parametrize("hot,overfull,samples", [(0, 2.0, 64), (0.4, 2.0, 64), (0.4, 1.05, 2), (1.0, 1.1, 4)])
def test_near_equal_bytes(spark, hot, overfull, samples):
    rng = random.Random(int(hot * 10))
    rows = [(i, "the same text of many" if rng.random() < hot else "é" * rng.randrange(200)) for i in range(3000)]
    rows += [(None, None), (None, "x"), (5, ""), (7, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, shard int, size int").repartition(6)
    check(rows, shards.assign(df, overfull=overfull, samples=samples).collect())


def test_digest_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(400)], "doc_id long, text string")
    got = shards.digest(df).collect()
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None} and {r.shard for r in got} == set(range(16))
    assert shards.digest(df.filter("doc_id < 0")).collect() == []
    shards.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 400 and back.select("shard").distinct().count() == 4
    own = df.selectExpr("doc_id", "text", "1 AS shard", "2 AS size_", "3 AS id_")
    shards.write_shards(own, str(tmp_path / "clash"), 4)
    back = spark.read.parquet(str(tmp_path / "clash"))
    assert set(back.columns) == {*own.columns, "shard_"} and back.count() == 400


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(i, "w" * i) for i in range(50)], "doc_id long, text string")
    plan = shards.assign(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_mass_of_equal_rows_is_cut(spark):
    rows = [(None, "the same text " * 3)] * 20_000 + [(i, f"own {i}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    keys = shards.written(shards.sized(df), "test-keys")
    whole = keys.selectExpr("count(*) AS n", "sum(size) AS bytes").first()
    sizes = [r.b for r in shards.ranged(keys, shards.split_points(keys, whole.n, whole.bytes)).groupBy("range").agg({"size": "sum"}).toDF("range", "b").collect()]
    assert max(sizes) < 4 * whole.bytes / shards.MIN_RANGES
    got = shards.assign(df).collect()
    assert len(got) == 20_500 and len({(r.shard, r.slot) for r in got}) == 20_500
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r)
    totals = [sum(r.size for r in own) for own in by_shard.values()]
    assert len(totals) == 16 and max(totals) - min(totals) <= 2 * max(r.size for r in got)
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by_shard.values())
