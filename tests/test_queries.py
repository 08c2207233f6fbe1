"""Every query with a SQL twin gives DuckDB's rows on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from pagelight.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["nation", "customer", "events", "documents", "conversations"]
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float | decimal.Decimal):
        return round(float(v), 9)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    rel = duck.sql(ORACLE_SQL[name])
    cols = sorted(rel.columns)
    assert sorted(df.columns) == cols
    want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=str) == want


def test_entry_point_without_the_training_subpackage():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(QUERIES) <= set(names) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
    assert all(k in names for k in __spark_entry__.oracle_sql())


LARGE = ["already_read", "artifact_json", "dup_pages", "page_history", "session_report", "stream_new_pages"]


@pytest.mark.parametrize("name", LARGE)
def test_page_hashes_of_large_values(spark, tmp_path, name):
    """Values of events grow with the table; the product behind a page's hash must not be one of 32 bits."""
    con = duckdb.connect()
    con.sql(f"copy (select 100000 + i as event_id, timestamp '2024-01-01' + to_seconds(i) as ts, i % 3 as user_id, 'view' as event_type, 805.5 + i // 4 * 3 as value, '' as props from range(40) t(i)) to '{tmp_path}/events.parquet' (format parquet)")
    con.sql(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    rel = con.sql(ORACLE_SQL[name])
    cols = sorted(rel.columns)
    want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=str)
    assert want and sorted((tuple(plain(r[c]) for c in cols) for r in QUERIES[name](spark, str(tmp_path)).collect()), key=str) == want


def shuffled(spark, df):
    """Bytes written for exchanges while ``df`` runs."""
    sc = spark.sparkContext
    quantiles = sc._gateway.new_array(sc._jvm.double, 0)

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = sc._jsc.sc().statusStore().stageList(None, False, False, quantiles, None)
        return {x.stageId(): x.shuffleWriteBytes() for x in map(found.apply, range(found.size()))}

    before = stages()
    df.write.format("noop").mode("overwrite").save()
    return sum(n for k, n in stages().items() if k not in before)


def test_process_page_shuffles_texts_and_no_words(spark, tmp_path):
    """Three candidates have the words of a page; what is written for exchanges is the texts, dealt to cores and to pages, and little else."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.concat(F.when(i % 12 == 0, "\n").otherwise(""), F.substring(F.md5((F.col("id") * 2001 + i).cast("string").cast("binary")), 1, 6))), " ")
    spark.range(1, 401).select(F.col("id").alias("doc_id"), words.alias("text")).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    size = spark.read.parquet(f"{tmp_path}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    assert 0 < shuffled(spark, QUERIES["process_page"](spark, str(tmp_path))) < 2 * size


def test_process_page_of_odd_texts(spark, tmp_path):
    """Blank and missing texts and ids, and rows that stand twice under one id."""
    texts = ["One two.\nThree  four \t five six ", " \t\n \r\n", "", None, "a\tb\r\nc\f  d\n\n" + "line of words\n" * 45, "\n\n x", "!!!! ???? ----", "Dr. Rao came. He left. "]
    rows = [(i + 1, t) for i, t in enumerate(texts)] + [(17, texts[0]), (None, texts[0]), (30, texts[0]), (30, texts[0]), (31, texts[4]), (31, None), (32, "same words"), (32, "same words")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    rel = con.sql(ORACLE_SQL["process_page"])
    cols = sorted(rel.columns)
    want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=str)
    assert len(want) == len(rows) and sorted((tuple(plain(r[c]) for c in cols) for r in QUERIES["process_page"](spark, str(tmp_path)).collect()), key=str) == want
