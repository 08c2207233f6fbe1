"""Queries over sessions and page history; the logs derive from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelight.functions import dims
from pagelight.functions import text as T
from pagelight.operators import history as O
from pagelight.plans.registry import documents, query, table
from pagelight.plans.text import R, quoted, report, rows, sql_clean, sql_sentences, values

LANGS = ["en", "hi", "ta", "eng", "tam"]


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        F.concat(F.lit("s"), "user_id").alias("session_id"),
        i.alias("seq"),
        "ts",
        F.when(i % 3 != 0, F.concat(F.lit("b"), (i % 7).cast("string"))).alias("book_id"),
        F.element_at(F.array(*map(F.lit, LANGS)), (i % 5 + 1).cast("int")).alias("preferred_language"),
        F.when(i % 2 == 0, "original").otherwise("translated").alias("read_mode"),
        (i % 40).cast("int").alias("current_page"),
        F.floor("value").cast("int").alias("current_sentence"),
    )


_L = f"[{', '.join(map(quoted, LANGS))}]"
CHANGES = f"""ch AS (SELECT 's' || user_id AS session_id, event_id AS seq, ts, CASE WHEN event_id % 3 <> 0 THEN 'b' || (event_id % 7) END AS book_id, {_L}[CAST(event_id % 5 + 1 AS INT)] AS preferred_language,
CASE WHEN event_id % 2 = 0 THEN 'original' ELSE 'translated' END AS read_mode, CAST(event_id % 40 AS INT) AS current_page, CAST(floor(value) AS INT) AS current_sentence FROM events)"""
SESSIONS = f"""{CHANGES}, se AS (SELECT session_id, arg_min_null(book_id, seq) AS book_id, arg_min(ts, seq) AS start_time, arg_max(ts, seq) AS last_updated, arg_max_null(preferred_language, seq) AS preferred_language,
arg_max_null(read_mode, seq) AS read_mode, arg_max_null(current_page, seq) AS current_page, arg_max_null(current_sentence, seq) AS current_sentence FROM ch GROUP BY session_id)"""


@query(f"WITH {SESSIONS} SELECT * FROM se")
def session_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.upsert(changes(spark, sf_dir))


@query(f"""WITH {SESSIONS} SELECT * FROM se""")
def session_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows when the log comes in two parts."""
    log = changes(spark, sf_dir)
    return O.merged(O.upsert(log.filter("seq < 500")), log.filter("seq >= 500"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recognised page for each event; hashes repeat, some are empty, some pages are invalid or have no sentences."""
    i, v = F.col("event_id"), F.floor("value").cast("long")
    hashed = F.when(i % 11 == 0, "").otherwise(F.lower(F.lpad(F.hex((v * 2654435 + 17) % 1000003), 16, "0")))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("s"), "user_id").alias("session_id"),
        i.alias("seq"),
        hashed.alias("image_hash"),
        (F.col("event_type") != "error").alias("is_valid"),
        F.when(i % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("First "), i.cast("string")), F.lit("Zweiter é"))).alias("sentences"),
        F.col("value").alias("composite_score"),
        "ts",
    )


PAGES = """pg AS (SELECT 's' || user_id AS session_id, event_id AS seq, CASE WHEN event_id % 11 = 0 THEN '' ELSE lpad(lower(to_hex(CAST((CAST(floor(value) AS BIGINT) * 2654435 + 17) % 1000003 AS BIGINT))), 16, '0') END AS image_hash, event_type <> 'error' AS is_valid,
CASE WHEN event_id % 13 = 0 THEN [] ELSE ['First ' || event_id, 'Zweiter é'] END AS sentences, value AS composite_score, ts FROM events),
ok AS (SELECT * FROM pg WHERE is_valid AND len(sentences) > 0),
du AS (SELECT *, image_hash <> '' AND row_number() OVER (PARTITION BY session_id, image_hash ORDER BY seq) > 1 AS is_duplicate FROM ok),
nu AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS page_index FROM du WHERE NOT is_duplicate)"""


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = pages(spark, sf_dir).filter(O.page_valid(F.col("is_valid"), F.col("sentences")))
    return O.numbered(O.duplicates(valid).filter("NOT is_duplicate"))


@query(f"WITH {PAGES} SELECT session_id, seq, image_hash, is_duplicate FROM du")
def dup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = pages(spark, sf_dir).filter(O.page_valid(F.col("is_valid"), F.col("sentences")))
    return O.duplicates(valid).select("session_id", "seq", "image_hash", "is_duplicate")


@query(f"WITH {PAGES} SELECT session_id, seq, image_hash FROM ok WHERE seq % 2 = 1 AND image_hash <> '' AND EXISTS (SELECT 1 FROM ok o WHERE o.seq % 2 = 0 AND o.session_id = ok.session_id AND o.image_hash = ok.image_hash)")
def already_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = pages(spark, sf_dir).filter(O.page_valid(F.col("is_valid"), F.col("sentences")))
    return O.already_read(valid.filter("seq % 2 = 1"), valid.filter("seq % 2 = 0")).select("session_id", "seq", "image_hash")


@query(f"""WITH {PAGES} SELECT row_number() OVER (ORDER BY seq) AS id, session_id, page_index, image_hash, composite_score, len(sentences) AS n_sentences, to_json(sentences) AS sentences_json FROM nu""")
def page_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = O.with_ids(accepted(spark, sf_dir), 0, "seq")
    return made.select("id", "session_id", "page_index", "image_hash", "composite_score", F.size("sentences").alias("n_sentences"), F.to_json("sentences").alias("sentences_json"))


@query(f"""WITH {SESSIONS}, {PAGES}, r AS (SELECT session_id, count(*) AS n_pages, avg(CAST(round(composite_score * 100) AS BIGINT)) AS s, sum(len(sentences)) AS n_sentences FROM nu GROUP BY session_id)
SELECT se.session_id, book_id, coalesce(n_pages, 0) AS n_pages, CAST(coalesce(n_sentences, 0) AS BIGINT) AS n_sentences, {R("s / 100", 4)} AS mean_score FROM se LEFT JOIN r ON r.session_id = se.session_id""")
def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = accepted(spark, sf_dir).withColumn("composite_score", F.round(F.col("composite_score") * 100).cast("long"))
    made = O.report(O.upsert(changes(spark, sf_dir)), exact)
    return made.select("session_id", "book_id", "n_pages", "n_sentences", T.rounded(F.col("mean_score") / 100, 4).alias("mean_score"))


@query(f"""WITH {PAGES} SELECT 'page_' || strftime(ts, '%Y%m%d_%H%M%S_') || substr(strftime(ts, '%f'), 1, 3) || '_' || substr(image_hash, 1, 8) AS name, to_json(struct_pack(session_id := session_id, seq := seq, image_hash := image_hash, sentences := sentences)) AS json FROM nu""")
def artifact_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.artifacts(accepted(spark, sf_dir).select("session_id", "seq", "image_hash", "sentences", F.col("ts").alias("created_at")))


@query(f"""WITH c AS ({sql_clean("documents", "doc_id", "text")}), s AS ({sql_sentences("c", "doc_id", "cleaned")})
SELECT c.doc_id, 'Sentences: ' || len(ss) || chr(10) || array_to_string(list_transform(ss, lambda x, i: i || '. ' || x), chr(10)) AS report FROM c JOIN s ON s.doc_id = c.doc_id""")
def console_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = report(documents(spark, sf_dir))
    lines = F.transform("sentences", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    return made.select("doc_id", F.concat(F.lit("Sentences: "), F.size("sentences").cast("string"), F.lit("\n"), F.array_join(lines, "\n")).alias("report"))


TODO = [(1, "One.", "translated", "eng", "en"), (2, "Two.", "translated", "hin", "en"), (3, " ", "translated", "hin", "en"), (4, "One.", "original", "tam", "en"), (5, "Two.", "translated", "hi", "EN"), (6, None, "translated", "tam", "hi"), (7, "x", None, "tam", "hi")]
_ISO = lambda c: f"coalesce(CASE {' '.join(f'WHEN lower({c}) = {quoted(a)} THEN {quoted(b)}' for a, b in dims.ISO.items())} END, lower({c}))"


@query(f"SELECT id, coalesce(mode = 'translated' AND {_ISO('src')} <> {_ISO('tgt')}, false) AS needed, CASE WHEN s IS NULL OR trim(s) = '' THEN '' ELSE s END AS translated, count(*) OVER (PARTITION BY s, {_ISO('src')}, {_ISO('tgt')}) AS shared FROM {values(TODO, 'id, s, mode, src, tgt')}")
def translate_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    own = rows(spark, TODO, "id int, sentence string, mode string, src string, tgt string")
    made = O.translate(own, "src", "tgt").withColumn("needed", O.needs_translation(F.col("mode"), F.col("src"), F.col("tgt")))
    shared = F.count("*").over(Window.partitionBy("sentence", T.to_iso(F.col("src")), T.to_iso(F.col("tgt"))))
    return made.select("id", "needed", "translated", shared.alias("shared"))


@query(f"SELECT id, image_hash, 'unknown' AS detected_language, 'Unknown' AS detected_script, 0.0 AS composite_score, 'none' AS selected_variant, 0 AS selected_psm, false AS is_valid, message FROM {values([(1, '', 'Empty or invalid image provided'), (2, '00ff', 'Image quality issue: IMAGE_TOO_DARK')], 'id, image_hash, message')}")
def error_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = rows(spark, [(1, "", "Empty or invalid image provided"), (2, "00ff", "Image quality issue: IMAGE_TOO_DARK")], "id int, image_hash string, message string")
    return own.select("id", "image_hash", F.lit("unknown").alias("detected_language"), F.lit("Unknown").alias("detected_script"), F.lit(0.0).alias("composite_score"), F.lit("none").alias("selected_variant"), F.lit(0).alias("selected_psm"), F.lit(False).alias("is_valid"), "message")
