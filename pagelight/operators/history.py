"""Sessions, read pages and what is kept of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelight.functions import text as T
from pagelight.sources.folders import shared_folder

SESSIONS = "session_id STRING, book_id STRING, start_time TIMESTAMP, last_updated TIMESTAMP, preferred_language STRING, read_mode STRING, current_page INT, current_sentence INT"
PAGES = (
    "id BIGINT, session_id STRING, page_index INT, image_hash STRING, detected_language STRING, composite_score DOUBLE, average_confidence DOUBLE, selected_variant STRING, "
    "selected_psm INT, raw_text STRING, cleaned_text STRING, sentences ARRAY<STRING>, original_image_path STRING, processed_image_path STRING, created_at TIMESTAMP"
)
LATEST = ["preferred_language", "read_mode", "current_page", "current_sentence"]


def create_tables(spark: SparkSession, buckets: int = 16) -> None:
    """Session and page tables, if they are not there. Pages are bucketed by session, for lookups and joins within one."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS reading_sessions ({SESSIONS}) USING parquet")
    spark.sql(f"CREATE TABLE IF NOT EXISTS page_history ({PAGES}) USING parquet CLUSTERED BY (session_id) INTO {buckets} BUCKETS")


def upsert(changes: DataFrame) -> DataFrame:
    """Session rows after a log of changes (session_id, seq, ts, book_id, ...): the first change gives book and start, the last one the rest."""
    first = lambda c: F.min_by(c, "seq")
    return changes.groupBy("session_id").agg(
        first("book_id").alias("book_id"),
        first("ts").alias("start_time"),
        F.max_by("ts", "seq").alias("last_updated"),
        *[F.max_by(c, "seq").alias(c) for c in LATEST],
    )


def merged(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """``sessions`` brought up to date by newer ``changes``."""
    new = upsert(changes)
    both = sessions.alias("o").join(new.alias("n"), "session_id", "full")
    keep = lambda c: F.when(F.col("o.start_time").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    take = lambda c: F.when(F.col("n.start_time").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return both.select("session_id", keep("book_id"), keep("start_time"), *[take(c) for c in ["last_updated", *LATEST]])


def duplicates(pages: DataFrame) -> DataFrame:
    """Marks pages (session_id, seq, image_hash) whose hash the session has read before; an empty hash never counts."""
    rank = F.row_number().over(Window.partitionBy("session_id", "image_hash").orderBy("seq"))
    given = F.coalesce(F.col("image_hash") != "", F.lit(False))
    return pages.withColumn("is_duplicate", given & (rank > 1))


def already_read(new: DataFrame, known: DataFrame) -> DataFrame:
    """New pages whose hash stands in the session's history."""
    return new.filter("image_hash <> ''").join(known.select("session_id", "image_hash"), ["session_id", "image_hash"], "left_semi")


def page_valid(valid: Column, sentences: Column) -> Column:
    return F.coalesce(valid, F.lit(False)) & (F.size(F.coalesce(sentences, F.array().cast("array<string>"))) > 0)


def numbered(pages: DataFrame, order: str = "seq") -> DataFrame:
    """Accepted pages with their number in the session, from 1."""
    return pages.withColumn("page_index", F.row_number().over(Window.partitionBy("session_id").orderBy(order)))


def with_ids(pages: DataFrame, base: int, order: str) -> DataFrame:
    """Consecutive ids after ``base``: counts of ordered ranges first, then positions inside each, so that no task sees all rows.

    The ranges are written with their rows: made anew for the counts, they could be cut or joined elsewhere.
    """
    spark = pages.sparkSession
    cut = pages.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    path = f"{shared_folder(spark)}/ranges-{uuid.uuid4().hex}"
    cut.write.parquet(path)
    ranged = spark.read.schema(cut.schema).parquet(path)
    ranged = ranged.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return ranged.join(F.broadcast(counts), "_part").withColumn("id", F.col("_before") + F.col("_rn") + base).drop("_part", "_rn", "_before")


def append(pages: DataFrame, table: str = "page_history") -> None:
    pages.write.mode("append").insertInto(table)


def report(sessions: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages, mean score and sentences of each session, sessions without pages included."""
    own = pages.groupBy("session_id").agg(F.count("*").alias("n_pages"), F.avg("composite_score").alias("mean_score"), F.sum(F.size("sentences")).alias("n_sentences"))
    return sessions.join(own, "session_id", "left").fillna(0, ["n_pages", "n_sentences"])


def artifact_name(ts: Column, image_hash: Column) -> Column:
    """``page_`` with the time to the millisecond and the first half of the hash."""
    return F.concat(F.lit("page_"), F.substring(F.date_format(ts, "yyyyMMdd_HHmmss_SSSSSS"), 1, 19), F.lit("_"), F.substring(image_hash, 1, 8))


def artifacts(pages: DataFrame) -> DataFrame:
    """(name, json): one document for each page."""
    return pages.select(artifact_name(F.col("created_at"), F.col("image_hash")).alias("name"), F.to_json(F.struct(*[c for c in pages.columns if c != "created_at"])).alias("json"))


def write_artifacts(pages: DataFrame, path: str) -> None:
    """JSON documents, one folder for each session."""
    pages.write.partitionBy("session_id").mode("overwrite").json(path)


def needs_translation(mode: Column, detected: Column, preferred: Column) -> Column:
    """Translated mode and different languages, whichever code form they come in."""
    return F.coalesce((mode == "translated") & (T.to_iso(detected) != T.to_iso(preferred)), F.lit(False))


def translate(sentences: DataFrame, source: str, target: str, translator: Callable[[str, str, str], str] | None = None) -> DataFrame:
    """Adds ``translated`` to rows with a column ``sentence``: each distinct sentence of a language pair is translated once.

    Blank sentences become empty, equal languages and failures leave the sentence. Without a translator every sentence stays.
    """
    own = sentences.withColumns({"_src": T.to_iso(F.col(source)), "_tgt": T.to_iso(F.col(target))})
    if translator is None:
        return own.withColumn("translated", F.when(T.blank(F.col("sentence")), "").otherwise(F.col("sentence"))).drop("_src", "_tgt")
    todo = own.filter(~T.blank(F.col("sentence")) & (F.col("_src") != F.col("_tgt"))).select("sentence", "_src", "_tgt").distinct()

    def run(batches):
        for pdf in batches:
            out = []
            for s, a, b in zip(pdf.sentence, pdf["_src"], pdf["_tgt"], strict=True):
                try:
                    out.append(translator(s, a, b))
                except Exception:  # a failed call keeps the sentence
                    out.append(s)
            yield pdf.assign(done=out)

    done = todo.mapInPandas(run, "sentence string, _src string, _tgt string, done string")
    joined = own.join(done, ["sentence", "_src", "_tgt"], "left")
    return joined.withColumn("translated", F.when(T.blank(F.col("sentence")), "").otherwise(F.coalesce("done", "sentence"))).drop("_src", "_tgt", "done")
