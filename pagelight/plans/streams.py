"""Streaming twins of the stateful queries; the batch queries' SQL holds for them too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelight.functions import text as T
from pagelight.plans import history as H
from pagelight.plans import interaction as N
from pagelight.plans.registry import ORACLE_SQL, query
from pagelight.sources.folders import shared_folder, table_stream
from pagelight.streaming import stateful as S


class _Streamed:
    """Lets the batch builders read ``events`` as a stream."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.read = self

    def parquet(self, path: str) -> DataFrame:
        folder, _, name = path.rpartition("/")
        return table_stream(self.spark, folder, name.removesuffix(".parquet"))


@query(ORACLE_SQL["stability"])
def stream_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = S.run_to_end(S.stability(N.frames(_Streamed(spark), sf_dir)), shared_folder(spark))
    return made.select("user_id", "event_id", T.rounded(F.col("area_ratio"), 6).alias("area_ratio"), T.rounded(F.col("movement"), 6).alias("movement"), "stable_count", "status")


@query(ORACLE_SQL["fsm_replay"])
def stream_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run_to_end(S.replay(N.requests(_Streamed(spark), sf_dir)), shared_folder(spark))


@query(f"WITH {H.PAGES} SELECT DISTINCT session_id, image_hash FROM ok WHERE image_hash <> ''")
def stream_new_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = H.pages(_Streamed(spark), sf_dir).filter(H.O.page_valid(F.col("is_valid"), F.col("sentences")))
    return S.run_to_end(S.new_pages(valid), shared_folder(spark)).select("session_id", "image_hash")


@query(ORACLE_SQL["session_upsert"])
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.upsert_to_end(H.changes(_Streamed(spark), sf_dir), shared_folder(spark))
