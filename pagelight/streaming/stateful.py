"""Streams with state for each device or session: page stability, state machine, duplicate pages, session rows.

Within a batch, rows of a key are taken in the order of (ts, event_id). State is one small row a key.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagelight.functions import dims
from pagelight.operators import history, interaction

CORNERS = [f"{a}{i}" for i in range(1, 5) for a in "xy"]


def stability(frames: DataFrame, key: str = "user_id", min_area: float = interaction.MIN_AREA, movement: float = interaction.MOVEMENT, required: int = interaction.STABLE_FRAMES) -> DataFrame:
    """(key, event_id, area_ratio, movement, stable_count, status) of each frame, as the batch operator gives it."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, previous = 0, None
        if state.exists:
            held = list(state.get)
            count, previous = held[0], held[1:] if held[1] is not None else None
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        out = []
        for r in rows.itertuples(index=False):
            found = bool(r.found) and r.area_ratio is not None and r.area_ratio >= min_area
            moved = None
            if not found:
                count, previous, status = 0, None, "PAGE_NOT_FOUND"
            else:
                now = [getattr(r, c) for c in CORNERS]
                if previous is None:
                    count, moved = 1, 0.0
                else:
                    diagonal = math.sqrt(r.width * r.width + r.height * r.height)
                    gaps = [math.hypot(now[i] - previous[i], now[i + 1] - previous[i + 1]) for i in range(0, 8, 2)]
                    moved = sum(gaps) / 4 / diagonal if diagonal else 1.0
                    count = count + 1 if moved <= movement else max(0, count - 1)
                previous = now
                status = "PAGE_STABLE" if count >= required else "PAGE_DETECTED"
            out.append((k[0], r.event_id, r.area_ratio, moved, count, status))
        state.update((count, *(previous or [None] * 8)))
        yield pd.DataFrame(out, columns=[key, "event_id", "area_ratio", "movement", "stable_count", "status"])

    kind = dict(frames.dtypes)[key]
    return frames.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_id long, area_ratio double, movement double, stable_count long, status string", "count long, " + ", ".join(f"{c} double" for c in CORNERS), "append", GroupStateTimeout.NoTimeout)


def replay(requests: DataFrame, key: str = "user_id", start: str = "INITIALIZING") -> DataFrame:
    """(key, event_id, requested, from_state, to_state, accepted, notified) of each request."""
    edges = {a: set(more) for a, more in dims.EDGES.items()}

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else start
        out = []
        for r in pd.concat(list(parts)).sort_values(["ts", "event_id"]).itertuples(index=False):
            moves = r.requested in edges[now]
            out.append((k[0], r.event_id, r.requested, now, r.requested if moves else now, moves or r.requested == now, moves))
            now = out[-1][4]
        state.update((now,))
        yield pd.DataFrame(out, columns=[key, "event_id", "requested", "from_state", "to_state", "accepted", "notified"])

    kind = dict(requests.dtypes)[key]
    return requests.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_id long, requested string, from_state string, to_state string, accepted boolean, notified boolean", "state string", "append", GroupStateTimeout.NoTimeout)


def new_pages(pages: DataFrame, watermark: str | None = None) -> DataFrame:
    """Pages whose hash their session has not shown before. Without a watermark the state keeps every hash; with one, those seen within it."""
    given = pages.filter("image_hash <> ''")
    if watermark:
        return given.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["session_id", "image_hash"])
    return given.dropDuplicates(["session_id", "image_hash"])


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """Drain a stream in append mode into a table in the shared ``folder`` and read it."""
    out = f"{folder}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def _versions(spark: SparkSession, base: str, below: int) -> dict[int, str]:
    """Of each bucket the folder that the newest batch before ``below`` wrote for it; at most ``buckets`` entries."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/v*/bucket=*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    newest: dict[int, int] = {}
    for status in found or []:
        at = status.getPath()
        number, bucket = int(at.getParent().getName()[1:]), int(at.getName().partition("=")[2])
        if number < below:
            newest[bucket] = max(number, newest.get(bucket, -1))
    return {bucket: f"{base}/v{number}/bucket={bucket}" for bucket, number in newest.items()}


def upsert_to_end(changes: DataFrame, folder: str, buckets: int = 64) -> DataFrame:
    """Session rows after a stream of changes. Sessions lie in ``buckets`` by their hash; a batch reads and writes only those it touches.

    Each batch writes its buckets as a version of its own, so a repeated batch starts from the same rows and writes the same files.
    """
    spark: SparkSession = changes.sparkSession
    base = f"{folder}/sessions-{uuid.uuid4().hex}"
    place = F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")
    columns = [c.split()[0] for c in history.SESSIONS.split(",")]

    def fold(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        touched = {r.bucket for r in batch.select(place.alias("bucket")).distinct().collect()}
        before = [path for bucket, path in _versions(own, base, number).items() if bucket in touched]
        rows = history.merged(own.read.schema(history.SESSIONS).parquet(*before), batch) if before else history.upsert(batch)
        rows.withColumn("bucket", place).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/v{number}")

    query = changes.writeStream.foreachBatch(fold).option("checkpointLocation", f"{base}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    last = list(_versions(spark, base, 1 << 62).values())
    if not last:
        return spark.createDataFrame([], history.SESSIONS)
    return spark.read.schema(history.SESSIONS).parquet(*last).select(*columns)
