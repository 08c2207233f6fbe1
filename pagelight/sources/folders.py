"""Scans and settings: image files, table streams, options."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, else, as in tests, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found or "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of image files; unreadable paths raise as any missing input does."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def raw_gray(images: DataFrame) -> DataFrame:
    """Pixels (path, y, x, v) of binary portable graymaps: magic ``P5``, width, height and 255 on lines of their own, then bytes.

    Files of any other form give no pixels; other formats need a decoder, which the engine leaves to the caller.
    """
    head = F.decode(F.substring("content", 1, 64), "ISO-8859-1")
    parts = F.regexp_extract_all(head, F.lit(r"^P5\s(\d+)\s(\d+)\s255\s"), F.lit(0))
    own = images.withColumn("h", F.get(parts, F.lit(0))).filter("h IS NOT NULL")
    own = own.withColumns({"w": F.regexp_extract("h", r"^P5\s(\d+)", 1).cast("int"), "n": F.length("h")})
    # bytes are cut from the binary column in place, and only numbers are spread to rows
    byte = lambda i: F.conv(F.hex(F.substring(F.col("content"), i, F.lit(1))), 16, 10).cast("int")
    values = F.transform(F.sequence(F.col("n") + 1, F.octet_length("content")), byte)
    spread = own.select("path", "w", F.posexplode(values).alias("i", "v"))
    return spread.select("path", F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).alias("x"), "v")


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A table's files as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    made = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return made.parquet(path)
    return made.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)  # a stream reads folders


def truthy(value: str | None, default: bool = False) -> bool:
    return default if value is None else value.lower() in ("true", "1", "yes")


@dataclass(frozen=True)
class Settings:
    """Options with their defaults, read from the session's configuration under ``pagelight.``."""

    language: str = "en"
    languages: str = "eng,tam,kan,tel,mal,hin"
    fast_mode: bool = False
    max_variants: int = 4
    max_psms: int = 2
    early_stop_score: float = 85.0
    confidence_threshold: float = 40.0
    stability_frames: int = 4
    min_area_ratio: float = 0.15
    max_movement: float = 0.03
    speech_speed: int = 175
    speech_volume: float = 1.0
    camera_width: int = 1920
    camera_height: int = 1080
    translation: bool = False
    translation_target: str = "en"
    platform: str = "mac"
    camera_backend: str = "mac"
    camera_index: int = 0
    camera_fps: int = 30
    detection_fps: int = 10
    audio_backend: str = "mac"
    audio_device: str = "plughw:3,0"
    recogniser: str = ""
    recogniser_data: str = ""
    pin_power: int = 17
    pin_volume_up: int = 27
    pin_volume_down: int = 22
    pin_light: int = 24
    debug: bool = True
    preview: bool = False
    save_images: bool = True
    data_folder: str = "data"

    @classmethod
    def load(cls, spark: SparkSession) -> Settings:
        given = {}
        for name, kind in cls.__annotations__.items():
            value = spark.conf.get(f"pagelight.{name}", None)
            if value is not None:
                given[name] = truthy(value) if kind == "bool" else {"int": int, "float": float}.get(kind, str)(value)
        return cls(**given)

    @property
    def language_list(self) -> list[str]:
        return [x.strip() for x in (self.languages or type(self).languages).replace("+", ",").split(",") if x.strip()]

    @property
    def folders(self) -> dict[str, str]:
        """Where captures, processed images, recognised pages, logs and the tables lie."""
        return {name: f"{self.data_folder}/{name}" for name in ("captures", "processed", "ocr", "logs", "tables")}

    @property
    def resolution(self) -> tuple[int, int]:
        return self.camera_width, self.camera_height
