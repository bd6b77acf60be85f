"""Streams (extensions: the batch operators over arriving files and events)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.audio import SUFFIXES, decoded


def arriving_clips(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """Audio files as they arrive in a folder, decoded like ``read_clips``; stateless, so no watermark is needed."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("maxFilesPerTrigger", files_at_once).load(path)
    return decoded(files.filter(F.lower("path").rlike(rf"\.({'|'.join(SUFFIXES)})$")))


def session_stream(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, started, ended, n): sessions of an event stream with a column ts; later events than ``late`` are dropped by the watermark."""
    timed = events.withColumn("at", F.to_timestamp("ts")).withWatermark("at", late)
    sessions = timed.groupBy("user_id", F.session_window("at", gap)).agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.count("*").alias("n"))
    return sessions.select("user_id", "started", "ended", "n")
