"""Label sequences from text files, CSV tables and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_stem, labels_in


def exploded(lists: DataFrame, key: str, labels: str) -> DataFrame:
    return lists.select(key, F.posexplode(labels).alias("n", "label"))


def read_phone_files(spark: SparkSession, path: str) -> DataFrame:
    """(clip_id, n, label) of white-space separated text files, one clip each."""
    files = spark.read.text(path, wholetext=True).select(file_stem(F.col("_metadata.file_path")).alias("clip_id"), labels_in(F.col("value")).alias("labels"))
    return exploded(files, "clip_id", "labels")


def read_transcriptions(spark: SparkSession, path: str) -> DataFrame:
    """(clip_id, n, label) of a CSV table with the columns name and ph_seq; of repeated names the first line counts."""
    rows = spark.read.csv(path, header=True)
    missing = {"name", "ph_seq"} - set(rows.columns)
    if missing:
        raise ValueError(f"the table lacks {sorted(missing)}")
    rows = rows.select(F.trim("name").alias("clip_id"), "ph_seq", F.monotonically_increasing_id().alias("line")).filter("ph_seq is not null")
    first = rows.groupBy("clip_id").agg(F.min_by("ph_seq", "line").alias("ph_seq"))
    return exploded(first.select("clip_id", labels_in(F.col("ph_seq")).alias("labels")), "clip_id", "labels")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, token_id, is_global, is_stop) of a vocabulary in JSON."""
    kind = "symbols map<string,int>, global_symbols array<string>, stop_symbols array<string>, merged_groups array<array<string>>"
    v = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("v")).select("v.*")
    return v.select(F.explode("symbols").alias("symbol", "token_id"), "global_symbols", "stop_symbols").select("symbol", "token_id", F.coalesce(F.array_contains("global_symbols", F.col("symbol")), F.lit(False)).alias("is_global"), F.coalesce(F.array_contains("stop_symbols", F.col("symbol")), F.lit(False)).alias("is_stop"))
