"""Writers: one TextGrid for each clip, diagnosis as JSON, evaluation as CSV, and the run's summary."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_text_grids(files: DataFrame, key: str, path: str) -> None:
    """Writes (key, content) rows, one for each key, as ``path/<key>.TextGrid``.

    Spark's writer puts the rows into a folder beside them, so any store will do; then each file gets its name, on
    the driver, which handles names only. A slash in a key makes a folder."""
    spark = files.sparkSession
    staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    rows = files.select(F.regexp_replace("content", "\n$", "").alias("value"), F.col(key).cast("string").alias("clip"))  # the writer ends the line
    rows.write.partitionBy("clip").text(staged)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(staged)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for at in store.listStatus(folder):
        if not at.isDirectory():
            continue
        clip = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(at.getPath().getName().partition("=")[2])
        to = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{clip}.TextGrid")
        store.mkdirs(to.getParent())
        (part,) = [f.getPath() for f in store.listStatus(at.getPath()) if f.getPath().getName().startswith("part-")]
        if not store.rename(part, to):
            raise OSError(f"{to.toString()} could not be written; does it exist?")
    store.delete(folder, True)


def write_diagnosis(metrics: DataFrame, path: str) -> None:
    """One JSON object for each clip: identifier and the four measures, properly escaped."""
    metrics.select("identifier", "num_frames", "num_tokens", "agreement", "confidence", "determinacy", "monotonicity").write.json(path)


def write_evaluation(errors: DataFrame, key: str, path: str) -> None:
    """CSV of (key, n, mae) rows in order of the key: identifier, intervals, onset_mae_ms with three decimals."""
    rows = errors.orderBy(key).select(F.col(key).alias("identifier"), F.col("n").alias("intervals"), F.format_string("%.3f", F.col("mae").cast("double")).alias("onset_mae_ms"))
    rows.write.option("header", True).csv(path)


def run_summary(clips: DataFrame) -> DataFrame:
    """(status, n): how many clips of a run are ``ok`` and how many were ``skipped`` (their ``error`` says why)."""
    return clips.groupBy(F.when(F.col("error").isNull(), "ok").otherwise("skipped").alias("status")).agg(F.count("*").alias("n"))
