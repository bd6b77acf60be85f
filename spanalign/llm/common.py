"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the corpus, through Spark's reader only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs on one machine (tests), a local folder is made and set; on a cluster
    that is an error, as executors could not read what others wrote.
    """
    set_here = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not set_here:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_here = tempfile.mkdtemp(prefix="spanalign-")
        spark.sparkContext.setCheckpointDir(set_here)
    return set_here


def stored(df: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again (column-pruned and compressed); cuts the lineage.

    The table's path is added to ``scratch``, for ``discard``.
    """
    path = f"{shared_dir(df.sparkSession)}/spanalign-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, scratch: list[str]) -> None:
    """Delete tables of ``stored`` that no plan reads any more, and empty the list."""
    for path in scratch:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    scratch.clear()


def free_name(columns: list[str], name: str) -> str:
    """A column name that ``columns`` do not hold (names are compared without regard to case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of so many rows, unless the session asks for fewer: a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def slices(batches: Iterator, rows: int) -> Iterator:
    """The Arrow batches in parts of at most ``rows`` rows, so that a worker holds few Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8_size(text: str | object) -> object:
    """Column: UTF-8 bytes of a text column, null counts as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def pieces(text: str, most: int = 1 << 20) -> Iterator[str]:
    """Cut a very long text at ASCII white space into pieces of about ``most`` characters.

    A stretch without white space stays whole, whatever its length; the white space stays at the head of the next piece.
    """
    at, n = 0, len(text)
    while n - at > most:
        cut_at = max(text.rfind(" ", at + 1, at + most), text.rfind("\n", at + 1, at + most))
        if cut_at <= at:
            found = [x for x in (text.find(" ", at + most), text.find("\n", at + most)) if x >= 0]
            if not found:
                break
            cut_at = min(found)
        yield text[at:cut_at]
        at = cut_at
    yield text[at:]
