"""Scores of predicted intervals against true ones; both (ident, ord, on_ms, off_ms, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def without_marks(intervals: DataFrame, marks: list[str]) -> DataFrame:
    """The intervals whose text is none of the marks; those that are left are compared by their new positions."""
    return intervals.filter(~F.coalesce(F.col("text").isin(marks), F.lit(False)))


def paired(pred: DataFrame, true: DataFrame, key: str) -> DataFrame:
    """Intervals of common identifiers, by position: (key, d_on, d_off, same)."""
    seq = Window.partitionBy(key).orderBy("ord")
    a = pred.select(key, F.row_number().over(seq).alias("pos"), "on_ms", "off_ms", "text")
    b = true.select(key, F.row_number().over(seq).alias("pos"), F.col("on_ms").alias("t_on"), F.col("off_ms").alias("t_off"), F.col("text").alias("t_text"))
    return a.join(b, [key, "pos"]).select(key, "pos", F.abs(F.col("on_ms") - F.col("t_on")).alias("d_on"), F.abs(F.col("off_ms") - F.col("t_off")).alias("d_off"), (F.col("text") == F.col("t_text")).alias("same"))


def summary(pairs: DataFrame, tolerances_ms: list[int]) -> DataFrame:
    """One row: mean, median (of two middle values the midpoint), maximum and 90th percentile (the value at index int(0.9 n)) of both errors, hit and label rates.

    The percentile is found by counting equal values first, so no list of all errors is built."""
    hits = [F.avg(F.when((F.col("d_on") <= t) & (F.col("d_off") <= t), 100.0).otherwise(0.0)).alias(f"hit_{t}") for t in tolerances_ms]
    base = pairs.agg(F.count("*").alias("intervals"), F.avg("d_on").alias("on_mean"), F.median("d_on").alias("on_median"), F.max("d_on").alias("on_max"), F.avg("d_off").alias("off_mean"), F.median("d_off").alias("off_median"), F.max("d_off").alias("off_max"), F.avg(F.col("same").cast("double")).alias("label_rate"), *hits)
    for side in ("on", "off"):
        base = base.crossJoin(ninetieth(pairs, f"d_{side}").withColumnRenamed("p90", f"{side}_p90"))  # one row each
    return base


def ninetieth(pairs: DataFrame, column: str, run: int = 4096) -> DataFrame:
    """The value at index int(0.9 n) of the sorted ones. Equal values are counted, counts are summed in runs of ``run``
    neighbouring values, then within a run: the only window over all rows sees one row a run."""
    counts = pairs.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).withColumn("run", F.expr(f"v div {run}"))
    runs = counts.groupBy("run").agg(F.sum("n").alias("m"))
    runs = runs.select("run", (F.sum("m").over(Window.orderBy("run")) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy()).alias("all"))
    upto = F.sum("n").over(Window.partitionBy("run").orderBy("v")) + F.col("before")
    return counts.join(runs, "run").select("v", "all", upto.alias("upto")).filter(F.col("upto") > F.floor(F.col("all") * 9 / 10)).agg(F.min("v").alias("p90"))


def run_difference(reference: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """How a run differs from the reference, for each clip of the reference; a clip that the run lacks counts as empty.

    (key, n, n_other, identical, max_diff, mean_diff, label_misses): positions are compared as far as both go;
    ``identical`` needs equal numbers of intervals too."""
    seq = Window.partitionBy(key).orderBy("ord")
    place = lambda df, mark: df.select(key, F.row_number().over(seq).alias("pos"), *[F.col(c).alias(f"{mark}_{c}") for c in ("on_ms", "off_ms", "text")])
    both = place(reference, "a").join(place(other, "b"), [key, "pos"], "left").withColumn("met", F.col("b_on_ms").isNotNull())
    on, off = F.abs(F.col("a_on_ms") - F.col("b_on_ms")), F.abs(F.col("a_off_ms") - F.col("b_off_ms"))
    compared = both.groupBy(key).agg(
        F.count("*").alias("n"),
        F.bool_and(F.coalesce((on <= 0) & (off <= 0), F.lit(False))).alias("same"),
        F.coalesce(F.max(F.greatest(on, off)), F.lit(0)).alias("max_diff"),
        F.coalesce(F.avg((on + off) / 2), F.lit(0.0)).alias("mean_diff"),
        F.count_if(F.col("a_text") != F.col("b_text")).alias("label_misses"),
    )
    sizes = other.groupBy(key).agg(F.count("*").alias("m"))
    n_other = F.coalesce("m", F.lit(0).cast("long"))
    return compared.join(sizes, key, "left").select(key, "n", n_other.alias("n_other"), (F.col("same") & (F.col("n") == n_other)).alias("identical"), "max_diff", "mean_diff", "label_misses")


def worst(pairs: DataFrame, key: str, k: int) -> DataFrame:
    """The k identifiers of the largest mean onset error (a report of that size)."""
    per = pairs.groupBy(key).agg(F.avg("d_on").alias("mae"), F.count("*").alias("n"))
    return per.orderBy(F.desc("mae"), F.desc(key), F.desc("n")).limit(k)
