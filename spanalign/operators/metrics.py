"""Reference-free quality of an alignment, from spans (key, n, on_f, off_f) and cells (key, t, n, s)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import evidence

HALF_WIDTH, FLOOR = 5, 1e-8


def confidence(cells: DataFrame, spans: DataFrame, key: str = "clip_id") -> DataFrame:
    """Mean over labels of the mean similarity inside the label's span; a skipped label counts 0."""
    inside = spans.join(cells, [key, "n"]).filter("t >= on_f and t < off_f").groupBy(key, "n").agg(F.avg("s").alias("m"))
    return spans.select(key, "n").join(inside, [key, "n"], "left").groupBy(key).agg(F.avg(F.coalesce("m", F.lit(0.0))).alias("confidence"))


def frame_owner(frames: DataFrame, spans: DataFrame, key: str = "clip_id") -> DataFrame:
    """(key, t, n, inside): the last label that starts at or before each frame (-1: none), and whether it still lasts.

    An as-of join as one window over frames and starts."""
    starts = spans.groupBy(key, F.col("on_f").alias("t")).agg(F.max_by(F.struct("n", "off_f"), "n").alias("x"))
    both = frames.select(key, "t").distinct().join(starts, [key, "t"], "full")
    seq = Window.partitionBy(key).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("x", F.last("x", ignorenulls=True).over(seq))
    own = held.join(frames.select(key, "t").distinct(), [key, "t"], "left_semi")
    return own.select(key, "t", F.coalesce("x.n", F.lit(-1)).alias("n"), (F.coalesce("x.off_f", F.lit(0)) > F.col("t")).alias("inside"))


def determinacy(cells: DataFrame, spans: DataFrame, key: str = "clip_id") -> DataFrame:
    """Evidence of the owning labels in their frames over the evidence of all labels within 5 of the place."""
    last = spans.groupBy(key).agg(F.max("n").alias("last"))
    owner = frame_owner(cells, spans, key).join(last, key).select(key, "t", "n", "inside", F.when(F.col("inside"), F.col("n")).otherwise(F.least(F.col("n") + 1, F.col("last"))).alias("at"))
    seq = Window.partitionBy(key, "t").orderBy("n").rangeBetween(-HALF_WIDTH, HALF_WIDTH)
    local = cells.withColumn("a", evidence(F.col("s"))).withColumn("local", F.sum("a").over(seq)).select(key, "t", F.col("n").alias("at"), "a", "local")
    joined = owner.join(local, [key, "t", "at"])
    return joined.groupBy(key).agg((F.sum(F.when(F.col("inside"), F.col("a")).otherwise(0.0)) / (F.sum("local") + FLOOR)).alias("determinacy"))


def monotonicity(cells: DataFrame, spans: DataFrame, key: str = "clip_id") -> DataFrame:
    """Mean over owned frames with any evidence of the share of it on the owner and later labels."""
    seq = Window.partitionBy(key, "t")
    sums = cells.withColumn("a", evidence(F.col("s"))).select(key, "t", "n", F.sum("a").over(seq.orderBy("n").rowsBetween(0, Window.unboundedFollowing)).alias("later"), F.sum("a").over(seq).alias("all"))
    owned = frame_owner(cells, spans, key).filter("inside").join(sums.filter("all > 0"), [key, "t", "n"])
    return owned.groupBy(key).agg(F.avg(F.col("later") / F.col("all")).alias("monotonicity"))
