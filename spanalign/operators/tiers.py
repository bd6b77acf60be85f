"""Interval tiers, in whole milliseconds: clamping, runs, gaps, skipped spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(spans: DataFrame, key: str, order: str, onset: str = "on_ms", offset: str = "off_ms") -> DataFrame:
    """Makes spans monotone: each starts no earlier than its predecessor's end and lasts at least 1 ms.

    The recurrence off' = off if off > on' else on' + 1 has a closed form, a running maximum, so one window does it."""
    seq = Window.partitionBy(key).orderBy(order)
    n = F.row_number().over(seq)
    ranked = spans.withColumn("__n", n)
    ends = F.max(F.greatest(F.col(offset), F.col(onset) + 1) - F.col("__n")).over(seq.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__n")
    ranked = ranked.withColumn("__off", ends)
    before = F.lag("__off").over(seq)
    return ranked.withColumns({onset: F.greatest(F.col(onset), F.coalesce(before, F.col(onset))), offset: F.col("__off")}).drop("__n", "__off")


def runs(spans: DataFrame, key: str, order: str, owner: str, onset: str = "on_ms", offset: str = "off_ms") -> DataFrame:
    """Merges consecutive spans of one owner: (key, run, owner, onset, offset, n). The same owner later is a new run."""
    seq = Window.partitionBy(key).orderBy(order)
    starts = F.when(F.lag(owner).over(seq).eqNullSafe(F.col(owner)), 0).otherwise(1)
    numbered = spans.withColumn("__start", starts).withColumn("run", F.sum("__start").over(seq.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "run").agg(F.first(owner).alias(owner), F.min(onset).alias(onset), F.max(offset).alias(offset), F.count("*").alias("n"))


def fill_gaps(spans: DataFrame, key: str, ends: DataFrame, label: str, text: str = "text", onset: str = "on_ms", offset: str = "off_ms") -> DataFrame:
    """(key, onset, offset, text): the spans and an interval of ``label`` for each uncovered stretch of 0 .. end_ms.

    ``ends``: (key, end_ms), one row for each key."""
    spans = spans.select(key, onset, offset, text)
    tails = ends.select(key, F.col("end_ms").alias(onset), F.lit(None).cast("long").alias(offset), F.lit(None).cast("string").alias(text))
    past = Window.partitionBy(key).orderBy(F.col(offset).isNull(), onset, offset).rowsBetween(Window.unboundedPreceding, -1)
    marked = spans.unionByName(tails).withColumn("__prev", F.coalesce(F.max(offset).over(past), F.lit(0).cast("long")))
    gaps = marked.filter(F.col("__prev") < F.col(onset)).select(key, F.col("__prev").alias(onset), F.col(onset).alias(offset), F.lit(label).alias(text))
    return marked.filter(F.col(offset).isNotNull()).select(key, onset, offset, text).unionByName(gaps)


def is_skipped(onset: str = "on_ms", offset: str = "off_ms") -> Column:
    return F.col(onset) >= F.col(offset)


def handle_skips(spans: DataFrame, key: str, how: str, onset: str = "on_ms", offset: str = "off_ms", end: str | None = None) -> DataFrame:
    """omit: zero-width spans go; discard: all spans of a key that has one go; preserve: see ``preserve_skips``."""
    if how == "omit":
        return spans.filter(~is_skipped(onset, offset))
    if how == "discard":
        return spans.join(spans.filter(is_skipped(onset, offset)).select(key).distinct(), key, "left_anti")
    if how == "preserve":
        return preserve_skips(spans, key, "n", "group_id", onset, offset, end)
    raise ValueError(f"skip handling {how!r}")


def preserve_skips(
    spans: DataFrame, key: str, order: str, group: str, onset: str = "on_ms", offset: str = "off_ms", end: str | None = None
) -> DataFrame:
    """Keeps skipped spans as intervals of 1 ms and moves following onsets.

    A run of skipped spans is an island. Its spans before the first place where the group changes (the clip's start is
    one) follow their left neighbour at once; the others end where the next span that is not skipped begins, so each has
    an earliest onset: that place less the number of spans of the run from it on. With these onsets the spans are
    clamped, which moves what has no room. ``end``: a column with the clip's length in ms, where a last run ends (none:
    the last span's own onset)."""
    seq = Window.partitionBy(key).orderBy(order)
    later = seq.rowsBetween(1, Window.unboundedFollowing)
    skipped = is_skipped(onset, offset)
    last = F.last(onset).over(seq.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = spans.withColumns(
        {
            "__skip": skipped,
            "__run": F.sum(F.when(skipped, 0).otherwise(1)).over(seq.rowsBetween(Window.unboundedPreceding, 0)),
            "__edge": skipped & ~F.lag(group).over(seq).eqNullSafe(F.col(group)) | (skipped & F.lag(order).over(seq).isNull()),
            "__next": F.coalesce(F.first(F.when(~skipped, F.col(onset)), ignorenulls=True).over(later), F.col(end) if end else last),
        }
    )
    run = Window.partitionBy(key, "__run").orderBy(order)
    marked = marked.withColumns(
        {
            "__right": F.max("__edge").over(run.rowsBetween(Window.unboundedPreceding, 0)),
            "__left": F.count("*").over(run.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    floor = F.when(F.col("__right"), F.greatest(F.lit(0), F.col("__next") - F.col("__left"))).otherwise(0)
    moved = {onset: F.when(F.col("__skip"), floor).otherwise(F.col(onset)), offset: F.when(F.col("__skip"), floor).otherwise(F.col(offset))}
    kinds = {c: spans.schema[c].dataType for c in (onset, offset)}
    out = clamp(marked.withColumns(moved), key, order, onset, offset)
    return out.withColumns({c: F.col(c).cast(t) for c, t in kinds.items()}).select(spans.columns)
