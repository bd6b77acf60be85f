"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(links: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """Rows (node, component): every node of the links (a, b) with the smallest node that it can reach.

    Each round joins a node's links with its least neighbour; a hub's links are rows, never a list in one task, so a
    large component is spread over tasks, and skewed joins can be split. Each round's links are a written table, and
    the round before is deleted; the last one's path is added to ``scratch``. Nodes are 64-bit integers; links from a node to itself and repeated links change
    nothing; no links, no rows.
    """
    spark, old, kept = links.sparkSession, [], []
    now = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), kept)
    mark = None
    while True:
        old, kept = kept, []
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        turned = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(least, "a").select(F.explode(turned).alias("x")).select("x.*")
        now = stored(small.filter("a <> b").distinct(), kept)
        discard(spark, old)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
    if scratch is not None:
        scratch.extend(kept)
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
