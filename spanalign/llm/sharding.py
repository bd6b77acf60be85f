"""Operator 6: reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows get dense numbers 0 .. n-1 in the order (hash bucket, id, size, checksum): row counts of small buckets are summed
to each bucket's first number, in two levels, so no task sorts or scans all rows. A Feistel network over the a x b
grid with a*b >= n (a, b near the root of n) permutes the numbers; a result of n or more walks on along its cycle until
it is below n. Place p goes to shard p mod m and slot p div m: shard sizes differ by one row at most, slots have no
gaps, and anyone who knows n and the seed can compute both, or invert them.

DataFrame functions only. Defined results: null texts have no bytes and checksum 0; a null id is a value like any other;
repeated rows get places of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, utf8_size

P = 2147483647
ROUNDS = 6
WALK = 64


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Three constants below P for each round, from a linear congruence on the seed."""
    out, x = [], seed % P
    for _ in range(ROUNDS):
        three = []
        for _ in range(3):
            x = (x * 48271 + 12345) % P
            three.append(x)
        out.append(tuple(three))
    return out


def grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permuted_once(x: int, n: int, seed: int) -> int:
    """The network for one number, in Python (tests, and callers who compute one row's place)."""
    a, b = grid(n)
    left, right = x % a, x // a
    for j, (k1, k2, k3) in enumerate(round_keys(seed)):
        t = (right % P * k1 + k2) % P
        t = (t * t % P * k3 + right) % P
        left, right = right, (left + t) % (a if j % 2 == 0 else b)
    return a * right + left


def permuted(x: int, n: int, seed: int) -> int:
    while (x := permuted_once(x, n, seed)) >= n:
        pass
    return x


def feistel(x: Column, n: int, seed: int) -> Column:
    """Column: place of row number ``x`` (0 <= x < n). Outside numbers are fewer than the root of n, so a walk of more
    than ``WALK`` steps is practically impossible; it would raise an error rather than give a wrong place."""
    a, b = grid(n)
    keys = F.array(*[F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip(("k1", "k2", "k3", "m"), (*three, a if j % 2 == 0 else b), strict=True)]) for j, three in enumerate(round_keys(seed))])

    def once(v: Column) -> Column:
        def turn(s: Column, k: Column) -> Column:
            t = (s["r"] % P * k["k1"] + k["k2"]) % P
            return F.struct(s["r"].alias("l"), ((s["l"] + (t * t % P * k["k3"] + s["r"]) % P) % k["m"]).alias("r"))

        start = F.struct((v % a).alias("l"), ((v - v % a) / a).cast("long").alias("r"))  # exact below 2**53
        return F.aggregate(keys, start, turn, lambda s: s["r"] * a + s["l"])

    first = once(x)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.when(first < n, first).otherwise(F.when(walked < n, walked).otherwise(F.raise_error(F.lit("the permutation's walk did not end"))))


def numbered(rows: DataFrame, *order: str, bucket_rows: int = 1000) -> tuple[DataFrame, int]:
    """The rows with a dense global ``row_no`` from 0 (by hash bucket, then ``order``), and their number.

    ``rows`` should be slim and cheap to read twice. Bucket counts are summed within runs of 4096 buckets and over
    the runs, so that the only single-task step sees one row for about four million rows."""
    n = rows.count()
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(max(1, n // bucket_rows))))
    counts = rows.groupBy("__bucket").agg(F.count("*").alias("__n")).withColumn("__run", F.expr("__bucket div 4096"))
    runs = counts.groupBy("__run").agg(F.sum("__n").alias("__all"))
    runs = runs.select("__run", (F.sum("__all").over(Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__all")).alias("__before"))
    before = F.sum("__n").over(Window.partitionBy("__run").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    first = counts.withColumn("__in_run", before).join(runs, "__run").select("__bucket", (F.col("__in_run") + F.col("__before")).alias("__first"))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    return rows.withColumn("__place", place).join(first, "__bucket").withColumn("row_no", F.col("__first") + F.col("__place") - 1).drop("__bucket", "__place", "__first"), n


def shards(docs: DataFrame, count: int = 40, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Rows (id, size, text_crc32, row_no, shard, slot)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = stored(docs.select(F.col(id_col).alias("id"), (utf8_size(text_col) + overhead).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    rows, n = numbered(slim, "id", "size", "text_crc32")
    place = feistel(F.col("row_no"), n, seed)
    rows = rows.withColumn("__p", place)
    return rows.select(F.col("id").alias(id_col), "size", "text_crc32", "row_no", (F.col("__p") % count).cast("int").alias("shard"), F.expr(f"__p div {count}").alias("slot"))
