"""Operator 9: document fingerprints by consistent weighted sampling.

Terms are a text's words (split at ASCII white space), weights their counts. For sample k and term w, hashes give
r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1); with t = floor(ln(weight) / r + b), the term's hash value is
a = c * exp(-r * (t - b + 1)), and the sample is the (w, t) with the least a. Two texts agree in a sample with a chance
equal to the generalised Jaccard similarity of their weights (sum of least weights over sum of greatest), so the share
of equal samples estimates it. A fingerprint is 32 samples, each as a 32-bit hash of (w, t).

DataFrame functions only, with one shuffle of the texts: rows are dealt into buckets of neighbouring ids (quantiles of the id
column, at most ``most_buckets`` numbers on the driver and in the plan: with more rows buckets grow, and are sorted with
spilling, but the result is the same); the first row of a bucket also goes to the bucket before it, as a
ghost, so every row finds its successor's text and fingerprint in its own bucket. Words are counted and samples
taken within the bucket's partition, as hash aggregates of plain numbers.

Defined results: a null text is an empty one; texts without words have a fingerprint of zeros and likeness 1 to each
other; the next of the last document is the first; a null id sorts first; rows of equal id are taken in order of a
hash of their text; repeated rows stay separate rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 32
#: Samples taken in one row of the exploded terms: few enough that the generated method stays small and gets compiled.
TURN = 2
LOW = 0xFFFFFFFF


def bucket_of(x: str, bounds: list[int]) -> Column:
    """Column: how many of the ascending bounds are at most x, by binary search; null: 0."""
    if not bounds:
        return F.lit(0)
    steps = [1 << b for b in reversed(range(len(bounds).bit_length()))]
    known = "array(" + ", ".join(f"{v}L" for v in bounds) + ")"
    return F.expr(f"aggregate(array({', '.join(map(str, steps))}), 0, (at, s) -> if(at + s <= {len(bounds)} and {x} is not null and element_at({known}, least(at + s, {len(bounds)})) <= {x}, at + s, at))")


def dealt(docs: DataFrame, id_col: str, text_col: str, bucket_rows: int, most_buckets: int) -> DataFrame:
    """Rows (bucket, ghost, id, text): buckets of neighbouring ids, each with the next bucket's first row as ghost."""
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    n = ids.count()
    count = max(1, min(most_buckets, math.ceil(n / bucket_rows)))
    cuts = ids.agg(F.percentile_approx("id", [i / count for i in range(1, count)], 10 * count)).first()[0] if count > 1 and n else None
    bounds = sorted(set(cuts or []))
    firsts = ids.select(bucket_of("id", bounds).alias("bucket"), "id").groupBy("bucket").agg(F.min("id").alias("first"), F.max(F.col("id").isNull()).alias("nulls"))
    order = sorted(firsts.collect(), key=lambda r: r.bucket)  # a row for each bucket
    table = [(r.bucket, None if r.nulls else r.first, order[k - 1].bucket) for k, r in enumerate(order)]
    heads = docs.sparkSession.createDataFrame(table, "bucket int, first long, before int")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("bucket", bucket_of("id", bounds))
    rows = rows.join(F.broadcast(heads), "bucket")
    places = F.array_compact(F.array(F.struct("bucket", F.lit(0).alias("ghost")), F.when(F.col("id").eqNullSafe(F.col("first")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("ghost")))))
    # a bucket that can't be null keeps filters out of the plan, so that both readers share one shuffle of the texts
    return rows.select("id", "text", F.explode(places).alias("p")).select(F.coalesce("p.bucket", F.lit(0)).alias("bucket"), "p.ghost", "id", "text")


def with_samples(terms: DataFrame) -> DataFrame:
    """Adds v0 .. for rows (h: term hash, log_weight, g: which samples): packed longs whose high half orders by a and
    whose low half is the hash of (h, t); null where log_weight is. Step by step, so that nothing is computed twice and
    the generated method stays small."""
    kept, each = [F.col(c) for c in ("bucket", "rn", "side", "g")], range(TURN)
    part = lambda x, shift, mask: F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(mask).cast("long")) + 0.5
    scale = 32 * math.log(2)
    k = lambda j: F.col("g") * (2 * TURN) + 2 * j
    rows = terms.select(*kept, "log_weight", *[F.xxhash64("h", k(j) + i).alias(f"{name}{j}") for j in each for i, name in enumerate(("x", "y"))])
    r = lambda j: scale - F.log(part(f"x{j}", 0, 65535) * part(f"x{j}", 16, 65535))
    c = lambda j: F.log(scale - F.log(part(f"x{j}", 32, 65535) * part(f"x{j}", 48, 65535)))
    rows = rows.select(*kept, "log_weight", *[f"y{j}" for j in each], *[r(j).alias(f"r{j}") for j in each], *[c(j).alias(f"c{j}") for j in each], *[(part(f"y{j}", 0, LOW) / float(1 << 32)).alias(f"b{j}") for j in each])
    rows = rows.select(*kept, *[f"{n}{j}" for n in "yrcb" for j in each], *[F.floor(F.col("log_weight") / F.col(f"r{j}") + F.col(f"b{j}")).alias(f"t{j}") for j in each])
    a = lambda j: F.col(f"c{j}") - F.col(f"r{j}") * (F.col(f"t{j}") - F.col(f"b{j}") + 1)
    return rows.select(*kept, *[F.shiftleft(((a(j) + 128) * float(1 << 23)).cast("long"), 32).bitwiseOR(F.xxhash64(f"y{j}", f"t{j}").bitwiseAND(F.lit(LOW).cast("long"))).alias(f"v{j}") for j in each])


def fingerprints(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 512, most_buckets: int = 50_000) -> DataFrame:
    """Rows (id, n_chars, edited_text_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last quarter of code points replaced by the first as many of the next document."""
    in_order = Window.partitionBy("bucket").orderBy("ghost", "id", "tie")
    rows = dealt(docs, id_col, text_col, bucket_rows, most_buckets).withColumn("tie", F.xxhash64("text"))
    rows = rows.select("bucket", "ghost", "id", "text", F.row_number().over(in_order).alias("rn"), F.lead("text").over(in_order).alias("next"))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    kept = F.expr("left(text, cast(n_chars - n_chars div 4 as int))")
    rows = rows.select("bucket", "ghost", "rn", "id", "n_chars", "text", kept.alias("kept"), F.expr("left(coalesce(next, ''), cast(n_chars div 4 as int))").alias("new"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.concat("kept", "new"), 256))

    plain = lambda c: F.translate(c, "\t\n\x0b\f\r", "     ")
    tail = F.length(F.substring_index(plain(F.col("kept")), " ", -1))
    parts = rows.select("bucket", "rn", "text", "kept", "new", "n_chars", tail.alias("tail"))
    common = F.expr("left(kept, cast(length(kept) - tail as int))")
    only_old = F.expr("substr(text, cast(length(kept) - tail + 1 as int))")
    only_new = F.concat(F.expr("right(kept, cast(tail as int))"), F.col("new"))
    piece = lambda c, n0, n1: F.struct(c.alias("part"), F.lit(n0).alias("n0"), F.lit(n1).alias("n1"))
    # the last piece stands for the document itself, so that one without words has a row too
    parts = parts.select("bucket", "rn", F.explode(F.array(piece(common, 1, 1), piece(only_old, 1, 0), piece(only_new, 0, 1), piece(F.lit(""), 0, 0))).alias("p"))
    words = parts.select("bucket", "rn", "p.n0", "p.n1", F.explode(F.split(plain(F.col("p.part")), " ")).alias("w")).filter("w <> '' or n0 + n1 = 0")
    counts = words.select("bucket", "rn", F.xxhash64("w").alias("h"), "n0", "n1").groupBy("bucket", "rn", "h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    side = lambda which, n: F.struct(F.lit(which).alias("side"), F.col(n).alias("n"))
    sides = F.when(F.col("n0") == F.col("n1"), F.array(side(3, "n0"))).otherwise(F.array(side(1, "n0"), side(2, "n1")))
    weighted = counts.select("bucket", "rn", "h", F.explode(sides).alias("s")).filter("s.n > 0 or s.side = 3").select("bucket", "rn", "h", "s.side", F.when(F.col("s.n") > 0, F.log("s.n")).alias("log_weight"))
    turns = F.explode(F.array(*[F.lit(g) for g in range(samples // TURN)])).alias("g")
    values = with_samples(weighted.select("bucket", "rn", "side", "h", "log_weight", turns))
    least = values.groupBy("bucket", "rn", "side", "g").agg(*[F.min(f"v{j}").alias(f"v{j}") for j in range(TURN)])
    either = [F.min(F.when(F.col("side") != other, F.col(f"v{j}"))).alias(f"{name}{j}") for name, other in (("o", 2), ("e", 1)) for j in range(TURN)]
    least = least.groupBy("bucket", "rn", "g").agg(*either)
    low = lambda c: F.coalesce(F.shiftright(F.shiftleft(F.col(c), 32), 32), F.lit(0).cast("long")).cast("int")
    turned = least.select("bucket", "rn", F.struct("g", F.array(*[low(f"o{j}") for j in range(TURN)]).alias("o"), F.array(*[low(f"e{j}") for j in range(TURN)]).alias("e")).alias("x"))
    taken = turned.groupBy("bucket", "rn").agg(F.array_sort(F.collect_list("x")).alias("x")).select("bucket", "rn", F.flatten("x.o").alias("old"), F.flatten("x.e").alias("new"))
    taken = taken.withColumn("next", F.lead("old").over(Window.partitionBy("bucket").orderBy("rn")))
    like = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / float(samples)
    taken = taken.select("bucket", "rn", "old", "new", like("old", "new").alias("near_edited"), like("old", "next").alias("near_next"))

    whole = rows.filter("ghost = 0").select("bucket", "rn", "id", "n_chars", "edited_sha256").join(taken, ["bucket", "rn"])
    text = lambda c: F.lower(F.concat_ws("", F.transform(c, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(LOW).cast("long"))), 8, "0"))))
    return whole.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", text("old").alias("fingerprint"), text("new").alias("edited_fingerprint"), "near_edited", "near_next")
