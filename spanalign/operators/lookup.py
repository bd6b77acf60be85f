"""Label lookups and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_stem


def resolve(tokens: DataFrame, vocab: DataFrame, global_symbols: list[str]) -> DataFrame:
    """Adds token_id: global symbols literally, others first as language/symbol, then literally; null if unknown.

    tokens: (.., lang, symbol); vocab: (symbol, token_id), one row for each symbol."""
    full = vocab.select(F.col("symbol").alias("__q"), F.col("token_id").alias("__qid"))
    plain = vocab.select(F.col("symbol").alias("__l"), F.col("token_id").alias("__lid"))
    t = tokens.withColumn("__key", F.concat("lang", F.lit("/"), "symbol"))
    t = t.join(full, t["__key"] == full["__q"], "left").join(plain, F.col("symbol") == plain["__l"], "left")
    found = F.when(F.col("symbol").isin(global_symbols), F.col("__lid")).otherwise(F.coalesce("__qid", "__lid"))
    return t.withColumn("token_id", found).drop("__key", "__q", "__qid", "__l", "__lid")


def resolve_any(symbols: DataFrame, vocab: DataFrame, languages: list[str]) -> DataFrame:
    """Adds token_id to (.., symbol): of the symbol under each language in order, then literally; -1 if none is known.

    vocab: (symbol, token_id), one row for each symbol."""
    out = symbols
    names = [*(F.concat(F.lit(f"{x}/"), "symbol") for x in languages), F.col("symbol")]
    for i, name in enumerate(names):
        known = vocab.select(F.col("symbol").alias(f"__s{i}"), F.col("token_id").alias(f"__t{i}"))
        out = out.join(known, name == known[f"__s{i}"], "left").drop(f"__s{i}")
    found = F.coalesce(*[f"__t{i}" for i in range(len(names))], F.lit(-1))
    return out.withColumn("token_id", found).drop(*[f"__t{i}" for i in range(len(names))])


def by_stem(clips: DataFrame, grids: DataFrame) -> DataFrame:
    """Clips (path, ..) with the rows (path, ..) of the file of the same name without folder and suffix, as grid_*; a
    clip without one keeps its row, with nulls."""
    named = grids.select(file_stem(F.col("path")).alias("stem"), *[F.col(c).alias(f"grid_{c}") for c in grids.columns])
    return clips.withColumn("stem", file_stem(F.col("path"))).join(named, "stem", "left")


def first_match(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("__r = 1").drop("__r")


def owner_at(points: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """Adds owner: the first interval (ord) that holds the point at_ms, else the last that starts before it, else 1.

    points: (key, at_ms, ..); intervals: (key, ord, on_ms, off_ms) in order and not overlapping but at edges. One window
    over both sides instead of a range join: the candidates are the last interval that starts at or before the
    point and the one before it, whose closed end may touch the point."""
    ends = Window.partitionBy(key).orderBy("on_ms", "ord")
    marks = intervals.select(key, F.col("on_ms").alias("at_ms"), F.lit(0).alias("__point"), F.struct("ord", "on_ms", "off_ms", F.lag("ord").over(ends).alias("p_ord"), F.lag("off_ms").over(ends).alias("p_off")).alias("__i"))
    rest = [c for c in points.columns if c not in (key, "at_ms")]
    both = points.withColumns({"__point": F.lit(1), "__i": F.lit(None).cast(marks.schema["__i"].dataType)}).unionByName(marks, allowMissingColumns=True)
    seq = Window.partitionBy(key).orderBy("at_ms", "__point", F.col("__i.ord")).rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("__i", F.last("__i", ignorenulls=True).over(seq)).filter("__point = 1")
    owner = F.when(F.col("__i.p_off") >= F.col("at_ms"), F.col("__i.p_ord")).otherwise(F.col("__i.ord"))
    return held.select(key, "at_ms", *rest, F.coalesce(owner, F.lit(1)).alias("owner"))


def latest_before(events: DataFrame, key: str, order: list[str], is_mark, value: str, name: str) -> DataFrame:
    """Adds the value of the latest row at or before each row for which ``is_mark`` holds (backward as-of)."""
    seq = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(name, F.last(F.when(is_mark, F.col(value)), ignorenulls=True).over(seq))


def first_rule(names: DataFrame, name: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds rule: the action of the first glob pattern that fits (null: none). A handful of constant rules."""
    out = F.lit(None).cast("string")
    for pattern, action in reversed(rules):
        regex = "^" + "".join(".*" if c == "*" else "." if c == "?" else f"\\{c}" if not c.isalnum() and c != " " else c for c in pattern) + "$"
        out = F.when(F.col(name).rlike(regex), F.lit(action)).otherwise(out)
    return names.withColumn("rule", out)
