"""TextGrid files: a tolerant parser to interval rows, and formatting of interval rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ms_as_seconds, quoted

FIELD = re.compile(r"^\s*(name|xmin|xmax|text)\s*=\s*(.*?)\s*$")


def unquote(value: str) -> str:
    if len(value) >= 2 and value[0] == value[-1] == '"':
        value = value[1:-1]
    return value.replace('""', '"').replace('\\"', '"')


NUMBER = re.compile(r"\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)")


def number(text: str) -> float:
    """The number that a text begins with; 0 without one."""
    m = NUMBER.match(text)
    return float(m[1]) if m else 0.0


def parse(content: str) -> list[tuple[str, int, float, float, str]]:
    """(tier, ord, xmin, xmax, text) of all intervals, labels trimmed, in file order."""
    out, tier, now, order = [], "", None, 0
    for line in content.splitlines():
        head = line.strip()
        if head.startswith("item ["):
            tier, now, order = "", None, 0
        elif head.startswith("intervals ["):
            now = {}
        elif m := FIELD.match(line):
            key, value = m[1], m[2]
            if key == "name" and now is None:
                tier = unquote(value)
            elif now is not None:
                now[key] = value
                if key == "text":
                    order += 1
                    out.append((tier, order, number(now.get("xmin", "")), number(now.get("xmax", "")), unquote(value).strip()))
                    now = {}
    return out


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """(path, tier, ord, xmin, xmax, text) of every TextGrid under a folder; files are read by Spark."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.TextGrid").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p, *r) for p, content in zip(pdf.path, pdf.value, strict=True) for r in parse(content)]
            yield pd.DataFrame(rows, columns=["path", "tier", "ord", "xmin", "xmax", "text"])

    return files.mapInPandas(run, "path string, tier string, ord int, xmin double, xmax double, text string")


def register(spark: SparkSession) -> None:
    """The table function ``textgrid_intervals(content, tier)`` for SQL: (ord, xmin, xmax, text) of one tier."""

    class Intervals:
        def eval(self, content: str, tier: str):
            for name, order, xmin, xmax, text in parse(content or ""):
                if name == tier:
                    yield order, xmin, xmax, text

    spark.udtf.register("textgrid_intervals", F.udtf(Intervals, returnType="ord int, xmin double, xmax double, text string"))


def interval_lines(spans: DataFrame, key: str) -> DataFrame:
    """(key, body, n): the interval lines of each key's tier. One key is one file, so its lines meet in one row."""
    line = F.struct("on_ms", F.concat(F.lit("            xmin = "), ms_as_seconds(F.col("on_ms")), F.lit("\n            xmax = "), ms_as_seconds(F.col("off_ms")), F.lit("\n            text = "), quoted(F.col("text")), F.lit("\n")).alias("l"))
    lists = spans.groupBy(key).agg(F.array_sort(F.collect_list(line)).alias("x"), F.count("*").alias("n"))
    body = F.concat_ws("", F.transform("x", lambda v, i: F.concat(F.lit("        intervals ["), (i + 1).cast("string"), F.lit("]:\n"), v["l"])))
    return lists.select(key, body.alias("body"), "n")


def text_grids(tiers: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """(key, content): whole long-format files from gap-filled (key, tier_ord, tier, on_ms, off_ms, text)."""
    tiers = tiers.withColumn("__k", F.struct(key, "tier_ord", "tier"))
    ends = ends.select(F.col(key).alias("__clip"), "end_ms")
    parts = interval_lines(tiers, "__k").join(ends, F.col("__k")[key] == F.col("__clip")).select(F.col("__clip").alias(key), F.col("__k.tier_ord").alias("o"), F.col("__k.tier").alias("tier"), "body", "n", ms_as_seconds(F.col("end_ms")).alias("end"))
    head = F.concat(F.lit("    item ["), F.col("o").cast("string"), F.lit(']:\n        class = "IntervalTier"\n        name = '), quoted(F.col("tier")), F.lit("\n        xmin = 0\n        xmax = "), F.col("end"), F.lit("\n        intervals: size = "), F.col("n").cast("string"), F.lit("\n"), F.col("body"))
    files = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("o", head.alias("t")))).alias("x"), F.max("end").alias("end"), F.count("*").alias("tiers"))
    top = F.concat(F.lit('File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0\nxmax = '), F.col("end"), F.lit("\ntiers? <exists>\nsize = "), F.col("tiers").cast("string"), F.lit("\nitem []:\n"))
    return files.select(key, F.concat(top, F.concat_ws("", F.transform("x", lambda v: v["t"]))).alias("content"))
