"""Operator 4: URL filter, rules first and a learned model for the rest.

Rules name a host (it and its subdomains) and a path prefix; the longest rule that fits decides. Other URLs are judged
by a logistic regression over hashed character n-grams of host and path, trained on the driver from a small labelled
table (given, or the one below). The weights (2**15 floats, 128 KB) go to the executors with the task.

Defined results: a null URL or one without ``://`` has empty host and path, fits no rule and is judged by the model;
repeated rows are judged one by one; an empty table gives no rows; other columns are not read. No shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 15
SIZES = (3, 4, 5)

# A small labelled URL table (1: block). Hosts and paths are invented, under reserved domains.
LABELLED = (
    *((u, 1) for u in """
    http://spam-farm.example.com/en/12
    https://spam-farm.example.org/buy/now
    http://www.spam-links.example.net/en/3.html
    http://cheap-pills.example.com/en/1
    https://www.cheap-pills.example.org/order?id=4
    http://cheap-meds.example.com/pills/buy
    http://online-casino.example.net/en/99
    https://www.casino-bonus.example.com/win/free
    http://casino-slots.example.org/en/77?ref=x
    http://free-money.example.com/win
    https://win-prizes.example.net/claim/free
    http://adult-cams.example.org/xxx/1
    https://xxx-videos.example.com/free
    http://hot-adult.example.net/en/6
    http://replica-watches.example.com/buy/cheap
    https://cheap-watches.example.org/sale
    http://payday-loans.example.net/apply/fast
    https://fast-loans.example.com/cash/now
    http://click-farm.example.com/en/41
    http://www.link-farm.example.org/en/5#top
    http://seo-spam.example.com/backlinks/buy
    https://warez-crack.example.net/download/keygen
    http://torrent-crack.example.org/free/keygen
    http://phish-login.example.com/verify/account
    https://malware-download.example.net/setup.exe
    http://porn-hub.example.org/xxx
    http://bet-win.example.com/casino/en/8
    http://pills-store.example.net/viagra/cheap
    """.split()),
    *((u, 0) for u in """
    http://news.example.com/en/12
    https://www.example.org/fr/34
    https://blog.example.net/en/785?page=2&ref=x
    http://m.library.example.com/de/44.html
    https://museum.example.org/en/101/
    https://docs.example.com/guide/start
    https://www.university.example.net/research/papers/7
    http://blog.theron.example.com/en/960
    https://orchard.example.org/en/apples
    https://www.harbour.example.com/en/tides.html
    https://m.theatre.example.com/en/plays.html
    http://blog.thon.example.net/en/369#top
    https://ingtion.example.org/es/978?page=2&ref=x
    https://garden.example.com/fr/plants/rose
    http://recipes.example.net/es/soup
    https://history.example.org/de/berlin
    https://weather.example.com/en/today?utm_source=feed
    http://www.city.example.net/fr/825?page=2&ref=x
    https://science.example.org/en/physics/12
    http://sports.example.com/en/football/league
    https://music.example.net/es/533/
    http://travel.example.com/de/alps/612?utm_source=feed
    https://books.example.org/en/novel/328/
    http://health.example.net/en/sleep
    https://www.school.example.com/fr/math/414
    https://code.example.org/project/readme
    http://art.example.com/en/gallery/450?page=2&ref=x
    https://movies.example.net/en/review/728
    http://ererth.example.com/de/612
    https://enanted.example.org/en/471
    http://reation.example.net/en/65.html
    https://stinghe.example.com/es/797#top
    """.split()),
)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, lower-cased; path: then up to ``?``, ``#`` or end."""
    cut = F.locate("://", url)
    rest = F.when(cut > 0, F.substring(url, cut + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return ascii_lower(host), path


def split_url(url: str | None) -> tuple[str, str]:
    """The same for one URL in Python, for the labelled table."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    stop = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[stop:].split("?")[0].split("#")[0]
    return rest[:stop].translate({c: c + 32 for c in range(65, 91)}), path


def features(host: str, path: str) -> np.ndarray:
    """Hashed positions of the character n-grams of host and path (marked by part; digits as 0), each once."""
    out = set()
    for mark, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        part = "".join("0" if "0" <= c <= "9" else c for c in part)
        for n in SIZES:
            out.update(zlib.crc32(f"{mark}{part[i : i + n]}".encode()) & ((1 << BITS) - 1) for i in range(len(part) - n + 1))
    return np.fromiter(out, np.int64, len(out))


def train(labelled: Iterable[tuple[str, int]] = LABELLED, rounds: int = 300, rate: float = 2.0, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic regression (full-batch gradient descent; deterministic)."""
    rows = [(features(*split_url(u)), y) for u, y in labelled]
    at = np.concatenate([x for x, _ in rows])
    row = np.repeat(np.arange(len(rows)), [len(x) for x, _ in rows])
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(rows))))
    y = np.array([y for _, y in rows], float)
    w, b = np.zeros(1 << BITS), 0.0
    for _ in range(rounds):
        z = np.bincount(row, w[at], len(rows)) * scale + b
        g = (1 / (1 + np.exp(-z)) - y) / len(rows)
        w -= rate * (np.bincount(at, (g * scale)[row], 1 << BITS) + decay * w)
        b -= rate * g.sum()
    return w, float(b)


def probability(host: str, path: str, weights: np.ndarray, bias: float) -> float:
    x = features(host, path)
    return float(1 / (1 + np.exp(-(weights[x].sum() / np.sqrt(max(1, len(x))) + bias))))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its verdict. Rules: (host/path, verdict)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, prefix = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{prefix}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", labelled: Iterable[tuple[str, int]] = LABELLED) -> DataFrame:
    """Rows (id, host, path, rule, verdict, p_block): every URL's verdict, ``allow`` or ``block``, and the model's probability."""
    weights, bias = train(labelled)
    weights = weights.astype(np.float32)

    @F.pandas_udf("double")
    def model(host, path):
        import pandas as pd

        return pd.Series([probability(h, p, weights, bias) for h, p in zip(host, path, strict=True)], dtype="float64")

    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, says = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select(id_col, "host", "path", rule.alias("rule"), says.alias("says"), model("host", "path").alias("p_block"))
    return rows.select(id_col, "host", "path", "rule", F.coalesce("says", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"), "p_block")


