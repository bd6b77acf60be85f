"""Operator 2: exact top-k inner products over a bit-sliced index.

Each vector component is quantised to an integer. Rows are dealt into blocks by a hash of their id; a block keeps, for
every dimension, one bitmap per bit of the (offset) value. A query multiplies and adds with bitmap arithmetic only:
the bits of its own component say at which weight a dimension's slices enter, a negative component takes the slices'
complement, and carry-save adders reduce all bitmaps of one weight to one sum bitmap and carries. The sum's slices are
then walked from the most significant downward, keeping the rows that are surely in the top k and those still tied;
rows tied at the boundary are resolved by their exact score (equal by then) and smaller id.

Queries are dealt into blocks too, and every query block meets every index block once, so each score is computed once,
no task holds more than one index block and one query block, and only k rows leave a (query, block).

Defined results: vectors that are null or hold null or non-finite components take no part, and neither do rows without
an id; shorter vectors count as padded with zeros; a query is not compared with rows of its own id; of repeated query
ids the smallest vector asks; candidates that repeat an id stay separate rows (of equal
rows, the k that an answer can hold); an empty table gives no rows. Sums are as wide as
the data need; only a quantised component or a block's best score that is no 64-bit integer itself raises an error.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LONG = np.iinfo(np.int64)


def checked(q: np.ndarray) -> np.ndarray:
    """The quantised components; those beyond 64 bits come as the largest or smallest integer."""
    if q.size and (q.max() == LONG.max or q.min() == LONG.min):
        raise ValueError("a quantised component does not fit 64 bits")
    return q


def slices_of(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Bitmaps [dimension, bit, word] of an integer matrix [row, dimension], and the offset taken off all values."""
    rows, dims = values.shape
    offset = int(values.min()) if values.size else 0
    moved = (values.astype(np.uint64) - np.uint64(offset % (1 << 64))).T
    width = max(1, int(moved.max()).bit_length() if moved.size else 1)
    words = -(-rows // 64)
    bits = np.zeros((dims, width, words * 64), np.uint8)
    for b in range(width):
        bits[:, b, :rows] = (moved >> b) & 1
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64).reshape(dims, width, words), offset


class BitSlicedBlock:
    """Rows of one block in order of id, with their slices."""

    def __init__(self, ids: np.ndarray, slices: np.ndarray, offset: int):
        self.ids, self.offset = ids, offset
        self.dims, self.width, self.words = slices.shape
        self.all = np.concatenate([slices, ~slices]).reshape(2 * self.dims * self.width, self.words)
        valid = np.zeros(self.words * 64, np.uint8)
        valid[: len(ids)] = 1
        self.valid = np.packbits(valid, bitorder="little").view(np.uint64)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Sum slices, least weight first, and the constant that turns their number into the inner product."""
        if len(query) < self.dims:
            query = np.concatenate([query, np.zeros(self.dims - len(query), np.int64)])
        query = query[: self.dims]
        size, sign = np.abs(query).astype(np.uint64), query < 0
        base = (np.arange(self.dims) + np.where(sign, self.dims, 0)) * self.width
        at: dict[int, list[np.ndarray]] = {}
        for i in range(int(size.max()).bit_length() if self.dims else 0):
            first = base[(size >> i) & 1 == 1]
            if len(first):
                for j in range(self.width):
                    at.setdefault(i + j, []).append(first + j)
        sums: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        weight, last = 0, max(at, default=-1)
        while weight <= last or carried:
            level = [self.all[np.concatenate(at[weight])]] if weight in at else []
            level += carried
            carried = []
            if not level:
                sums.append(np.zeros(self.words, np.uint64))
                weight += 1
                continue
            now = np.concatenate(level)
            while len(now) > 2:
                k = len(now) // 3
                a, b, c = now[:k], now[k : 2 * k], now[2 * k : 3 * k]
                half = a ^ b
                carried.append((a & b) | (c & half))
                now = np.concatenate([half ^ c, now[3 * k :]])
            if len(now) == 2:
                carried.append((now[0] & now[1])[None])
                now = (now[0] ^ now[1])[None]
            sums.append(now[0])
            weight += 1
        const = self.offset * sum(query.tolist()) - ((1 << self.width) - 1) * sum(size[sign].tolist())
        return sums, const

    def top(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (id, score) of the block, ties to smaller id, without rows of the query's own id."""
        sums, const = self.scores(query)
        open_rows = self.valid.copy()
        lo, hi = np.searchsorted(self.ids, [query_id, query_id + 1])
        for own in range(lo, hi):
            open_rows[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
        sure = np.zeros_like(open_rows)
        n_open, n_sure = int(np.bitwise_count(open_rows).sum()), 0
        for s in reversed(sums):
            if n_sure + n_open <= k:
                break
            ones = open_rows & s
            n = int(np.bitwise_count(ones).sum())
            if n_sure + n > k:
                open_rows, n_open = ones, n
            else:
                sure, n_sure = sure | ones, n_sure + n
                open_rows, n_open = open_rows & ~s, n_open - n
                if n_sure == k:
                    break
        places = [*self.places(sure, k), *self.places(open_rows, k - n_sure)]
        return [(int(self.ids[p]), const + sum(((int(s[p // 64]) >> (p % 64)) & 1) << w for w, s in enumerate(sums))) for p in places]

    @staticmethod
    def places(rows: np.ndarray, most: int) -> list[int]:
        """The first rows of a bitmap; its rows are in order of id."""
        out: list[int] = []
        for w in np.flatnonzero(rows):
            if len(out) >= most:
                break
            word = int(rows[w])
            out += [int(w) * 64 + b for b in range(64) if word >> b & 1]
        return out[:most]


def quantised(vector: str, factor: float = 256.0) -> Column:
    """Column: floor(factor * x) of each component as long; null where the vector takes no part."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.floor(v.cast("double") * factor).cast("long")))


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = 256.0, index_rows: int = 8192, query_rows: int = 8192) -> DataFrame:
    """Rows (query_id, rank, id, score): for each row that ``is_query`` holds for, its ``k`` largest inner products."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(vector_col, factor).alias("q"), is_query.alias("asks")).filter("q is not null and id is not null")
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    index_blocks, query_blocks = max(1, math.ceil(n / index_rows)), max(1, math.ceil(asking / query_rows))

    def pack(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("id", kind="stable")
        dims = max(map(len, pdf.q), default=0)
        m = np.zeros((len(pdf), dims), np.int64)
        for i, q in enumerate(pdf.q):
            m[i, : len(q)] = q
        slices, offset = slices_of(checked(m))
        ids = pdf.id.to_numpy(np.int64)
        return pd.DataFrame({"block": [key[0]], "ids": [ids.tobytes()], "slices": [slices.tobytes()], "dims": [dims], "width": [slices.shape[1]], "offset": [offset]})

    # of repeated rows k are enough for any answer; counted before the shuffle, so that they never meet in one block
    held = rows.groupBy("id", "q").agg(F.count("*").alias("n")).select("id", "q", F.explode(F.array_repeat(F.lit(0), F.least("n", F.lit(k)).cast("int"))).alias("one"))
    index = held.select(F.pmod(F.xxhash64("id", "q"), F.lit(index_blocks)).cast("int").alias("block"), "id", "q").groupBy("block").applyInPandas(pack, "block int, ids binary, slices binary, dims int, width int, offset long")
    index = stored(index).select("*", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("asked"))
    queries = rows.filter("asks").groupBy("id").agg(F.min("q").alias("q"))
    queries = queries.select("id", "q", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(index_blocks - 1))).alias("block"))

    def search(_, blocks, asked):
        import pandas as pd

        out = []
        for r in blocks.itertuples():
            ids = np.frombuffer(r.ids, np.int64)
            block = BitSlicedBlock(ids, np.frombuffer(r.slices, np.uint64).reshape(r.dims, r.width, -(-len(ids) // 64)), r.offset)
            for query_id, q in zip(asked.id, asked.q, strict=True):
                best = block.top(query_id, checked(np.asarray(q, np.int64)), k)
                if any(not LONG.min <= s <= LONG.max for _, s in best):
                    raise ValueError(f"a score of {query_id} does not fit 64 bits")
                out += [(query_id, i, s) for i, s in best]
        return pd.DataFrame(out, columns=["query_id", "id", "score"]).astype("int64")

    found = index.groupBy("block", "asked").cogroup(queries.groupBy("block", "asked")).applyInPandas(search, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
