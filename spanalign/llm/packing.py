"""Operator 3: variable-capacity best-fit packing of sequences.

Several sequence lengths are permitted, each with a cost. Items are taken longest first and go to the open bin that
they leave the least room in. If none has room, a bin is opened: every permitted size that holds the item is tried
against the items still waiting (how well would they fill it?), and the size with the least cost per filled unit is
opened. When all items are placed, each bin is downsized to the least permitted length that holds its contents.

Documents longer than the largest length are cut into pieces of that length and a rest. Documents are dealt into groups
of about ``group_rows`` by a hash of id, text and the row's place in its partition (so that repeated rows spread), and
groups are packed on their own: a task holds one group's lengths at a time, whatever the input's size, at the price of
the last bins of each group.

Defined results: equal lengths are taken in order of id, then start; an empty or null text is one piece of length 0; repeated rows are packed as often as they occur; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8_size

LENGTHS = (1024, 2048, 4096, 8192, 16384)


def default_cost(length: int) -> float:
    """Cost of a training sequence: linear work plus a share that grows with the square (attention), in units of 1024."""
    x = length / 1024
    return x + x * x / 64


def pack(lengths: Sequence[int], permitted: Sequence[int], costs: Sequence[float]) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and the final length of each bin. Items must not exceed the largest length."""
    sizes = sorted(zip(permitted, costs, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    waiting: dict[int, int] = {}
    for x in lengths:
        waiting[x] = waiting.get(x, 0) + 1
    kinds = sorted(waiting)
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    bin_of, offset, content = [0] * len(lengths), [0] * len(lengths), []

    def fill(space: int) -> int:
        """What the waiting items would put into a space, longest first."""
        used, at = 0, len(kinds)
        while at and space:
            at = bisect.bisect_right(kinds, space, 0, at)
            if not at:
                break
            at -= 1
            x = kinds[at]
            if x and waiting[x]:
                n = min(waiting[x], space // x)
                used, space = used + n * x, space - n * x
        return used

    for i in order:
        x = lengths[i]
        waiting[x] -= 1
        at = bisect.bisect_left(room, (x, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left = min((cost / max(1, x + fill(size - x)), size) for size, cost in sizes if size >= x)[1]
            b = len(content)
            content.append(0)
        bin_of[i], offset[i] = b, content[b]
        content[b] += x
        bisect.insort(room, (left - x, b))
        while kinds and not waiting[kinds[-1]]:
            kinds.pop()
    permitted = [size for size, _ in sizes]
    return bin_of, offset, [permitted[bisect.bisect_left(permitted, c)] for c in content]


def pack_documents(docs: DataFrame, permitted: Sequence[int] = LENGTHS, costs: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, group_rows: int = 2048) -> DataFrame:
    """Rows (id, piece, start, length, bin_id, bin_length, bin_offset): where each piece of each document goes.

    Lengths are UTF-8 bytes (tokens of a byte-level model), or the column ``length_col`` (null: 0).
    """
    permitted = sorted(permitted)
    costs = [default_cost(x) for x in permitted] if costs is None else list(costs)
    most = permitted[-1]
    size = utf8_size(text_col) if length_col is None else F.greatest(F.coalesce(F.col(length_col), F.lit(0)), F.lit(0)).cast("long")
    groups = max(1, math.ceil(docs.count() / group_rows))
    items = docs.select(F.col(id_col).alias("id"), size.alias("size"), F.pmod(F.xxhash64(id_col, text_col, F.monotonically_increasing_id()), F.lit(groups)).alias("grp"))
    items = items.select("grp", "id", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr(f"(size - 1) div {most}")))).alias("piece"))
    items = items.select("grp", "id", "piece", (F.col("piece") * most).alias("start"), F.least(F.col("size") - F.col("piece") * most, F.lit(most)).alias("length"))

    def pack_group(key, pdf):
        pdf = pdf.sort_values(["id", "start", "length"], kind="stable")
        bins, offsets, lengths = pack(pdf.length.tolist(), permitted, costs)
        return pdf.assign(bin_id=[key[0] * (1 << 24) + b for b in bins], bin_length=[lengths[b] for b in bins], bin_offset=offsets).drop(columns="grp")

    kind = docs.schema[id_col].dataType.simpleString()
    out = items.groupBy("grp").applyInPandas(pack_group, f"id {kind}, piece long, start long, length long, bin_id long, bin_length long, bin_offset long")
    return out.withColumnRenamed("id", id_col)
