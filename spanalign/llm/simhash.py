"""Operator 5: near-duplicate detection by SimHash, pigeonhole blocks and a check of the distance.

``simhash_components`` links documents whose 64-bit fingerprints differ in at most two bits. Fingerprints are cut into
four blocks of 16 bits; two differing bits leave at least two blocks equal, so close fingerprints share one of six
pairs of blocks. Distinct fingerprints are joined on these keys and each pair's Hamming distance is verified. Keys that
more than ``few`` fingerprints share are not paired: there, each fingerprint meets the others at the keys that one
flipped bit makes of it (two at distance two meet in the middle); at such a key at most 65 fingerprints can meet, all
within two bits of each other, and the least of them links them. So no link is lost and no group is squared.

``near_duplicate_groups`` serves corpora where "near" is a similarity (share of common word shingles, 0.8 or more). At
that similarity about ten of 64 bits differ, for which blocks of one fingerprint would be too short to select; so the
fingerprint has twelve 64-bit blocks, each the SimHash (bitwise majority) of three shingles, the least under the
block's own hash of the document's shingles. Documents of similarity s share a given block with a chance near s**3, so
at 0.8 they share at least one with a chance of 0.9998. Pairs that share a block are verified by the exact similarity
of the shingle sets.

Defined results: a null text is an empty one; texts without words have fingerprint zero and are linked like any other;
texts of fewer words than a shingle are one shingle; very long texts are hashed whole; a null id never names a
component (unless all ids of the component are null); repeated rows are separate rows of one component; an empty table
gives no rows; only id and text are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, slices, stored
from .components import components

BLOCKS, SAMPLED = 12, 3
#: Residue classes in which shingles are counted.
CLASSES = 1 << 18


def shingle_hashes(text: str | None, words_per_shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle of the text, A-Z lower-cased, words split at ASCII white space."""
    from xxhash import xxh64_intdigest as h64

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= words_per_shingle:
        return np.array([h64(b" ".join(words), seed)], np.uint64)
    join = b" ".join
    return np.fromiter((h64(join(x), seed) for x in zip(*(words[i:] for i in range(words_per_shingle)), strict=False)), np.uint64, len(words) - words_per_shingle + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash: the bits that are set in over half the hashes."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(docs: DataFrame, words_per_shingle: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, fp): fp as a signed long."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = [signed(fingerprint(shingle_hashes(x.as_py(), words_per_shingle))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, fp long")


def block_keys(fp: str, distance: int = 2, blocks: int = 4) -> Column:
    """Array of (combination, key): the agreeing blocks of fingerprints at most ``distance`` bits apart."""
    width = 64 // blocks
    masks = [sum(((1 << width) - 1) << (width * b) for b in kept) for kept in combinations(range(blocks), blocks - distance)]
    return F.array(*[F.struct(F.lit(i).cast("byte").alias("c"), F.col(fp).bitwiseAND(F.lit(signed(m)).cast("long")).alias("key")) for i, m in enumerate(masks)])


def close_pairs(fps: DataFrame, few: int = 128) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) at most two bits apart; enough of them for components."""
    keys = fps.select("fp", F.explode(block_keys("fp")).alias("k")).select("fp", "k.*")
    shared = keys.groupBy("c", "key").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = keys.join(shared, ["c", "key"])
    lists = keyed.filter(F.col("n") <= few).groupBy("c", "key").agg(F.array_sort(F.collect_list("fp")).alias("f"))
    near = F.expr("flatten(transform(f, (x, i) -> transform(filter(slice(f, i + 2, size(f)), y -> bit_count(x ^ y) <= 2), y -> struct(x as a, y as b))))")
    pairs = lists.select(F.explode(near).alias("p")).select("p.*").distinct()
    flips = F.expr(f"transform(array({', '.join(str(signed(1 << b)) + 'L' if b < 63 else '-9223372036854775807L - 1L' for b in range(64))}, 0L), x -> fp ^ x)")
    met = keyed.filter(F.col("n") > few).select("fp").distinct().select("fp", F.explode(flips).alias("at"))
    hubs = met.groupBy("at").agg(F.array_sort(F.collect_set("fp")).alias("f")).filter("size(f) > 1")
    return pairs.unionByName(hubs.select(F.col("f")[0].alias("a"), F.explode(F.expr("slice(f, 2, size(f))")).alias("b"))).distinct()


def simhash_components(docs: DataFrame, words_per_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", few: int = 128) -> DataFrame:
    """Rows (id, fingerprint, component_id) for every input row; fingerprints as 16 hex digits."""
    rows = stored(with_fingerprints(docs, words_per_shingle, id_col, text_col))
    fps = rows.groupBy("fp").agg(F.min("id").alias("first"))
    nodes = components(close_pairs(fps.select("fp"), few))
    grouped = fps.join(nodes, fps.fp == nodes.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    of_fp = grouped.join(least, "component").select("fp", "component_id")
    return rows.join(of_fp, "fp", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: What each block adds to the hashes before they are mixed.
SEEDS = np.array([0x9E3779B97F4A7C15 * (2 * t + 1) & (1 << 64) - 1 for t in range(BLOCKS)], np.uint64)[:, None]


def sampled_blocks(hashes: np.ndarray, most: int = 1 << 14) -> np.ndarray:
    """The twelve blocks: bitwise majority of the three least shingle hashes under each block's own hash."""

    def least(x: np.ndarray) -> np.ndarray:
        return np.partition(x, SAMPLED - 1, axis=1)[:, :SAMPLED] if x.shape[1] > SAMPLED else x

    parts = []
    for at in range(0, len(hashes), most):
        x = (hashes[None, at : at + most] ^ SEEDS) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        parts.append(least(x ^ (x >> np.uint64(29))))
    x = np.sort(least(np.concatenate(parts, 1)), 1)
    a, b, c = (x[:, i % x.shape[1]] for i in range(SAMPLED))
    return ((a & b) | (a & c) | (b & c)).view(np.int64)


def with_shingles(docs: DataFrame, words_per_shingle: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, text_key, blocks, shingles): shingles is the set of 32-bit shingle hashes."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 1024):
            blocks, sets = [], []
            for x in batch.column(2):
                h = shingle_hashes(x.as_py(), words_per_shingle)
                h = np.unique(h) if len(h) else np.zeros(1, np.uint64)
                blocks.append(sampled_blocks(h))
                sets.append(np.unique((h >> np.uint64(32)).astype(np.uint32)).view(np.int32))
            columns = [batch.column(0), batch.column(1), pa.array(blocks, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_key", "blocks", "shingles"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "id long, text_key string, blocks array<long>, shingles array<int>")


def text_key(text_col: str) -> Column:
    """128 bits that tell texts apart."""
    return F.md5(F.coalesce(F.col(text_col), F.lit("")))


def alike(size: str, other: str, similarity: float) -> Column:
    """Whether sets of these sizes can have the similarity at all."""
    return F.least(size, other) >= similarity * F.greatest(size, other) - 1e-6


def star_pairs(members: DataFrame, heads: int, turn: int, similarity: float) -> DataFrame:
    """Pairs (a: member, b: head) of members (c, key, rk, size, group) of shared blocks with heads of other groups.

    A block's heads are the members of the least hash in each of ``heads`` residue classes of that hash, which changes
    with ``turn``. As the hash is the same in all blocks, blocks of the same members have the same heads, so a member
    meets few of them. Only members outside the block's largest group meet them, or, where groups are single
    members, all."""
    h = F.xxhash64("rk", F.lit(turn))
    first = [F.min(F.when(F.pmod(h, F.lit(heads)) == i, F.struct(h.alias("h"), "rk", "size", "group"))) for i in range(heads)]
    led = members.groupBy("c", "key").agg(F.count("*").alias("n"), F.array_compact(F.array(*first)).alias("heads"))
    if turn:
        largest = members.groupBy("c", "key", "group").agg(F.count("*").alias("m")).groupBy("c", "key")
        largest = largest.agg(F.max(F.struct("m", "group")).alias("x")).select("c", "key", F.col("x.group").alias("main"))
        members = members.join(largest, ["c", "key"]).filter("group <> main")
    met = members.join(led.filter("n > 1").select("c", "key", "heads"), ["c", "key"])
    near = F.least("x.size", "size") >= similarity * F.greatest("x.size", "size") - 1e-6
    met = met.select("rk", "size", "group", F.explode("heads").alias("x")).filter((F.col("x.group") != F.col("group")) & near)
    return met.select(F.col("rk").alias("a"), F.col("x.rk").alias("b")).distinct()


def thinned(links: DataFrame) -> DataFrame:
    """Fewer links (a, b) with the same components: where ``a`` has several partners, one link to the first of them and
    links from each partner to the next. Members of one group mostly have the same heads, whose links are then the same."""
    path = F.sort_array(F.collect_set("b"))
    steps = F.expr("transform(b, (y, i) -> struct(if(i = 0, a, b[i - 1]) as a, y as b))")
    return links.groupBy("a").agg(path.alias("b")).select(F.explode(steps).alias("x")).select("x.*").distinct()


def merged(comps: DataFrame | None, links: DataFrame, scratch: list[str]) -> DataFrame:
    """The components (node, component) with the links (a, b) added; the links are lifted to components first, so that
    older links are not gone through again."""
    if comps is None:
        return components(thinned(links), scratch)
    of = lambda side: comps.select(F.col("node").alias(side), F.col("component").alias(f"{side}_top"))
    lifted = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    lifted = lifted.select(F.coalesce("a_top", "a").alias("a"), F.coalesce("b_top", "b").alias("b"))
    more = components(lifted, scratch)
    top = more.select(F.col("node").alias("component"), F.col("component").alias("top"))
    known = comps.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return known.unionByName(more.join(comps.select("node"), "node", "left_anti"))


def mixed_blocks(keyed: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Rows (c, key, n, rk, size, group) of the blocks whose n members are not yet one group."""
    blocks = keyed.withColumn("group", F.col("rk"))
    if comps is not None:
        blocks = keyed.join(comps, keyed.rk == comps.node, "left").select(keyed["*"], F.coalesce("component", "rk").alias("group"))
    spread = blocks.groupBy("c", "key").agg(F.count("*").alias("n"), F.min("group").alias("g1"), F.max("group").alias("g2"))
    return blocks.join(spread.filter("g1 <> g2").select("c", "key", "n"), ["c", "key"])


def all_pairs_of_small_blocks(mixed: DataFrame, few: int, similarity: float) -> DataFrame:
    """Pairs (a, b), a < b, of members of different groups that share a block of at most ``few`` members."""
    lists = mixed.filter(F.col("n") <= few).groupBy("c", "key").agg(F.array_sort(F.collect_list(F.struct("rk", "size", "group"))).alias("f"))
    near = F.expr(
        "flatten(transform(f, (x, i) -> transform(filter(slice(f, i + 2, size(f)), y -> y.group <> x.group "
        f"and least(x.size, y.size) >= {similarity} * greatest(x.size, y.size) - 1e-6), y -> struct(x.rk as a, y.rk as b))))"
    )
    return lists.select(F.explode(near).alias("p")).select("p.*").distinct()


def outsider_links(mixed: DataFrame, sets: DataFrame, few: int, similarity: float) -> DataFrame:
    """Links (a, b) between groups, in blocks of over ``few`` members of which at most ``few`` lie outside the largest group.

    Each of these outsiders is compared with every member of another group: their shingle sets, before any row is made,
    and in the first such block that a pair shares. One link for an outsider and a group is enough."""
    held = mixed.filter(F.col("n") > few).groupBy("c", "key", "group").agg(F.count("*").alias("m"), F.max("n").alias("n")).groupBy("c", "key")
    held = held.agg(F.max(F.struct("m", "group")).alias("x"), F.max("n").alias("n")).filter(F.col("n") - F.col("x.m") <= few)
    here = mixed.select("c", "key", "rk", "group").join(held.select("c", "key", F.col("x.group").alias("main")), ["c", "key"])
    own = here.groupBy("rk").agg(F.collect_set(F.struct("c", "key")).alias("own")).join(sets, "rk")
    here = here.join(own, "rk")
    outsiders = here.filter("group <> main").groupBy("c", "key").agg(F.collect_list(F.struct("rk", "group", "own", "shingles")).alias("o"))
    near = F.expr(
        "filter(o, y -> y.group <> group and (group = main or y.rk < rk) "
        "and not exists(own, m -> m < struct(c, key) and array_contains(y.own, m)) "
        f"and least(size(shingles), size(y.shingles)) >= {similarity} * greatest(size(shingles), size(y.shingles)) - 1e-6 "
        f"and size(array_intersect(shingles, y.shingles)) * {1 + similarity} >= {similarity} * (size(shingles) + size(y.shingles)) - 1e-6)"
    )
    met = here.join(outsiders, ["c", "key"]).select("rk", "group", F.explode(F.transform(near, lambda y: y["rk"])).alias("o"))
    return met.groupBy(F.col("o").alias("a"), "group").agg(F.min("rk").alias("b")).select("a", "b")


def wide_members(mixed: DataFrame, few: int) -> DataFrame:
    """Rows (rk, group) of the blocks that ``outsider_links`` leaves out: over ``few`` members outside the largest group."""
    held = mixed.filter(F.col("n") > few).groupBy("c", "key", "group").agg(F.count("*").alias("m"), F.max("n").alias("n")).groupBy("c", "key")
    held = held.agg(F.max("m").alias("m"), F.max("n").alias("n")).filter(F.col("n") - F.col("m") > few)
    return mixed.join(held.select("c", "key"), ["c", "key"]).select("rk", "group").distinct()


def rarest_shingles(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Rows (shingle, rk, group, size, place): the rarest shingles of each member (rk, group), enough of them that two sets
    of ``similarity`` or more have one in common.

    Any order of the shingles that is the same for all sets will do for that; here they are ordered by the count of
    their residue class (a table of fixed size, so a frequent shingle comes late), then by value."""
    held = members.join(sets, "rk").select("rk", "group", "shingles")

    def count(batches):
        import pyarrow as pa

        n = np.zeros(CLASSES, np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False) & (CLASSES - 1), minlength=CLASSES)
        (some,) = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["k", "n"])

    counted = held.select("shingles").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(CLASSES, np.int64)
    often[counted.k.to_numpy(np.int64)] = counted.n.to_numpy(np.int64)
    sent = members.sparkSession.sparkContext.broadcast(often)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            firsts, sizes, taken = [], [], []
            for x in batch.column(2):
                v = x.values.to_numpy(zero_copy_only=False)
                most = len(v) - int(np.ceil(similarity * len(v) - 1e-6)) + 1
                firsts.append(v[np.lexsort((v, sent.value[v & (CLASSES - 1)]))[:most]])
                sizes.append(len(v))
                taken.append(len(firsts[-1]))
            if not taken:
                continue
            row = np.repeat(np.arange(len(taken)), taken)
            place = np.arange(len(row)) - np.repeat(np.cumsum(taken) - taken, taken)
            columns = [pa.array(np.concatenate(firsts)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(np.asarray(sizes, np.int32)[row]), pa.array(place.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["shingle", "rk", "group", "size", "place"])

    return held.mapInArrow(run, "shingle int, rk long, group long, size int, place int")


def rare_shingle_pairs(rare: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b), a < b, of rows of different groups with a shingle in common; all of ``similarity`` or more are among them.

    rare: as ``rarest_shingles`` gives it. Shingles that only one group holds go first. At each other shingle
    the members outside its largest group are joined with all of other groups; a frequent shingle's rows are rows of a
    join, which can be split. The shingles after a common one bound what two sets share: pairs that stay below
    ``similarity`` even so make no row."""
    held = rare.groupBy("shingle", "group").agg(F.count("*").alias("n")).groupBy("shingle")
    held = held.agg(F.count("*").alias("groups"), F.max(F.struct("n", "group")).alias("m")).filter("groups > 1")
    rows = rare.join(held.select("shingle", F.col("m.group").alias("largest")), "shingle")
    rows = rows.select("shingle", "rk", "group", "size", (F.col("size") - F.col("place")).alias("left"), (F.col("group") == F.col("largest")).alias("main"))
    x, y = rows.filter("not main").alias("x"), rows.alias("y")
    once = (F.col("x.group") != F.col("y.group")) & (F.col("y.main") | (F.col("x.rk") < F.col("y.rk")))
    most = F.least(F.col("x.left"), F.col("y.left")) * (1 + similarity) >= similarity * (F.col("x.size") + F.col("y.size")) - 1e-6
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & once & most & alike("x.size", "y.size", similarity))
    return met.select(F.least("x.rk", "y.rk").alias("a"), F.greatest("x.rk", "y.rk").alias("b")).distinct()


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets (rk, shingles) have the given similarity or more."""
    both = F.size(F.array_intersect("x", "y"))
    sided = pairs.join(sets.select(F.col("rk").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("rk").alias("b"), F.col("shingles").alias("y")), "b")
    return sided.filter(both >= similarity * (F.size("x") + F.size("y") - both)).select("a", "b")


def without(pairs: DataFrame, compared: DataFrame) -> DataFrame:
    """The pairs (a, b) that ``compared`` holds neither way round."""
    done = compared.unionByName(compared.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(done, ["a", "b"], "left_anti")


#: So many 64-bit keys at most are broadcast (32 MB).
MOST_SENT = 4_000_000


def small_side(keys: DataFrame) -> DataFrame:
    """The table of one long column, to be broadcast if its rows are few enough; else a join shuffles both sides."""
    return F.broadcast(keys) if keys.count() <= MOST_SENT else keys


def near_duplicate_groups(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", few: int = 96, heads: int = 4, turns: int = 1) -> DataFrame:
    """Rows (id, text_key, copies, keeper) for each distinct (id, text): how many rows repeat it, and whether it is the one
    of its group that stays (the least id). Groups are the components of links of ``similarity`` or more.

    Equal texts are one class from the start. Classes that share a block are compared, and those of one group no more:
    first every member with its block's head; then all others in blocks of up to ``few`` members; then, in larger
    blocks, the members outside the largest group with ``heads`` other heads, in ``turns`` turns; what is left there as
    ``outsider_links`` and ``rare_shingle_pairs`` say. So no pair that shares a block is lost, and none of these
    numbers changes the result. Tables of the steps between are deleted.
    """
    spark, scratch, fat = docs.sparkSession, [], []
    rows = stored(with_shingles(docs, words_per_shingle, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), fat)
    least = F.struct(F.col("id").isNull().alias("null"), "id")
    size = F.size("shingles").alias("size")
    classes = rows.select("row", "id", "text_key", "blocks", size).groupBy("text_key").agg(F.min("row").alias("rk"), F.min(least).alias("m"), F.first("blocks").alias("blocks"), F.first("size").alias("size"))
    classes = stored(classes.select("rk", "text_key", F.col("m.id").alias("id"), "blocks", "size"), scratch)
    slim = stored(rows.groupBy("id", "text_key").agg(F.count("*").alias("copies")), scratch)
    keyed = classes.select("rk", "size", F.posexplode("blocks").alias("c", "key"))
    shared = keyed.groupBy("c", "key").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = stored(keyed.join(shared.select("c", "key"), ["c", "key"]), scratch)
    needed = keyed.select("rk").distinct()
    needed = small_side(stored(needed, scratch))
    sets = stored(rows.join(needed, rows.row == needed.rk, "left_semi").select(F.col("row").alias("rk"), "shingles"), scratch)
    discard(spark, fat)

    comps = compared = None

    def link(comps: DataFrame | None, links: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        """The components with verified links added, and the blocks that are still of several groups."""
        links = stored(links, scratch)
        if not links.isEmpty():
            comps = stored(merged(comps, links, scratch), scratch)
        return comps, stored(mixed_blocks(keyed, comps), scratch)

    def compare(pairs: DataFrame) -> DataFrame:
        nonlocal compared
        pairs = stored(pairs if compared is None else without(pairs, compared), scratch)
        compared = pairs if compared is None else compared.unionByName(pairs)
        return similar(pairs, sets, similarity)

    every = keyed.withColumns({"n": F.lit(few + 1).cast("long"), "group": F.col("rk")})
    comps, mixed = link(comps, compare(star_pairs(every, 1, 0, similarity)))
    comps, mixed = link(comps, compare(all_pairs_of_small_blocks(mixed, few, similarity)))
    for turn in range(1, turns + 1):
        if mixed.filter(F.col("n") > few).isEmpty():
            break
        comps, mixed = link(comps, compare(star_pairs(mixed.filter(F.col("n") > few), heads, turn, similarity)))
    else:
        comps, mixed = link(comps, outsider_links(mixed, sets, few, similarity))
        wide = stored(wide_members(mixed, few), scratch)
        if not wide.isEmpty():
            rare = stored(rarest_shingles(wide, sets, similarity), scratch)
            comps, _ = link(comps, compare(rare_shingle_pairs(rare, similarity)))

    grouped = classes.select("rk", "text_key", "id", F.col("rk").alias("group"))
    if comps is not None:
        grouped = classes.join(comps, classes.rk == comps.node, "left").select("rk", "text_key", "id", F.coalesce("component", "rk").alias("group"))
    best = grouped.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "text_key")).alias("m"))
    best = best.select(F.col("m.id").alias("best"), F.col("m.text_key").alias("text_key"), F.lit(True).alias("here"))
    stays = F.col("here").isNotNull() & F.col("id").eqNullSafe(F.col("best"))
    out = stored(slim.join(best, "text_key", "left").select("id", "text_key", "copies", stays.alias("keeper")))
    discard(spark, scratch)
    return out


def drop_near_duplicates(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those that are near copies of a row that stays.

    Of rows that repeat an id and a text, the one whose columns come first as JSON stays."""
    groups = near_duplicate_groups(docs, words_per_shingle, similarity, id_col, text_col)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key, own = free_name(docs.columns, "__text_key"), free_name(docs.columns, "__id")
    marked = docs.select(*columns, text_key(text_col).alias(key), F.col(id_col).cast("long").alias(own))
    same = lambda g: F.col(key).eqNullSafe(g.text_key) & F.col(own).eqNullSafe(g.id)
    left = groups.filter("not keeper or copies > 1")
    gone, repeated = (left.filter(x).select("id", "text_key") for x in ("not keeper", "keeper"))
    # rows that a short hash tells apart from all that go or repeat stay where they are; only the others are shuffled
    short = small_side(left.select(F.xxhash64("id", "text_key").alias("h")).distinct())
    touched = F.xxhash64(own, key) == short.h
    rest = marked.join(short, touched, "left_semi").join(gone, same(gone), "left_anti")
    row = F.struct(*columns)
    again = rest.join(repeated, same(repeated), "left_semi").groupBy(key, own).agg(F.min_by(row, F.to_json(row)).alias(key + "_row"))
    kept = marked.join(short, touched, "left_anti").select(*columns)
    kept = kept.unionByName(rest.join(repeated, same(repeated), "left_anti").select(*columns))
    return kept if repeated.isEmpty() else kept.unionByName(again.select(f"{key}_row.*"))
