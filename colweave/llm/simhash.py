"""SimHash near-duplicates by a binary trie joined with itself."""

from __future__ import annotations

import functools
import operator
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colweave.llm.common import LOWER, components, fresh, looked_up, map_batches, rows_of, table, type_of, utf8_of
from colweave.storage import broadcast, delete, saved, shared_folder

#: Fingerprints below a leaf of the distributed trie, at least; there are at most about MAX_LEAVES leaves.
LEAF = 64
MAX_LEAVES = 32768
#: Bits by which too full leaves are split at a time, and fingerprints below a node that are compared at once.
STEP = 6
PAGE = 16
#: Texts that show which shingles are common, about, and shingles kept as such: they shape the order of shingles only, never what is found.
ORDER_TEXTS, ORDER_SHINGLES = 20_000, 100_000
#: Groups of shingles by their low bits: a group without a shared shingle isn't shuffled.
GROUPS = 1 << 24
#: 64-bit words of a set's bitmap. Rounds in which texts are compared with a few others before all that is left is compared, at most, and the share of links among comparisons below which they end; about how many texts share one to be compared with.
BITMAP, ROUNDS, WORTH, SHARING = 8, 6, 0.02, 32
#: How many of its first lists a text carries, by which a pair that shares an earlier list is left out of later ones.
FIRST = 8
ONE, ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


# --- fingerprints


def votes(hashes: np.ndarray) -> np.ndarray:
    """Bits set in over half of the hashes, as a bit array of 64 from the lowest, for hashes of shape (n,)."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts * 2 > len(hashes)


def packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64 bits of the majority of XXH64 (seed 42) of all shingles of `shingle` words; fewer words are one shingle, none give 0."""
    from xxhash import xxh64_intdigest

    w = (text or b"").translate(LOWER).split()
    if not w:
        return 0
    if len(w) < shingle:
        return xxh64_intdigest(b" ".join(w), 42)
    form = b" ".join([b"%b"] * shingle)
    h = [xxh64_intdigest(form % g, 42) for g in zip(*(w[i:] for i in range(shingle)))]
    return int(packed(votes(np.array(h, dtype=np.uint64)))[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


# --- the trie in one task: nodes are ranges of the sorted fingerprints that share a prefix


def node_pairs(left: np.ndarray, right: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with left[i], right[j] (both sorted, uint64) differing in `budget` bits at most.

    Node pairs are traversed together from the two roots, bit by bit: children of equal bits keep the number of differing
    bits, the others add one; a pair beyond the budget is dropped. Pairs of small nodes are compared directly. Pairs wait on a stack
    in blocks, so that memory stays bounded.
    """
    if not len(left) or not len(right):
        return
    one = np.zeros(1, dtype=np.int64)
    stack = [(0, one, one + len(left), one, one + len(right), one)]
    while stack:
        depth, a0, a1, b0, b1, errors = stack.pop()
        small = ((a1 - a0) * (b1 - b0) <= PAGE * PAGE) | (depth == 64)
        if small.any():
            yield from compared(left, right, a0[small], a1[small], b0[small], b1[small], budget)
            a0, a1, b0, b1, errors = (x[~small] for x in (a0, a1, b0, b1, errors))
        if not len(a0):
            continue
        if len(a0) > 4096:
            for at in range(0, len(a0), 4096):
                stack.append((depth, *(x[at : at + 4096] for x in (a0, a1, b0, b1, errors))))
            continue
        am, bm = split(left, a0, a1, depth), split(right, b0, b1, depth)
        ways = [(a0, am, b0, bm, errors), (am, a1, bm, b1, errors), (a0, am, bm, b1, errors + 1), (am, a1, b0, bm, errors + 1)]
        nxt = [np.concatenate(x) for x in zip(*ways)]
        live = (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & (nxt[4] <= budget)
        if live.any():
            stack.append((depth + 1, *(x[live] for x in nxt)))


def split(values: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
    """Where the bit at `depth` turns to 1 in each range of values sharing the bits before."""
    safe = np.minimum(low, len(values) - 1)
    shift = np.uint64(63 - depth)
    bound = ((values[safe] >> shift) | ONE) << shift
    return np.clip(np.searchsorted(values, bound), low, high)


def compared(left, right, a0, a1, b0, b1, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = (a1 - a0) * (b1 - b0)
    for part in np.array_split(np.arange(len(a0)), max(1, int(sizes.sum()) // 2_000_000 + 1)):
        n = sizes[part]
        which = np.repeat(part, n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = (b1 - b0)[which]
        i, j = a0[which] + k // width, b0[which] + k % width
        near = np.bitwise_count(left[i] ^ right[j]) <= budget
        yield i[near], j[near]


# --- the distributed trie


def leaf_bounds(fingerprints: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The leaves of a binary trie over (t, f), distinct: their first values and prefix lengths, in order, for each table t.

    Prefixes are counted by grouped aggregation, and only those holding too many fingerprints are split further, so that
    the driver holds counts of at most MAX_LEAVES x 2^STEP prefixes. Distinct values always part at last.
    """
    n = fingerprints.count()
    limit = max(LEAF, -(-n // MAX_LEAVES))
    done: list[tuple[int, int, int]] = []
    depth, open_ = 0, None
    while True:
        rows, longer = fingerprints, min(bits, depth + STEP if depth else 2 * STEP)
        if open_ is not None:
            wanted = fingerprints.sparkSession.createDataFrame(open_, "t int, p long")
            rows = rows.withColumn("p", F.shiftrightunsigned("f", 64 - depth)).join(F.broadcast(wanted), ["t", "p"], "left_semi")
        counts = [(r.t, r.p, r["count"]) for r in rows.groupBy("t", F.shiftrightunsigned("f", 64 - longer).alias("p") if longer < 64 else F.col("f").alias("p")).count().collect()]
        tree: dict[tuple[int, int, int], int] = {}
        for t, p, c in counts:
            for d in range(depth, longer + 1):
                at = (t, d, (p % (1 << 64)) >> (longer - d))
                tree[at] = tree.get(at, 0) + c
        walk, open_ = [x for x in tree if x[1] == depth], []
        while walk:
            t, d, p = walk.pop()
            if tree[t, d, p] <= limit or d == bits:
                done.append((t, p << (64 - d) if d else 0, d))
            elif d == longer:
                open_.append((t, signed(p)))
            else:
                walk += [x for x in ((t, d + 1, p * 2), (t, d + 1, p * 2 + 1)) if x in tree]
        if not open_:
            break
        depth = longer
    done.sort()
    return np.array([(t, d) for t, _, d in done], dtype=np.int64).reshape(-1, 2), np.array([s for _, s, _ in done], dtype=np.uint64)


def prefix_mask(length: np.ndarray) -> np.ndarray:
    length = length.astype(np.uint64)
    return np.where(length > 0, ALL << np.where(length > 0, np.uint64(64) - length, np.uint64(0)), np.uint64(0))


def leaf_pairs(starts: np.ndarray, lengths: np.ndarray, budget: int) -> list[np.ndarray]:
    """For each leaf the leaves, itself included, that it joins: pairs whose common prefix bits differ within the budget, each pair at one of its two, in turn."""
    masks = prefix_mask(lengths)
    out: list[list[int]] = [[] for _ in starts]
    for i in range(len(starts)):
        near = i + np.flatnonzero(np.bitwise_count((starts[i:] ^ starts[i]) & masks[i:] & masks[i]) <= budget)
        for j in near.tolist():
            out[j if (i + j) % 2 else i].append(i if (i + j) % 2 else j)
    visitors: list[list[int]] = [[] for _ in starts]
    for owner, guests in enumerate(out):
        for g in guests:
            visitors[g].append(owner)
    return [np.array(sorted(v), dtype=np.int64) for v in visitors]


def trie_self_join(fingerprints: DataFrame, budget: int, bits: int = 64) -> DataFrame:
    """Links (t, a, b), a > b, between fingerprints (t int, f long), distinct, that differ in at most `budget` bits within their table t.

    A fingerprint's bits stand at the upper end of f. The trie's leaves (see leaf_bounds) are its distribution: a leaf goes to one task together with
    the fingerprints of leaves it may join, found by walking leaf prefixes and their differing bits; a fingerprint visits
    only leaves whose prefix lies within the budget of its own bits. In a task node pairs are traversed together, and
    links that close a circle within a task are left out, so a cluster of any size gives fewer links than fingerprints in each leaf.
    """
    spark = fingerprints.sparkSession
    keys, starts = leaf_bounds(fingerprints, bits)
    by_table = {int(t): np.flatnonzero(keys[:, 0] == t) for t in np.unique(keys[:, 0])}
    visits: list[np.ndarray] = [np.zeros(0, np.int64)] * len(keys)
    for own in by_table.values():
        for k, v in zip(own, leaf_pairs(starts[own], keys[own, 1], budget), strict=True):
            visits[k] = own[v]
    trie = broadcast(spark, (keys[:, 1], starts, {t: (own, starts[own]) for t, own in by_table.items()}, visits))  # bounded by MAX_LEAVES

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, starts, own, visits = trie.value
        masks = prefix_mask(lengths)
        for batch in batches:
            t, f = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for table_ in np.unique(t):
                f_t = np.sort(f[t == table_])
                ids, first = own[int(table_)]
                home = ids[np.searchsorted(first, f_t, side="right") - 1]
                for at in range(0, len(f_t), 8192):
                    h, x = home[at : at + 8192], f_t[at : at + 8192]
                    n = np.array([len(visits[k]) for k in h], dtype=np.int64)
                    leaf = np.concatenate([visits[k] for k in h]) if len(h) else np.zeros(0, np.int64)
                    x, h = np.repeat(x, n), np.repeat(h, n)
                    near = np.bitwise_count((x ^ starts[leaf]) & masks[leaf]) <= budget
                    yield pa.record_batch([pa.array(np.full(int(near.sum()), table_, np.int32)), pa.array(leaf[near].astype(np.int32)), pa.array((h == leaf)[near]), pa.array(x[near].view(np.int64))], ["t", "leaf", "home", "f"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of one leaf, which batches may part
        for batch in batches:
            rows = np.rec.fromarrays([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3)], names="t,leaf,home,f")
            if not len(rows):
                continue
            if held and held[-1].leaf[-1] != rows.leaf[0]:
                yield from joined(np.concatenate(held))
                held = []
            cut = int(np.searchsorted(rows.leaf, rows.leaf[-1]))
            if cut:
                yield from joined(np.concatenate([*held, rows[:cut]]))
                held = []
            held.append(rows[cut:])
        if held:
            yield from joined(np.concatenate(held))

    def joined(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.r_[0, np.flatnonzero(np.diff(rows["leaf"])) + 1, len(rows)]
        out_t, out_a, out_b = [], [], []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            group = rows[lo:hi]
            f, home = np.ascontiguousarray(group["f"]).view(np.uint64), group["home"]
            mine, guests = np.sort(f[home]), np.sort(f[~home])
            values = np.concatenate([mine, guests])
            links = spanned(values, pairs_of(mine, guests, budget))
            out_t.append(np.full(len(links[0]), group["t"][0], np.int32))
            out_a.append(links[0])
            out_b.append(links[1])
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        yield pa.record_batch([pa.array(np.concatenate(out_t)), pa.array(np.maximum(a, b).view(np.int64)), pa.array(np.minimum(a, b).view(np.int64))], ["t", "a", "b"])

    if not len(keys):
        return spark.createDataFrame([], "t int, a long, b long")
    routed = map_batches(fingerprints.select("t", "f"), route, "t int, leaf int, home boolean, f long")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(keys) // 256)
    return map_batches(routed.repartition(tasks, "leaf").sortWithinPartitions("leaf"), join, "t int, a long, b long")


def pairs_of(mine: np.ndarray, guests: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i, j in node_pairs(mine, mine, budget):
        yield i[i < j], j[i < j]
    for i, j in node_pairs(mine, guests, budget):
        yield i, j + len(mine)


def spanned(values: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links that join values as the pairs do, without circles."""
    label = np.arange(len(values))
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, low, high = i[open_], j[open_], np.minimum(a, b)[open_], np.maximum(a, b)[open_]
            np.minimum.at(label, high, low)
            while not np.array_equal(label, label[label]):
                label = label[label]
    linked = np.flatnonzero(label != np.arange(len(values)))
    return values[linked], values[label[linked]]


# --- the operator


def fingerprints(df: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [signed(fingerprint(t, shingle)) for t in utf8_of(batch, "x")]
            yield pa.record_batch([batch.column(0), pa.array(f, pa.int64())], ["k", "f"])

    return map_batches(df.select(F.col(key).alias("k"), F.col(text).alias("x")), run, f"k {type_of(df, key)}, f long")


def simhash_components(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, budget: int = 2) -> DataFrame:
    """(key, fingerprint, component_id) of every row: rows are linked whose fingerprints differ in at most `budget` bits; component_id is the smallest key reachable.

    Equal fingerprints are grouped first (partial minima on the map side), so the trie holds distinct ones only and a group
    of copies of any size is one of them. Links between fingerprints become components, which are joined back. Null and empty
    texts have fingerprint 0 and are linked with each other like any others. A null key is passed over as a component's name; a component
    of null keys only has none. Keys are of any type that has an order; repeated rows give a row each, an empty table none; other columns aren't looked at.
    """
    rows = saved(fingerprints(df, key, text, shingle))
    distinct = saved(rows.groupBy("f").agg(F.min("k").alias("k")))
    links = trie_self_join(distinct.select(F.lit(0).alias("t"), "f"), budget)
    groups = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    named = distinct.join(groups.select(F.col("id").alias("f"), F.col("component_id").alias("g")), "f", "left").select("f", "k", F.coalesce("g", "f").alias("g"))
    names = named.groupBy("g").agg(F.min("k").alias("component_id"))
    out = saved(named.join(names, "g").select("f", "component_id"))
    return looked_up(rows, out, "f").select(F.col("k").alias(key), F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")


# --- near-duplicates by similarity


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """32-bit hashes of the distinct shingles, sorted; fewer words are one shingle, none give none."""
    from xxhash import xxh32_intdigest

    w = text.translate(LOWER).split()
    form = b" ".join([b"%b"] * shingle)
    grams = {form % g for g in zip(*(w[i:] for i in range(shingle)))} if len(w) >= shingle else {b" ".join(w)} if w else set()
    return np.unique(np.array([xxh32_intdigest(g) for g in grams], dtype=np.uint32)).view(np.int32)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """BITMAP words of 64 bits: each hash turns one bit over. Two sets differ in at least as many elements as their bitmaps in bits."""
    odd = np.bincount(hashes.view(np.uint32) % (64 * BITMAP), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def print_of(hashes: np.ndarray) -> int:
    """64 bits of the majority of a set's hashes, each spread over 64 bits first (the finalizer of SplitMix64); of an empty set 0."""
    if not len(hashes):
        return 0
    x = (hashes.view(np.uint32).astype(np.uint64) + ONE) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return signed(int(packed(votes(x ^ (x >> np.uint64(31))))[0]))


def flags_of(groups: DataFrame, n: int) -> np.ndarray:
    """One bit for each of n groups: whether it is in the column g."""
    flags = np.zeros(n, dtype=bool)
    flags[groups.distinct().toArrow().column("g").to_numpy()] = True
    return np.packbits(flags)


def flagged(flags: np.ndarray, groups: np.ndarray) -> np.ndarray:
    return (flags[groups >> 3] >> (7 - (groups & 7)) & 1).astype(bool)


def rare_first(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of about ORDER_TEXTS of the texts, sorted, and how many of these have each. Any order of shingles gives right results; the rare ones first gives short lists."""
    every = max(1, sets.count() // ORDER_TEXTS)
    counts = sets.where(F.pmod(F.crc32("d"), F.lit(every)) == 0).select(F.explode("s").alias("h")).groupBy("h").count().where("count > 2")
    found = counts.orderBy(F.desc("count"), "h").limit(ORDER_SHINGLES).toArrow()
    h, n = found.column("h").to_numpy(), found.column("count").to_numpy()
    by_hash = np.argsort(h)
    return h[by_hash], n[by_hash]


def prefixes(sets: DataFrame, similarity: float, order: Broadcast, groups: Broadcast | None = None) -> DataFrame:
    """(h, d, n, i): the first shingles of each set of n in one order of all shingles, and their places i in it.

    Of two sets with the similarity, each shares `similarity` of its shingles at least, so the first shingle they share stands among the first
    n - ceil(similarity n) + 1 of both. With `groups`, flags of GROUPS groups of shingles, only shingles of flagged ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = order.value
        for batch in batches:
            lists = batch.column(1)
            n, h = np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy()
            rank = np.zeros(len(h), dtype=np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                rank = np.where(common[at] == h, counts[at], 0)
            owner = np.repeat(np.arange(len(n)), n)
            h = h[np.lexsort((h, rank, owner))]
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            chosen = np.flatnonzero(place <= (n - np.ceil(similarity * n - 1e-9))[owner])
            if groups is not None:
                chosen = chosen[flagged(groups.value, h[chosen] & (GROUPS - 1))]
            yield pa.record_batch([pa.array(h[chosen]), batch.column(0).take(pa.array(owner[chosen])), pa.array(n[owner[chosen]].astype(np.int32)), pa.array(place[chosen].astype(np.int32))], ["h", "d", "n", "i"])

    return map_batches(sets.select("d", "s"), run, "h int, d binary, n int, i int")


def of_texts(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """The sets of some texts (d), and of few others: those whose digests' first bits no text has stay where they are."""
    asked = broadcast(sets.sparkSession, flags_of(texts.select(F.conv(F.hex(F.substring("d", 1, 3)), 16, 10).cast("int").alias("g")), 1 << 24))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = np.array([int.from_bytes(d[:3]) for d in rows_of(batch, "d")], dtype=np.int64)
            yield batch.filter(pa.array(flagged(asked.value, starts)))

    return map_batches(sets, run, sets.schema)


def verified(candidates: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The candidates (src, dst, further columns; a table) whose sets have the similarity. Only their sets are shuffled."""
    sets = of_texts(sets.select("d", "s"), candidates.select(F.explode(F.array("src", "dst")).alias("d")))
    pairs = candidates.join(sets.select(F.col("d").alias("src"), F.col("s").alias("s1")), "src").join(sets.select(F.col("d").alias("dst"), F.col("s").alias("s2")), "dst")
    common = F.size(F.array_intersect("s1", "s2"))
    return pairs.where(common >= F.lit(similarity) * (F.size("s1") + F.size("s2") - common)).select(candidates.columns)


def near_by_trie(sets: DataFrame, similarity: float, budget: int) -> DataFrame:
    """Links (src, dst) between sets whose fingerprints are equal or linked in the trie, of those that have the similarity."""
    prints = saved(sets.groupBy("f").agg(F.min("d").alias("first")))
    close = trie_self_join(prints.select(F.lit(0).alias("t"), "f"), budget)
    name = lambda f, d: prints.select(F.col("f").alias(f), F.col("first").alias(d))
    apart = close.join(name("a", "src"), "a").join(name("b", "dst"), "b").select("src", "dst")
    equal = sets.select("f", F.col("d").alias("src")).join(prints.select("f", F.col("first").alias("dst")), "f").where("src <> dst").select("src", "dst")
    return verified(saved(equal.unionByName(apart)), sets, similarity)


def several_classes(lists: DataFrame) -> DataFrame:
    """The rows (h, c, ...) of lists h with more than one class c."""
    return lists.join(lists.groupBy("h").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("h"), "h", "left_semi")


def with_partners(lists: DataFrame, similarity: float) -> DataFrame:
    """The rows (h, n, ...) of lists h that hold another text whose size n lets the two have the similarity: of all sizes the next ones are nearest, so they tell."""
    by_size, n = Window.partitionBy("h").orderBy("n"), F.col("n")
    near = F.greatest(F.lag("n").over(by_size) >= F.lit(similarity) * n - 1e-9, n >= F.lit(similarity) * F.lead("n").over(by_size) - 1e-9)
    return lists.withColumn("near", near).where("near").drop("near")


def with_largest_class(lists: DataFrame) -> DataFrame:
    """The rows (h, c, ...) of lists h with more than one class c, and each list's largest class as main."""
    dealt = lists.repartition("h").withColumn("count", F.count(F.lit(1)).over(Window.partitionBy("h", "c")))
    each = Window.partitionBy("h")
    dealt = dealt.withColumns({"main": F.max(F.struct("count", "c")).over(each)["c"], "least": F.min("c").over(each), "most": F.max("c").over(each)})
    return dealt.where("least <> most").select(*lists.columns, "main")


def with_first_lists(lists: DataFrame) -> DataFrame:
    """The rows (d, h, i, ...) with `first`, the FIRST lists of the text in the order of shingles, and `before`, how many of these come before the row's own."""
    own = Window.partitionBy("d")
    ranked = lists.withColumn("r", F.row_number().over(own.orderBy("i")))
    first = F.collect_list(F.when(F.col("r") <= FIRST, F.struct("r", "h"))).over(own)
    return ranked.select(*lists.columns, F.transform(F.array_sort(first), lambda x: x["h"]).alias("first"), F.least(F.col("r") - 1, F.lit(FIRST)).alias("before"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, budget: int = 2) -> DataFrame:
    """(digest, key, component_key) of every row: texts whose sets of `shingle`-word shingles have a Jaccard similarity of `similarity` or more are linked.

    First the trie: SimHash fingerprints of the sets that differ in at most `budget` bits are joined, and those pairs verified that it links; the others follow by shingles. Similar sets share a shingle of their prefixes(), so each list of texts with a prefix shingle holds all candidates. Round by round each text is compared with one or two
    others of its lists, drawn anew each time; verified links join classes, and lists of one class are done. When few comparisons find links, in lists of several classes still, each text outside the list's largest class is compared
    with every text of another class whose bitmap doesn't rule it out, in the first list that both are in. Pairs left out lie in one class or can't have the similarity by their lengths, places or bitmaps, so
    nothing is missed, while a group of near copies in one class costs no pairs. Equal texts are one class from the start. Null and empty texts are equal;
    a null key never names a component. Keys are of any type that has an order; repeated rows give a row each, an empty table none; other columns aren't looked at.
    """
    digest = F.substring(F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)), 1, 16)
    source = df.select(F.col(key).alias("k"), digest.alias("d"), F.coalesce(F.col(text), F.lit("")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, shingle) for t in utf8_of(batch, "x")]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int32())), pa.array([bitmap(x) for x in found], pa.list_(pa.int64())), pa.array([print_of(x) for x in found], pa.int64())], ["d", "s", "m", "f"])

    rows = saved(source.select("k", "d"))
    sets = saved(map_batches(source.select("d", "x"), run, "d binary, s array<int>, m array<long>, f long").groupBy("d").agg(*(F.first(x).alias(x) for x in ("s", "m", "f"))))
    spark = df.sparkSession
    by_print = saved(near_by_trie(sets.where(F.size("s") > 0), similarity, budget))
    order = broadcast(spark, rare_first(sets))  # bounded by ORDER_SHINGLES
    shared = prefixes(sets, similarity, order).groupBy("h").count().where("count > 1")
    flags = flags_of(shared.select(F.col("h").bitwiseAND(GROUPS - 1).alias("g")), GROUPS)
    made = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    postings = saved(with_partners(prefixes(sets, similarity, order, broadcast(spark, flags)), similarity), f"{made}-postings")
    # of lists of the very same texts, as the shingles of a passage have, the one that comes first in the order of shingles stays: in it their first shared shingle stands
    same = [F.sum(F.xxhash64("d", F.lit(seed)).cast("decimal(20,0)")).alias(f"same{seed}") for seed in (0, 1)]
    sizes = postings.groupBy("h").agg(F.count(F.lit(1)).alias("count"), F.sum("i").alias("place"), *same).where("count > 1")
    sizes = sizes.groupBy("count", "same0", "same1").agg(F.min_by("h", "place").alias("h")).select("h", F.ceil(F.col("count") / SHARING).cast("int").alias("parts"))
    lists = saved(postings.join(sizes, "h").select("h", "parts", "d", "n", "i"), f"{made}-0")
    delete(spark, f"{made}-postings")
    classes = saved(components(by_print).select(F.col("id").alias("d"), F.col("component_id").alias("g")))
    named = lists.join(classes, "d", "left").select(*lists.columns, F.coalesce("g", "d").alias("c"))

    def may(a: str, b: str) -> Column:
        """Whether two sets can have the similarity by their lengths and by what is left of them from their first shared shingle on."""
        n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
        return (F.least(n, m) >= F.lit(similarity) * F.greatest(n, m) - 1e-9) & (F.least(n - F.col(f"{a}.i"), m - F.col(f"{b}.i")) >= F.lit(similarity / (1 + similarity)) * (n + m) - 1e-9)

    pair = lambda a, b: (F.greatest(a, b).alias("src"), F.least(a, b).alias("dst"))
    empty = sets.where(F.size("s") == 0)
    links = saved(empty.crossJoin(empty.agg(F.min("d").alias("dst"))).select(F.col("d").alias("src"), "dst").unionByName(by_print))  # one empty set, as equal texts are one
    for round_ in range(ROUNDS):
        # a text's partners: the heads, in another order each round, of parts of its lists
        draw = F.xxhash64("d", F.lit(round_))
        dealt = named.withColumn("part", F.pmod(draw, F.col("parts")))
        heads = dealt.groupBy("h", "part").agg(F.min(F.struct(draw.alias("draw"), "d", "n", "i", "c")).alias("two"))
        near = dealt.select("h", "part", F.struct("d", "n", "i", "c").alias("one")).join(heads, ["h", "part"]).where("one.c <> two.c").where(may("one", "two"))
        tried = near.groupBy("one.d", "one.c").agg(F.min("two").alias("e"), F.max("two").alias("f"))
        tried = tried.select("d", "c", F.explode(F.array_distinct(F.array("e", "f"))).alias("e")).select(*pair("d", "e.d"), F.col("c").alias("c1"), F.col("e.c").alias("c2")).dropDuplicates(["src", "dst"])
        tried = saved(tried)
        found = saved(verified(tried, sets, similarity))
        links = links.unionAll(found.select("src", "dst"))
        joined = components(found.select(F.col("c1").alias("src"), F.col("c2").alias("dst"))).select(F.col("id").alias("c"), "component_id")
        merged = named.join(joined, "c", "left").select("h", "parts", "d", "n", "i", F.coalesce("component_id", "c").alias("c"))
        named = saved(several_classes(merged), f"{made}-{round_ + 1}")
        delete(spark, f"{made}-{round_}")
        if found.count() <= WORTH * tried.count():
            break

    # all that is left: texts of different classes in a list, but for two of its largest one
    open_ = saved(with_largest_class(named.select("h", "d", "n", "i", "c")))
    open_ = with_first_lists(open_).join(of_texts(sets.select("d", "m"), open_), "d")
    open_ = saved(open_.select("h", "d", "n", "i", "c", "main", "first", "before", *(F.col("m")[k].alias(f"m{k}") for k in range(BITMAP))))
    one, two = open_.where("c <> main").alias("one"), open_.alias("two")
    once = F.expr("one.c <> two.c AND (two.c = two.main OR one.d > two.d)")
    apart = functools.reduce(operator.add, (F.bit_count(F.col(f"one.m{k}").bitwiseXOR(F.col(f"two.m{k}"))) for k in range(BITMAP)))
    close = apart <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("one.n") + F.col("two.n")) + 1e-9  # elements in one set only
    new = ~F.arrays_overlap(F.slice("one.first", F.lit(1), F.col("one.before")), F.col("two.first"))  # no earlier list, in which they met already
    across = saved(one.join(two, (F.col("one.h") == F.col("two.h")) & once & may("one", "two") & close & new).select(*pair("one.d", "two.d")).distinct())
    groups = components(links.unionAll(verified(across, sets, similarity)))
    named = rows.groupBy("d").agg(F.min("k").alias("k")).join(groups.select(F.col("id").alias("d"), "component_id"), "d", "left").select("d", "k", F.coalesce("component_id", "d").alias("g"))
    named = saved(named)
    names = named.groupBy("g").agg(F.min("k").alias("component_key"))
    by_text = saved(named.join(names, "g").select("d", "component_key"))
    return looked_up(rows.select("d", "k"), by_text, "d").select(F.col("d").alias("digest"), F.col("k").alias(key), "component_key")


def one_of_each_group(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """df with one row of each group of near_duplicates(): that with the smallest key. Rows repeated with key and text stay once; all columns stay."""
    groups = saved(near_duplicates(df, key, text, **options))
    d_, k_ = fresh(df, "digest", "group_key")
    named = lambda g: g.select(F.col("digest").alias(d_), F.col(key).alias(k_)).distinct()
    rows = df.withColumn(d_, F.substring(F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)), 1, 16))
    left = lambda kept, gone: kept.join(gone, (kept[d_] == gone[d_]) & kept[key].eqNullSafe(gone[k_]), "left_anti")
    kept = left(rows, named(groups.where(~F.col(key).eqNullSafe(F.col("component_key")))))
    repeated = not groups.groupBy("digest", key).count().where("count > 1").isEmpty()
    # two texts under one key, both of the group, can't both stay either; they are told apart by the smaller digest
    first = groups.where(F.col(key).eqNullSafe(F.col("component_key"))).groupBy("component_key").agg(F.count_distinct("digest").alias("n"), F.min("digest").alias("first")).where("n > 1")
    if not first.isEmpty():
        kept = left(kept, named(groups.join(first, groups["component_key"].eqNullSafe(first["component_key"]) & groups[key].eqNullSafe(groups["component_key"]) & (groups["digest"] != first["first"])).select(groups["digest"], groups[key])))
    if repeated:
        kept = kept.dropDuplicates([d_, key])
    return kept.drop(d_)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all documents by 3-word shingles, 2 bits."""
    return simhash_components(table(spark, sf_dir, "documents"))
