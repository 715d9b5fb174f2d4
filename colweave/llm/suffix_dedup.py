"""Repeated passages by suffix arrays."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colweave.llm.common import looked_up, map_batches, rows_of, table, type_of
from colweave.storage import at_end, delete, saved, shared_folder

#: Bytes of the strings whose least hash names a window, window starts of a piece at most, bytes of texts that are hashed at once, bytes of pieces that one suffix array takes.
GRAM = 64
CHUNK = 2048
SEGMENT = 1 << 20
SHARD = 1 << 20
#: Window starts of the parts into which pieces of crowded keys are cut, one size after another.
STEPS = (32, 1)


# ---------------------------------------------------------------- which windows can be equal


def grams(raw: np.ndarray) -> np.ndarray:
    """A hash of each GRAM bytes (a power of two), by doubling."""
    h, m = raw.astype(np.uint64), 1
    while m < GRAM:
        h = h[:-m] * np.uint64(0x9E3779B97F4A7C15) + h[m:]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        m *= 2
    return h


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    m = 1
    while 2 * m <= width:
        h = np.minimum(h[:-m], h[m:])
        m *= 2
    return np.minimum(h[: len(h) - (width - m)], h[width - m :]) if m < width else h


def keyed_runs(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, start, n, key, again) of maximal runs of windows of `length` bytes that have one key, the least hash in them, in runs of CHUNK at most. Equal windows have equal keys.

    again: the key stands in the run at several places. Only then can two windows of the run be equal, as the key lies equally far from the start of either.
    """
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    part: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        raw = np.frombuffer(b"".join(p[2] for p in part), np.uint8)
        lengths = np.array([len(p[2]) for p in part])
        begins = np.cumsum(lengths) - lengths
        width = length - GRAM + 1
        hashes = grams(raw)
        key = least(hashes, width)
        edge = np.empty(len(key) + 1, dtype=bool)
        edge[0] = edge[-1] = True
        np.not_equal(key[1:], key[:-1], out=edge[1:-1])
        over = begins + lengths - length + 1  # the first window of each text that would cross its end
        edge[begins] = True
        edge[over] = True
        at = np.flatnonzero(edge)
        n, at = np.diff(at), at[:-1]
        own = np.searchsorted(begins, at, side="right") - 1
        inside = at < over[own]
        at, n, own = at[inside], n[inside], own[inside]
        windows, end = np.lib.stride_tricks.sliding_window_view(hashes, width), at + n - 1
        leftmost = at + (windows[at] == key[at, None]).argmax(axis=1)
        rightmost = end + width - 1 - (windows[end, ::-1] == key[at, None]).argmax(axis=1)
        pieces = -(-n // CHUNK)
        which = np.repeat(np.arange(len(n)), pieces)
        step = (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * CHUNK
        bases = np.array([p[1] for p in part])
        out[0].append(np.array([p[0] for p in part])[own[which]])
        out[1].append(bases[own[which]] + at[which] - begins[own[which]] + step)
        out[2].append(np.minimum(CHUNK, n[which] - step))
        out[3].append(key[at[which]].view(np.int64))
        out[4].append((leftmost != rightmost)[which])
        part.clear()
        size = 0

    for i, text in enumerate(texts):
        for base in range(0, len(text) - length + 1, SEGMENT):
            part.append((i, base, text[base : base + SEGMENT + length - 1]))
            size += len(part[-1][2])
            if size >= SEGMENT:
                flush()
    if part:
        flush()
    return tuple(np.concatenate(c) if c else np.empty(0, np.int64) for c in out)


# ---------------------------------------------------------------- suffix arrays


def sorted_windows(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begins, order): the pieces one behind the other with an end mark each, where each begins, and the starts of all windows by the order of their bytes.

    Two-stage sorting. A suffix is smaller or larger than its successor, the one that starts a byte behind it. Only those smaller than their successors are compared directly, by `length`
    bytes. A suffix larger than its successor is then placed by a scan of the buckets of first bytes in ascending order: each suffix that is met puts the one before it at the front of that one's
    bucket, if it is larger. Scans go a bucket at a time. Of suffixes that aren't windows only those that a window's order hangs on take part.
    """
    lengths = np.array([len(p) for p in pieces])
    begins = np.cumsum(lengths + 1) - lengths - 1
    raw = b"\0".join(pieces) + b"\0"
    text = np.frombuffer(raw, np.uint8)
    first = text.astype(np.int16) + 1  # end marks are 0
    first[begins + lengths] = 0
    turns = np.flatnonzero(first[1:] != first[:-1])  # where a run of one byte ends: the run is as its end
    smaller = np.append(np.repeat(first[turns + 1] > first[turns], np.diff(turns, prepend=-1)), True)
    direct = np.flatnonzero(smaller)
    last = begins + lengths - length  # the last window of each piece
    upto = direct[np.searchsorted(direct, last)]
    taking = np.zeros(len(text) + 1, np.int8)
    taking[begins] += 1
    np.add.at(taking, upto + 1, -1)
    taking = np.cumsum(taking[:-1], dtype=np.int8).astype(bool)
    direct = direct[taking[direct]]
    marks, direct = direct[first[direct] == 0], direct[first[direct] > 0]
    keys = [raw[i : i + length] for i in direct.tolist()]
    direct = np.concatenate([marks, direct[sorted(range(len(keys)), key=keys.__getitem__)]])
    del keys
    in_bucket = np.bincount(first[taking], minlength=257)
    direct_in = np.bincount(first[direct], minlength=257)
    begin = np.cumsum(in_bucket) - in_bucket
    front = begin.copy()  # of what is induced next
    order = np.empty(int(in_bucket.sum()), np.int64)
    c = first[direct]
    order[(begin + in_bucket - direct_in - (np.cumsum(direct_in) - direct_in))[c] + np.arange(len(c))] = direct
    for b in np.flatnonzero(in_bucket):
        seen = begin[b]
        while seen < front[b]:  # runs of byte b, a byte longer each time
            now = order[seen : front[b]] - 1
            seen = front[b]
            now = now[(now >= 0) & (first[now] == b) & taking[now]]
            order[seen : seen + len(now)] = now
            front[b] += len(now)
        now = order[begin[b] : begin[b] + in_bucket[b]] - 1
        now = now[now >= 0]
        now = now[(first[now] > b) & taking[now]]
        c = first[now]
        by = np.argsort(c, kind="stable")
        many = np.bincount(c, minlength=257)
        order[(front - (np.cumsum(many) - many))[c[by]] + np.arange(len(by))] = now[by]
        front += many
    window = np.zeros(len(text) + 1, np.int8)
    window[begins] += 1
    window[last + 1] -= 1
    return text, begins, order[np.cumsum(window[:-1], dtype=np.int8).astype(bool)[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, length: int, stride: int = 40) -> np.ndarray:
    """Bytes that each suffix of the order shares with the one before it, counted up to `length`; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), 1 << 16):
        a, b = order[lo - 1 : lo - 1 + (1 << 16)][: len(order) - lo], order[lo : lo + (1 << 16)]
        alive = np.arange(len(b))
        for at in range(0, length, stride):
            wide = np.lib.stride_tricks.sliding_window_view(text, min(stride, length - at))
            differ = wide[a[alive] + at] != wide[b[alive] + at]
            ends = differ.any(axis=1)
            out[lo + alive] += np.where(ends, differ.argmax(axis=1), differ.shape[1])
            alive = alive[~ends]
            if not len(alive):
                break
    return out


def repeated_runs(pieces: list[bytes], places: list[int], length: int) -> list[list[int]]:
    """For each piece the runs [from, to) of its windows that occur twice among all pieces, flat; all windows of a piece that has several places."""
    text, begins, order = sorted_windows(pieces, length)
    same = common_prefixes(text, order, length) >= length
    repeated = np.zeros(len(text) + 2, np.int8)
    repeated[order[same] + 1] = 1
    repeated[order[np.append(same[1:], False)] + 1] = 1
    for p, b, n in zip(pieces, begins.tolist(), places):
        if n > 1:
            repeated[b + 1 : b + 2 + len(p) - length] = 1
    turns = np.diff(repeated)
    lo, hi = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    own = np.searchsorted(begins, lo, side="right") - 1
    out: list[list[int]] = [[] for _ in pieces]
    for i, a, b in zip(own.tolist(), (lo - begins[own]).tolist(), (hi - begins[own]).tolist()):
        out[i] += (a, b)
    return out


# ---------------------------------------------------------------- jobs


def named(key: int, piece: bytes) -> bytes:
    return hashlib.blake2b(key.to_bytes(8, "little", signed=True) + piece, digest_size=16).digest()


def core_key(core: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(core, digest_size=8).digest(), "little", signed=True)


def parts_of(piece: bytes, key: int, length: int, step: int) -> Iterator[tuple[int, int, int]]:
    """(from, to, key) of runs of a piece's windows, of `step` at most: runs that hold equal windows have equal keys.

    The first place of the piece's key in a window is as far from the window's start in any equal window. Windows are parted by that distance, in steps; all windows of a step share the bytes
    around that place which lie in every window of the step, whose hash is the key.
    """
    n = len(piece) - length + 1
    if step == 1:
        yield from ((i, i + 1, core_key(piece[i : i + length])) for i in range(n))
        return
    there = np.flatnonzero(grams(np.frombuffer(piece, np.uint8)).view(np.int64) == key)
    place = there[np.searchsorted(there, np.arange(n))]
    block = (place - np.arange(n)) // step
    turns = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0)).tolist()
    for lo, hi in zip(turns, [*turns[1:], n]):
        begin = int(place[lo] - block[lo] * step)
        yield lo, hi, core_key(piece[begin : begin - step + 1 + length])


def suffix_sorted(pieces: DataFrame, length: int) -> DataFrame:
    """(d, runs) of the pieces with repeated windows: those of a key lie in one partition, one behind the other, and in one suffix array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int, bytes]] = []
        size = 0

        def found() -> pa.RecordBatch:
            runs = repeated_runs([h[3] for h in held], [h[2] for h in held], length)
            own = [(h[1], r) for h, r in zip(held, runs) if r]
            return pa.record_batch([pa.array([o[0] for o in own], pa.binary()), pa.array([o[1] for o in own], pa.list_(pa.int32()))], ["d", "runs"])

        for batch in batches:
            for row in zip(*(rows_of(batch, c) for c in ("key", "d", "places", "piece"))):
                if size >= SHARD and row[0] != held[-1][0]:
                    yield found()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield found()

    ordered = pieces.select("key", "d", "places", "piece").repartition("key").sortWithinPartitions("key")
    return map_batches(ordered, run, "d binary, runs array<int>")


def repeats(pieces: DataFrame, length: int, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """(d, runs) of pieces (d, key, places, piece), each there once, that hold repeated windows.

    Keys whose pieces exceed a suffix array are crowded: their pieces are cut into parts with keys of their own, equal parts become one, and these are searched in the same way. Parts of
    one window have its digest as key, so equal ones are one row and no key is crowded in the end.
    """
    crowded = None
    if steps:
        crowded = saved(pieces.groupBy("key").agg(F.sum(F.octet_length("piece")).alias("b"), F.count("*").alias("n")).where((F.col("b") > SHARD) & (F.col("n") > 1)).select("key"))
    if crowded is None or crowded.isEmpty():
        return suffix_sorted(pieces, length)
    step = steps[0]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            for d, key, places, piece in zip(*(rows_of(batch, c) for c in ("d", "key", "places", "piece"))):
                rows = []
                for lo, hi, own in parts_of(piece, key, length, step):
                    part = piece[lo : hi - 1 + length]
                    name = named(own, part)
                    rows.append((d, lo, name, own, places, None if name in seen else part))
                    seen.add(name)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))], ["d", "at", "part", "key", "places", "piece"])

    parts = saved(map_batches(pieces.join(crowded, "key", "left_semi").select("d", "key", "places", "piece"), cut, "d binary, at int, part binary, key long, places long, piece binary"))
    once = saved(parts.groupBy(F.col("part").alias("d")).agg(F.first("key").alias("key"), F.sum("places").alias("places"), F.first("piece", True).alias("piece")))
    found = saved(repeats(once, length, steps[1:]).select(F.col("d").alias("part"), "runs"))
    back = looked_up(parts.select("d", "at", "part"), found, "part").select("d", F.transform("runs", lambda r: r + F.col("at")).alias("runs"))
    whole = back.groupBy("d").agg(F.flatten(F.collect_list("runs")).alias("runs"))  # runs of one piece
    return suffix_sorted(pieces.join(crowded, "key", "left_anti"), length).unionByName(whole)


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """df as a table in the shared folder, dealt into as many buckets by the column as shuffles have partitions: joins by it don't shuffle the table again."""
    spark = df.sparkSession
    name, n = f"colweave_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_folder(spark)}/tables/{name}"
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, column).saveAsTable(name)
    at_end(lambda: (spark.sql(f"DROP TABLE IF EXISTS {name}"), delete(spark, path)))
    return spark.table(name)


def repeated_spans(df: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text", kept: bool = False) -> DataFrame:
    """(key, n_bytes, spans, kept_sha256) of every row: the maximal runs of bytes covered by strings of `length` bytes that also start elsewhere in the texts.

    Texts are UTF-8 bytes, null as none; strings never cross texts, may overlap each other, and may repeat within one text. spans are [start, stop) in bytes, in order; kept_sha256 is
    of the other bytes one behind the other, which `kept` adds as a binary column, for a span may end inside a character. length: 2 x GRAM at least.

    Each distinct text is looked at once, in a table bucketed by its digest; copies are covered wholly. A window, the `length` bytes from a place on, is named by the least hash of the GRAM-byte strings
    in it, so equal windows have equal names wherever they are. Neighbouring windows of one name are a piece; 8 bytes for each find the names that occur twice, in several pieces or within one, and only pieces of these are
    gathered by name. Suffix arrays over them, by two-stage sorting, show by adjacent common prefixes which windows repeat. Equal pieces are one row with a count, made before they are
    shuffled; crowded names are split (see repeats()). A task holds a suffix array of about a megabyte of pieces, or a batch of texts. Repeated rows and null keys stay, a row
    each; an empty table gives none. The key may have any type and name; other columns aren't looked at.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length has to be {2 * GRAM} at least")
    t = F.coalesce(F.col(text), F.lit("")).cast("binary")
    c = F.unhex(F.sha2(t, 256))
    rows = saved(df.select(F.col(key).alias("k"), c.alias("c"), F.octet_length(t).cast("long").alias("n_bytes")))
    long = df.select(t.alias("t")).where(F.octet_length("t") >= length)
    classes = bucketed(long.groupBy(F.unhex(F.sha2("t", 256)).alias("c")).agg(F.count("*").alias("copies"), F.first("t").alias("t")), "c")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, start, n, least_hash, again = keyed_runs(rows_of(batch, "t"), length)
            c = batch.column(batch.schema.get_field_index("c")).take(pa.array(own))
            yield pa.record_batch([c, pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(least_hash), pa.array(again.astype(bool))], ["c", "start", "n", "key", "again"])

    names = saved(map_batches(classes.select("c", "t"), name, "c binary, start int, n int, key long, again boolean"))
    twice = saved(names.groupBy("key").agg(F.count("*").alias("n"), F.max("again").alias("again")).where("n > 1 OR again").select("key"))
    lists = looked_up(names, twice, "key").groupBy("c").agg(F.collect_list(F.struct("start", "n", "key")).alias("own"))  # pieces of one text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            own = batch.column(batch.schema.get_field_index("own"))
            start, n, names = (x.to_pylist() for x in own.flatten().flatten())
            of = np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy()))
            texts, digests, pieces = rows_of(batch, "t"), [], []
            for i, s, m, k in zip(of.tolist(), start, n, names):
                piece = texts[i][s : s + m - 1 + length]
                digests.append(named(k, piece))
                pieces.append(None if digests[-1] in seen else piece)
                seen.add(digests[-1])
            c = batch.column(batch.schema.get_field_index("c")).take(pa.array(of))
            yield pa.record_batch([c, pa.array(start, pa.int32()), pa.array(names, pa.int64()), pa.array(digests, pa.binary()), pa.array(pieces, pa.binary())], ["c", "start", "key", "d", "piece"])

    places = saved(map_batches(classes.join(lists, "c").select("c", "t", "own"), cut, "c binary, start int, key long, d binary, piece binary"))
    pieces = saved(places.groupBy("d").agg(F.first("key").alias("key"), F.count("*").alias("places"), F.first("piece", True).alias("piece")))
    found = saved(repeats(pieces, length))
    covered = looked_up(places.select("c", "start", "d"), found, "d").select("c", F.transform("runs", lambda r: r + F.col("start")).alias("runs"))
    covered = covered.groupBy("c").agg(F.flatten(F.collect_list("runs")).alias("runs"))  # runs of one text

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for t, runs in zip(rows_of(batch, "t"), rows_of(batch, "runs")):
                spans: list[list[int]] = []
                for lo, hi in sorted(zip(runs[::2], runs[1::2])):
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi - 1 + length)
                    else:
                        spans.append([lo, hi - 1 + length])
                rest = b"".join(t[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(t)]))
                for column, value in zip(out, ([{"start": a, "stop": b} for a, b in spans], hashlib.sha256(rest).hexdigest(), rest if kept else None)):
                    column.append(value)
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.record_batch([batch.column(0), pa.array(out[0], span), pa.array(out[1], pa.string()), pa.array(out[2], pa.binary())], ["c", "spans", "kept_sha256", "kept"])

    spans_type = "array<struct<start:bigint,stop:bigint>>"
    cleaned = map_batches(classes.where("copies = 1").join(covered, "c").select("c", "t", "runs"), remove, f"c binary, spans {spans_type}, kept_sha256 string, kept binary")
    none, nothing = F.array().cast(spans_type), F.lit(b"")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("t").cast("long").alias("stop")))
    copied = F.col("copies") > 1
    values = classes.join(cleaned, "c", "left").select(
        "c",
        F.when(copied, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(copied, F.sha2(nothing, 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("c")))).alias("kept_sha256"),
        *([F.when(copied, nothing).otherwise(F.coalesce("kept", "t")).alias("kept")] if kept else []),
    )
    in_class = looked_up(rows.where(F.col("n_bytes") >= length), saved(values), "c").drop("c")
    short = rows.where(F.col("n_bytes") < length).select("k", "n_bytes", none.alias("spans"), F.lower(F.hex("c")).alias("kept_sha256"), *([] if not kept else [F.lit(None).cast("binary").alias("kept")]))
    if kept:
        short = df.select(F.col(key).alias("k"), t.alias("kept")).where(F.octet_length("kept") < length).select("k", F.octet_length("kept").cast("long").alias("n_bytes"), none.alias("spans"), F.sha2("kept", 256).alias("kept_sha256"), "kept")
    return in_class.unionByName(short).withColumnRenamed("k", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: all documents, strings of 400 bytes."""
    out = repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
