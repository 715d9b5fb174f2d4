"""Benchmark decontamination by an FM-index per shard of training documents."""

from __future__ import annotations

import itertools
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructType

from colweave.llm.common import fresh, map_batches, rows_of, table, type_of, with_columns, words
from colweave.storage import broadcast, delete, saved, shared_folder

WINDOW = 10
#: Words of a shard: an index over so many takes about 60 MB.
SHARD_WORDS = 250_000
#: UTF-8 bytes of benchmark texts searched for at a time; a larger benchmark is searched for in blocks.
BLOCK_BYTES = 4_000_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Phrases:
    """The distinct windows of benchmark items as rows of word numbers, and which items have each: arrays, so that a block of items takes about fifteen times its text."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.ids = sorted({item for item, _ in items if item is not None})
        place = {item: i for i, item in enumerate(self.ids)}
        rows, lengths, owners = [np.zeros((0, window), dtype=np.int32)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for item, text in items:
            w = words((text or "").encode())
            if item is not None and w:
                codes = np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], dtype=np.int32)
                own = np.lib.stride_tricks.sliding_window_view(codes, window) if len(w) >= window else np.r_[np.zeros(window - len(w), np.int32), codes][None, :]  # right-aligned
                rows.append(own)
                lengths.append(np.full(len(own), min(window, len(w))))
                owners.append(np.full(len(own), place[item]))
        codes, owner, n = np.ascontiguousarray(np.concatenate(rows)), np.concatenate(owners), np.concatenate(lengths)
        _, first, phrase = np.unique(codes.view(np.dtype((np.void, 4 * window))).reshape(-1), return_index=True, return_inverse=True)
        self.codes, self.lengths = codes[first], n[first]
        pairs = np.unique(phrase.reshape(-1) * max(1, len(self.ids)) + owner)
        self.owner_at, self.owners = np.searchsorted(pairs, np.arange(len(first) + 1) * max(1, len(self.ids))), (pairs % max(1, len(self.ids))).astype(np.int32)

    def items(self, phrases: np.ndarray) -> set:
        """The ids of items that have any of the phrases."""
        return {self.ids[i] for p in phrases.tolist() for i in self.owners[self.owner_at[p] : self.owner_at[p + 1]].tolist()}


def search(documents: list[list[bytes]], phrases: Phrases) -> list[tuple[list[tuple[int, int]], set]]:
    """For each document of a shard the merged spans of words inside occurrences of phrases, and the items that have these phrases."""
    from colweave.llm.fm_index import FMIndex

    nothing: list[tuple[list[tuple[int, int]], set]] = [([], set()) for _ in documents]
    total = sum(map(len, documents))
    if not total or not len(phrases.codes):
        return nothing
    code = defaultdict(itertools.count(1).__next__)
    sizes = np.array([len(d) for d in documents])
    ends = np.cumsum(sizes + 1) - 1  # places of the separators
    codes = np.zeros(total + len(documents), dtype=np.int64)
    inside = np.ones(len(codes), dtype=bool)
    inside[ends] = False
    codes[inside] = np.fromiter(map(code.__getitem__, itertools.chain.from_iterable(documents)), dtype=np.int64, count=total)
    known = np.array([0, *(code.get(w, -1) for w in phrases.vocabulary)])
    patterns = known[phrases.codes]
    possible = np.flatnonzero((patterns >= 0).all(axis=1))  # all their words occur in the shard
    if not len(possible):
        return nothing
    index = FMIndex(codes)
    low, high = index.search(patterns[possible])
    found = np.flatnonzero(high > low)
    if not len(found):
        return nothing
    counts = (high - low)[found]
    which = np.repeat(possible[found], counts)
    rows = np.repeat(low[found], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    places = index.locate(rows)
    cover = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(cover, places, 1)
    np.add.at(cover, places + phrases.lengths[which], -1)
    hit = np.cumsum(cover[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.r_[False, hit, False]))  # separators aren't hit, so no span leaves its document
    owner = np.searchsorted(ends, edges[::2])
    starts = ends - sizes
    for d, a, b in zip(owner.tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        nothing[d][0].append((a - int(starts[d]), b - int(starts[d])))
    pairs = np.unique(np.searchsorted(ends, places) * len(phrases.codes) + which)
    edges = np.r_[0, np.flatnonzero(np.diff(pairs // len(phrases.codes))) + 1, len(pairs)]
    for a, b in zip(edges[:-1], edges[1:]):
        nothing[int(pairs[a] // len(phrases.codes))][1].update(phrases.items(pairs[a:b] % len(phrases.codes)))
    return nothing


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans sorted and united where they touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shards(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[tuple[pa.RecordBatch, list[str | None], list[list[bytes]]]]:
    """Slices of the batches of about `limit` words, a longer document alone, with their texts and words."""
    for batch in batches:
        texts, at, start, size = rows_of(batch, text), 0, 0, 0
        docs: list[list[bytes]] = []
        for at, t in enumerate(texts):
            w = words((t or "").encode())
            if docs and size + len(w) > limit:
                yield batch.slice(start, at - start), texts[start:at], docs
                docs, start, size = [], at, 0
            docs.append(w)
            size += len(w)
        if docs:
            yield batch.slice(start, len(texts) - start), texts[start:], docs


def benchmark_blocks(benchmark: DataFrame, key: str, text: str, window: int) -> tuple[int, Callable[[int], Phrases]]:
    """The number of blocks of a bounded size that the benchmark is dealt into by hash, and what makes one: neither the driver nor a task holds more than one."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * size // BLOCK_BYTES)) if size > BLOCK_BYTES else 1
    part = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), text), F.lit(blocks))
    return blocks, lambda b: Phrases([tuple(r) for r in benchmark.select(key, text).where(part == b).collect()], window)


def searched(df: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, window: int, shard_words: int, finish: Callable[..., pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """df's rows by finish(batch, texts, words, hits, items) in the given schema; hits: merged spans of words inside occurrences of windows; items: sorted ids of items with occurring windows.

    Blocks of the benchmark are taken one after another; between two of them the rows lie in a table of the shared folder, with what was found so far.
    """
    spark, own = df.sparkSession, len(df.columns)
    kind = benchmark.select(F.col(item)).schema[0].dataType
    blocks, phrases_of = benchmark_blocks(benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")), "item", "text", window)
    hits_, items_ = fresh(df, "hits", "items")
    between = with_columns(df.schema, f"{hits_} array<array<long>>, {items_} array<{kind.simpleString()}>")
    arrow = to_arrow_type(ArrayType(kind))
    out, former = df, None
    for b in range(blocks):
        shared, first, last = broadcast(spark, phrases_of(b)), b == 0, b == blocks - 1  # from at most BLOCK_BYTES of text, or one item

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first, last=last) -> Iterator[pa.RecordBatch]:
            for batch, texts, docs in shards(batches, text, shard_words):
                found = search(docs, shared.value)
                old = [([], [])] * len(docs) if first else zip(batch.column(own).to_pylist(), batch.column(own + 1).to_pylist(), strict=True)
                both = [(merged([*map(tuple, h), *new]), sorted({*i, *ids})) for (h, i), (new, ids) in zip(old, found, strict=True)]
                hits, items, plain = [h for h, _ in both], pa.array([i for _, i in both], arrow), pa.record_batch(batch.columns[:own], batch.schema.names[:own])
                yield finish(plain, texts, docs, hits, items) if last else pa.record_batch([*plain.columns, pa.array(hits, pa.list_(pa.list_(pa.int64()))), items], [*plain.schema.names, hits_, items_])

        step = map_batches(out, run, schema if last else between)
        if not last:
            path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
            out = saved(step, path)
            shared.destroy()
            if former:
                delete(spark, former)
            former = path
    return step


def decontaminate(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(key, n_words, n_hit, items, spans) of every row; keys and item ids are of any type and stay of it.

    Each task deals the documents it reads into shards of about `shard_words` words and builds an FM-index over each
    shard's words: a suffix order, the permuted text as a wavelet matrix, and sampled suffix positions. All windows
    of `window` benchmark words (an item of fewer words is one window) are searched backward through its ranks and
    located by walks to sampled positions; the words they cover are merged into spans. spans: character ranges of the text
    to remove. Nothing is shuffled, and copies cost no more than other rows. A benchmark beyond BLOCK_BYTES is searched for block by
    block, spans of former blocks being carried along in a table. Null and empty texts have no words; null item keys are passed over. Repeated rows give a row each;
    items that repeat an id count as one with the windows of all; an empty table or benchmark finds nothing. Other columns aren't looked at.
    """
    kind = type_of(df, key)
    spans_ = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(batch, texts, docs, hits, items):
        spans = [[{"start": a, "end": b} for a, b in char_spans(t, h)] if h else [] for t, h in zip(texts, hits, strict=True)]
        counts = [pa.array([len(d) for d in docs], pa.int64()), pa.array([sum(b - a for a, b in h) for h in hits], pa.int64())]
        return pa.record_batch([batch.column(0), *counts, items, pa.array(spans, spans_)], ["k", "n_words", "n_hit", "items", "spans"])

    schema = f"k {kind}, n_words long, n_hit long, items array<{type_of(benchmark, item)}>, spans array<struct<start:long,end:long>>"
    return searched(df.select(F.col(key).alias("k"), F.col(text).alias("t")), benchmark, "t", item, item_text, window, shard_words, finish, schema).withColumnRenamed("k", key)


def cleaned(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """df with the spans of decontaminate() cut out of its texts; rows of which no word is left go. Other rows and columns stay as they are, whatever the columns are called; null keys don't matter."""
    names = df.columns
    at = names.index(text)

    def finish(batch, texts, docs, hits, items):
        if not any(hits):
            return batch
        clean = [remove(t, h) if h else t for t, h in zip(texts, hits, strict=True)]
        keep = pa.array([t is not None or not h for t, h in zip(clean, hits, strict=True)])
        columns = [pa.array(clean, batch.column(i).type) if i == at else batch.column(i) for i in range(len(names))]
        return pa.record_batch(columns, names).filter(keep)

    return searched(df, benchmark, text, item, item_text, window, shard_words, finish, df.schema)


def char_spans(text: str, hits: list) -> list[tuple[int, int]]:
    """Character spans of hit words."""
    places = [m.span() for m in WORD.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in hits]


def remove(text: str, hits: list) -> str | None:
    """The text without the hit words, null if no word is left; a line break keeps apart what stood around a span."""
    kept, at = [], 0
    for a, b in char_spans(text, hits):
        kept.append(text[at:a])
        at = b
    clean = "\n".join([*kept, text[at:]])
    return clean if WORD.search(clean) else None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all documents against all benchmark items."""
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH dw AS (SELECT rowid AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS p FROM bw, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 9))) AS i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
occ AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, lens)),
hit AS (SELECT o.r, o.i, o.n, k.item_id FROM occ o JOIN win k ON o.p = k.p AND o.n = k.n),
covered AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS pos FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered c USING (r) LEFT JOIN items t USING (r)
"""
