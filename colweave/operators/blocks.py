"""Full-text search over blocks of texts, each with an inverted index of its own: nothing is shuffled but what is found."""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from colweave.functions.text import tokens
from colweave.storage import broadcast, delete, exists, in_small_groups, map_batches, saved

K1, B = 1.2, 0.75
#: Texts and tokens of a block at most (one longer text is a block by itself).
BLOCK_TEXTS, BLOCK_TOKENS = 256, 1 << 16
#: Weights of queries' tokens that go to all tasks at once; more queries take more passes over the blocks. Products that a task holds at once.
ASKED, HELD = 200_000, 1 << 21
#: Ties: scores that are equal to so many digits.
DIGITS = 9


def idf(n, df):
    return np.log(1 + (n - df + 0.5) / (df + 0.5))


def saturation(tf, dl, avgdl):
    """What a token's frequency in a text counts, below 1."""
    return tf / (tf + K1 * (1 - B + B * dl / avgdl))


def one_row(columns: dict[str, pa.Array | np.ndarray | str]) -> pa.RecordBatch:
    """A batch of a single row whose columns are lists of these values, or texts."""
    made = {}
    for name, values in columns.items():
        if isinstance(values, str):
            made[name] = pa.array([values])
        else:
            values = pa.array(values) if isinstance(values, np.ndarray) else values
            made[name] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.RecordBatch.from_arrays(list(made.values()), list(made))


def block_of(ids: pa.Array, lengths: pa.Array, place: np.ndarray, token: np.ndarray, count: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    """A block from postings (token, place) in order: tokens are places in `words`, which are in order too."""
    have, starts, dfs = np.unique(token, return_index=True, return_counts=True)
    own = np.asarray(lengths.fill_null(0))[place] if len(place) else np.empty(0)
    most = np.maximum.reduceat(count, starts) if len(have) else np.empty(0, np.int64)
    least = np.minimum.reduceat(own, starts) if len(have) else np.empty(0)
    return one_row({"block": uuid.uuid4().hex, "ids": ids, "lengths": lengths, "tokens": words.take(pa.array(have)), "dfs": dfs.astype(np.int32), "most": most.astype(np.int32), "least": least.astype(np.float64), "places": place.astype(np.int32), "counts": count.astype(np.int32)})


def schema_of(ids: str) -> str:
    return f"block string, ids array<{ids}>, lengths array<double>, tokens array<string>, dfs array<int>, most array<int>, least array<double>, places array<int>, counts array<int>"


def build(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of texts. A block holds ids and lengths of its texts; its tokens in order, and for each the number of texts, the largest count, the least length of a text, and the postings: places of texts, counts.

    All of a text's tokens are in one row, so counts need no shuffle. A null text has no length and no tokens, but counts as a text.
    """
    split = docs.select(F.col(f"`{doc}`").alias("id"), tokens(text).alias("ts"))
    kind = split.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            at = 0
            while at < len(sizes):
                total = np.cumsum(sizes[at : at + BLOCK_TEXTS])
                end = at + max(1, int(np.searchsorted(total, BLOCK_TOKENS, side="right")))
                own, n = lists.slice(at, end - at), end - at
                coded = own.flatten().dictionary_encode()
                words = coded.dictionary
                order = np.asarray(pc.sort_indices(words)) if len(words) else np.empty(0, np.int64)
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                codes = rank[np.asarray(coded.indices)] if len(words) else np.empty(0, np.int64)
                key, count = np.unique(codes * n + np.repeat(np.arange(n), sizes[at:end]), return_counts=True)
                lengths = own.value_lengths().cast(pa.float64())
                yield block_of(batch.column(0).slice(at, n), lengths, key % n, key // n, count, words.take(pa.array(order)))
                at = end

    return map_batches(split, run, schema_of(kind))


class Asked:
    """What one pass asks for: for each token the queries that hold it and what it is worth to them at most, and the corpus's mean length."""

    def __init__(self, rows: pa.Table, corpus: tuple[int, float]):
        n, self.avgdl = corpus
        self.queries = rows.column("q").combine_chunks().unique() if not pa.types.is_nested(rows.schema.field("q").type) else None
        if self.queries is None:  # structures: by their text
            texts = [repr(v) for v in rows.column("q").to_pylist()]
            first: dict[str, int] = {}
            at = [first.setdefault(t, len(first)) for t in texts]
            where = np.unique(np.array(at, np.int64), return_index=True)[1]
            self.queries, query = rows.column("q").combine_chunks().take(pa.array(where)), np.array(at, np.int64)
        else:
            query = np.asarray(rows.column("q").combine_chunks().dictionary_encode().indices) if len(rows) else np.empty(0, np.int64)
        coded = rows.column("token").combine_chunks().dictionary_encode()
        self.words, word = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
        order = np.lexsort((query, word))
        self.query = query[order].astype(np.int64)
        self.weight = (np.asarray(rows.column("qtf")) * idf(n, np.asarray(rows.column("df"))))[order]
        self.sizes = np.bincount(word, minlength=len(self.words))
        self.begins = np.cumsum(self.sizes) - self.sizes

    def matched(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of a block's tokens that are asked for, and their places here."""
        found = pc.index_in(words, value_set=self.words)
        at = np.flatnonzero(np.asarray(found.is_valid()))
        return at, np.asarray(found.take(pa.array(at))).astype(np.int64)

    def spread(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of these tokens all its weights: which of the tokens, which weight."""
        return ranges(self.begins[word], self.sizes[word])


def ranges(begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one behind the other: which range, which number."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


def scores(asked: Asked, block: dict, theta: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """(queries, their scores of the block's texts, a row each): of those that with the block's largest contributions could reach theta; None if none can."""
    at, word = asked.matched(block["tokens"])
    if not len(at):
        return None
    n, q = len(block["ids"]), len(asked.queries)
    alive = np.zeros(q, bool)
    if theta is None:
        alive[asked.query[asked.spread(word)[1]]] = True
    else:
        best = saturation(np.asarray(block["most"])[at], np.asarray(block["least"])[at], asked.avgdl)
        which, weight = asked.spread(word)
        reach = np.bincount(asked.query[weight], weights=asked.weight[weight] * best[which], minlength=q)
        alive = (reach > 0) & (reach >= theta - 10.0**-DIGITS)
        if not alive.any():
            return None
    rows = np.flatnonzero(alive)
    row = np.full(q, -1)
    row[rows] = np.arange(len(rows))
    dfs, lengths = np.asarray(block["dfs"]).astype(np.int64), np.asarray(block["lengths"].fill_null(0))
    begins = np.cumsum(dfs) - dfs
    _, posting = ranges(begins[at], dfs[at])
    word = np.repeat(word, dfs[at])
    place = np.asarray(block["places"])[posting].astype(np.int64)
    part = saturation(np.asarray(block["counts"])[posting], lengths[place], asked.avgdl)
    out = np.zeros(len(rows) * n)
    ends = np.cumsum(asked.sizes[word])
    lo = 0
    while lo < len(word):  # as many postings as make HELD products
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + HELD, side="right")))
        which, weight = asked.spread(word[lo:hi])
        where = row[asked.query[weight]]
        keep = where >= 0
        which, weight, where = which[keep] + lo, weight[keep], where[keep]
        out += np.bincount(where * n + place[which], weights=asked.weight[weight] * part[which], minlength=len(out))
        lo = hi
    return rows, out.reshape(len(rows), n)


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() if name == "block" else batch.column(j)[i].values for j, name in enumerate(batch.schema.names)}


def search(blocks: DataFrame, queries: DataFrame, query: str = "query_id", query_text: str = "query_text", k: int | None = None) -> DataFrame:
    """(query, id, score) of every text with a token in common with a query by BM25, or (query, id, score, rank) of each query's k best; of equal ones the smaller id comes first.

    A first pass counts in how many texts the queries' tokens stand. In the second, weights of these tokens go to all tasks, ASKED at a time, and each block is scored by itself. For the k best a
    task keeps the best of the blocks it has read, and passes over queries that with a block's largest contributions could not reach their k-th; a few rows of each task are put
    together in the end. Exact: what a task passes over is below k others.
    """
    kind, arrow_kind = blocks.schema["ids"].dataType.elementType.simpleString(), to_arrow_type(blocks.schema["ids"].dataType.elementType)
    wanted = saved(queries.select(F.col(query).alias("q"), F.explode(tokens(query_text)).alias("token")).groupBy("q", "token").agg(F.count("*").alias("qtf")))
    q_kind = wanted.schema["q"].dataType.simpleString()
    each = blocks.select(F.explode(F.arrays_zip("tokens", "dfs")).alias("t")).select("t.tokens", "t.dfs")
    df = saved(each.join(wanted.select(F.col("token").alias("tokens")).distinct(), "tokens", "left_semi").groupBy(F.col("tokens").alias("token")).agg(F.sum("dfs").alias("df")))
    total = F.aggregate("lengths", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    n, length, known = blocks.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.sum(total), F.sum(F.size(F.filter("lengths", lambda x: x.isNotNull())))).first()
    avgdl = (length or 0.0) / known if known else 1.0
    weighed = wanted.join(df, "token").select("q", "token", "qtf", "df")
    passes = max(1, math.ceil(wanted.count() / ASKED))
    schema = f"q {q_kind}, id {kind}, score double" + (", rounded double" if k else "")
    out = None
    for p in range(passes):
        rows = weighed.where(F.pmod(F.xxhash64("q"), F.lit(passes)) == p).toArrow()  # about ASKED
        shared = broadcast(blocks.sparkSession, Asked(rows, (n, avgdl or 1.0)))

        def every(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            for block in each_block(batches):
                if (found := scores(asked, block)) is not None:
                    row, place = np.nonzero(found[1])
                    yield pa.RecordBatch.from_arrays([asked.queries.take(pa.array(found[0][row])), block["ids"].take(pa.array(place)), pa.array(found[1][row, place])], ["q", "id", "score"])

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            theta = np.full(len(asked.queries), -np.inf)
            kept: dict[int, list[tuple]] = {}
            for block in each_block(batches):
                if (found := scores(asked, block, theta)) is None:
                    continue
                ids = block["ids"].to_pylist()
                for q, own in zip(found[0].tolist(), found[1]):
                    rounded = np.round(own, DIGITS)
                    least = max(theta[q], np.partition(rounded, -k)[-k] if len(own) >= k else -np.inf)
                    new = np.flatnonzero((own > 0) & (rounded >= least)).tolist()
                    if new:
                        kept[q] = sorted([*kept.get(q, ()), *((-rounded[i], ids[i], own[i]) for i in new)], key=lambda x: x[:2])[:k]
                        if len(kept[q]) == k:
                            theta[q] = -kept[q][-1][0]
            rows = [(q, *x) for q, own in kept.items() for x in own]
            yield pa.RecordBatch.from_arrays([asked.queries.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[2] for r in rows], arrow_kind), pa.array([r[3] for r in rows], pa.float64()), pa.array([-r[1] for r in rows], pa.float64())], ["q", "id", "score", "rounded"])

        own = map_batches(blocks, best if k else every, schema)
        out = own if out is None else out.unionAll(own)
    if k:
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("rounded"), "id"))
        return out.withColumn("rank", place).where(F.col("rank") <= k).select(F.col("q").alias(query), "id", "score", "rank")
    return out.select(F.col("q").alias(query), "id", "score")


def without(blocks: DataFrame, dead: DataFrame) -> DataFrame:
    """Blocks (with `segment`) without texts that were deleted (id, upto) after their segment was made; only blocks that hold such are made anew."""
    spots = blocks.select("segment", "block", F.posexplode("ids").alias("place", "id")).join(dead, "id").where("segment <= upto").groupBy("segment", "block").agg(F.array_distinct(F.collect_list("place")).alias("dead"))
    spots = saved(spots)
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_block(batches):
            live = np.ones(len(b["ids"]), bool)
            live[np.asarray(b["dead"])] = False
            moved = np.cumsum(live) - 1
            place = np.asarray(b["places"])
            token = np.repeat(np.arange(len(b["tokens"])), np.asarray(b["dfs"]))
            keep = live[place]
            mask = pa.array(live)
            yield block_of(b["ids"].filter(mask), b["lengths"].filter(mask), moved[place[keep]], token[keep], np.asarray(b["counts"])[keep], b["tokens"])

    columns = [c for c in blocks.columns if c != "segment"]
    touched = map_batches(blocks.join(spots, ["segment", "block"]).select(*columns, "dead"), run, schema_of(kind))
    return blocks.join(spots, ["segment", "block"], "left_anti").select(*columns).unionByName(touched)


class Segments:
    """A stored index that grows: a folder of blocks for each addition, lists of deletions, and merges of all into one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def numbers(self) -> list[int]:
        if not exists(self.spark, f"{self.path}/segments"):
            return []
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/segments")
        found = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
        names = (f.getPath() for f in found)
        return sorted(int(n.getName()) for n in names if exists(self.spark, f"{self.path}/segments/{n.getName()}/_SUCCESS"))

    def add(self, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> None:
        """A new segment; one that was broken off counts for nothing. Ids that are there already are added once more: delete them before."""
        number = max(self.numbers(), default=0) + 1
        in_small_groups(build(docs, doc, text).write.mode("overwrite")).parquet(f"{self.path}/segments/{number}")

    def delete(self, ids: DataFrame, doc: str = "doc_id") -> None:
        """From now on texts of these ids that are in the index are not found, nor counted."""
        if number := max(self.numbers(), default=0):
            ids.select(F.col(f"`{doc}`").alias("id"), F.lit(number).alias("upto")).write.mode("append").parquet(f"{self.path}/deletions")

    def blocks(self) -> DataFrame:
        each = (self.spark.read.parquet(f"{self.path}/segments/{n}").withColumn("segment", F.lit(n)) for n in self.numbers())
        found = functools.reduce(DataFrame.unionByName, each)
        if not exists(self.spark, f"{self.path}/deletions"):
            return found.drop("segment")
        dead = self.spark.read.parquet(f"{self.path}/deletions").groupBy("id").agg(F.max("upto").alias("upto"))
        return without(found, dead)

    def search(self, queries: DataFrame, query: str = "query_id", query_text: str = "query_text", k: int | None = None) -> DataFrame:
        return search(self.blocks(), queries, query, query_text, k)

    def merge(self) -> None:
        """All that is live as one segment. The former ones and the deletions go once it is written; deletions listed before leave the new segment alone, as its number is higher."""
        numbers = self.numbers()
        if not numbers:
            return
        in_small_groups(self.blocks().write.mode("overwrite")).parquet(f"{self.path}/segments/{max(numbers) + 1}")
        for n in numbers:
            delete(self.spark, f"{self.path}/segments/{n}")
        delete(self.spark, f"{self.path}/deletions")
