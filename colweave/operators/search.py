"""Ranked full-text search: BM25 over postings, and the searches built on it."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colweave.functions.text import tokens
from colweave.operators import blocks
from colweave.storage import saved

K1, B = 1.2, 0.75
#: Folders that a stored index's tokens are dealt into by hash; a search reads those of its tokens.
PARTS = 64
#: Letters of a dictionary word by which texts that may hold it are found.
GRAM = 3


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a token's frequency in a document counts, below 1."""
    return tf / (tf + K1 * (1 - B + B * dl / avgdl))


def asked_tokens(queries: DataFrame, query: str, query_text: str) -> DataFrame:
    return queries.select(F.col(query).alias("q"), F.explode(tokens(query_text)).alias("token")).groupBy("q", "token").agg(F.count("*").alias("qtf"))


def bm25(docs: DataFrame, queries: DataFrame, doc: str = "doc_id", text: str = "text", query: str = "query_id", query_text: str = "query_text") -> DataFrame:
    """(query, doc, score) of every pair with a token in common.

    score = sum over the query's tokens of ln(1 + (N - df + 0.5) / (df + 0.5)) tf / (tf + k1 (1 - b + b dl / avgdl)); lengths are not
    quantised. Texts are inverted block by block and scored where they lie (see blocks.search()): neither postings nor pairs are shuffled.
    """
    return blocks.search(saved(blocks.build(docs, doc, text), long_rows=True), queries, query, query_text).withColumnRenamed("id", doc)


def top_k(hits: DataFrame, k: int, by: str, order: str, score: str = "score") -> DataFrame:
    """The k best of each group with their rank; ties go to the smaller `order`."""
    w = Window.partitionBy(by).orderBy(F.desc(score), order)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int, doc: str = "doc_id", text: str = "text", query: str = "query_id", query_text: str = "query_text") -> DataFrame:
    """(query, doc, score, rank): the k best documents of each query by bm25(); of scores equal to nine digits the smaller document's comes first. Exact, without scoring blocks that can't hold one of them."""
    return blocks.search(saved(blocks.build(docs, doc, text), long_rows=True), queries, query, query_text, k).withColumnRenamed("id", doc)


@dataclasses.dataclass
class Index:
    """A full-text index over several fields: postings (field, token, node, label, dl, tf) and for each field its entries and their mean length."""

    postings: DataFrame
    fields: DataFrame

    @staticmethod
    def build(entries: DataFrame) -> Index:
        """From entries (field, node, label, text); texts without tokens count as entries of length 0."""
        split = entries.where("text IS NOT NULL").select("field", "node", "label", tokens("text").alias("ts")).withColumn("dl", F.size("ts").cast("double"))
        fields = split.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        postings = split.select("field", "node", "label", "dl", F.explode("ts").alias("token")).groupBy("field", "token", "node", "label", "dl").agg(F.count("*").cast("double").alias("tf"))
        return Index(postings, fields)

    def save(self, path: str) -> None:
        """Postings by folders of tokens, sorted by token within files, so that a search reads few row groups of few folders."""
        part = F.pmod(F.xxhash64("token"), F.lit(PARTS)).cast("int")
        self.postings.withColumn("part", part).repartition("part", F.pmod(F.xxhash64("node"), F.lit(8))).sortWithinPartitions("part", "token").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
        self.fields.write.mode("overwrite").parquet(f"{path}/fields")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/fields"))

    def search(self, queries: DataFrame, query: str = "query_id", query_text: str = "query_text") -> DataFrame:
        """(query, node, label, score) of every node with a token in common, its score summed over the fields that hit."""
        asked = asked_tokens(queries, query, query_text)
        keys = ["token"]
        if "part" in self.postings.columns:
            asked, keys = asked.withColumn("part", F.pmod(F.xxhash64("token"), F.lit(PARTS)).cast("int")), ["part", "token"]
        found = self.postings.join(asked.select(*keys).distinct(), keys, "left_semi")
        df = found.groupBy("field", "token").agg(F.count("*").alias("df"))
        weights = asked.join(df, "token").join(F.broadcast(self.fields), "field").select("q", "field", "token", (F.col("qtf") * idf(F.col("n"), F.col("df"))).alias("w"), "avgdl")  # fields: a row each
        part = F.col("w") * saturation(F.col("tf"), F.col("dl"), F.col("avgdl"))
        return found.join(weights, ["field", "token"]).groupBy("q", "node", "label").agg(F.sum(part).alias("score")).select(F.col("q").alias(query), "node", "label", "score")


def best_of_strings(hits: DataFrame, strings: DataFrame, minimum: float, *to: str) -> DataFrame:
    """(query_id, *to, score) from hits of strings (s: query_id and string_no): the largest of coefficient x score, of scores above minimum / coefficient."""
    coefficients = strings.select(F.struct("query_id", "string_no").alias("s"), "coefficient")
    return hits.join(coefficients, "s").where(F.col("score") > minimum / F.col("coefficient")).groupBy(F.col("s.query_id").alias("query_id"), *to).agg(F.max(F.col("coefficient") * F.col("score")).alias("score"))


def weighted_search(docs: DataFrame, strings: DataFrame, minimum: float = 0.0, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, doc, score) from several strings (query_id, string_no, coefficient, query_text) for a query."""
    hits = bm25(docs, strings.select(F.struct("query_id", "string_no").alias("s"), "query_text"), doc, text, "s")
    return best_of_strings(hits, strings, minimum, doc)


def mean_over_values(hits: DataFrame, values: DataFrame, group: str, value: str, target: str) -> DataFrame:
    """(group, target, score): for each distinct value of a group its best score of a target, averaged over all its values, 0 without a hit."""
    distinct = values.select(group, value).distinct()
    n = distinct.groupBy(group).agg(F.count("*").alias("n"))
    best = distinct.join(hits.groupBy(value, target).agg(F.max("score").alias("best")), value)
    return best.groupBy(group, target).agg(F.sum("best").alias("total")).join(n, group).select(group, target, (F.col("total") / F.col("n")).alias("score"))


def exact_share(values: DataFrame, permitted: DataFrame, group: str, value: str, target: str) -> DataFrame:
    """(group, target, score): the share of a group's distinct values, in lower case, that a target permits."""
    distinct = values.select(group, F.lower(value).alias("v")).distinct()
    n = distinct.groupBy(group).agg(F.count("*").alias("n"))
    allowed = permitted.select(target, F.lower(value).alias("v")).distinct()
    return distinct.join(allowed, "v").groupBy(group, target).agg(F.count("*").alias("hits")).join(n, group).select(group, target, (F.col("hits") / F.col("n")).alias("score"))


def hit_share(hits: DataFrame, values: DataFrame, candidates: DataFrame, group: str, value: str, target: str, minimum: float) -> DataFrame:
    """(group, target, score): for candidates (group, target) the share of the group's distinct values with a hit above the minimum; 0 without any."""
    distinct = values.select(group, value).distinct()
    n = distinct.groupBy(group).agg(F.count("*").alias("n"))
    flags = hits.groupBy(value, target).agg(F.max("score").alias("best")).where(F.col("best") > minimum)
    found = distinct.join(flags, value).groupBy(group, target).agg(F.count("*").alias("hits"))
    return candidates.distinct().join(found, [group, target], "left").join(n, group).select(group, target, (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("score"))


def secondary_search(first: DataFrame, second: DataFrame, query: str, target: str, least: int) -> DataFrame:
    """First hits, and for queries with fewer than `least` of them those of a second search that the first doesn't have, marked. As data: no branch on the driver."""
    few = first.groupBy(query).agg(F.count("*").alias("n")).where(F.col("n") < least).select(query)
    none = second.select(query).distinct().join(first.select(query).distinct(), query, "left_anti")
    new = second.join(few.unionByName(none), query, "left_semi").join(first.select(query, target), [query, target], "left_anti")
    return first.withColumn("secondary_search", F.lit(0)).unionByName(new.withColumn("secondary_search", F.lit(1)))


def contained_words(texts: DataFrame, words: DataFrame, key: str, text: str, word: str) -> DataFrame:
    """(key, word) of dictionary words of any length that occur anywhere in a text, both in lower case.

    An equi-join instead of a nested loop: a word is looked for by the one of its GRAM-letter pieces (a shorter word: by itself) that the fewest words
    share, in the distinct pieces of each text; candidates are then looked up in the whole text. So a text of n letters gives at most
    GRAM x n rows, whatever the words' lengths. Texts are compared once however often they occur. Null and empty texts and words match nothing.
    """
    pieces = lambda c, n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(F.col(c), i, F.lit(n)))
    w = words.select(F.lower(word).alias("w")).where("w <> ''").distinct()
    grams = w.select("w", F.explode(F.array_distinct(F.when(F.length("w") < GRAM, F.array("w")).otherwise(pieces("w", GRAM)))).alias("g"))
    common = grams.groupBy("g").agg(F.count("*").alias("n"))
    rarest = grams.join(common, "g").groupBy("w").agg(F.min(F.struct("n", "g")).alias("m")).select("w", F.col("m.g").alias("g"))
    lower = texts.select(F.col(key).alias("k"), F.lower(text).alias("t")).where("t <> ''").withColumn("h", F.sha2("t", 256))
    every = F.array_distinct(F.flatten(F.array(*(F.when(F.length("t") >= n, pieces("t", n)).otherwise(F.array().cast("array<string>")) for n in range(1, GRAM + 1)))))
    candidates = lower.dropDuplicates(["h"]).select("h", F.explode(every).alias("g")).join(rarest, "g").select("h", "w")
    return lower.join(candidates, "h").where(F.expr("contains(t, w)")).select(F.col("k").alias(key), F.col("w").alias(word))
