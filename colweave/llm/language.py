"""Language identification by Bayesian fusion of evidence."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colweave.llm.common import fresh, looked_up, map_batches, rows_of, table, type_of
from colweave.storage import broadcast, saved

#: Hashed letter trigrams: the text model's size, whatever the corpus.
BUCKETS = 1 << 15
#: Hosts whose counts are broadcast at most (more are joined).
BROADCAST_HOSTS = 20_000
#: Trigrams of a text count as this many independent ones at most; the rest of the evidence would else never matter.
TEXT_WEIGHT = 40.0
#: Pseudo-counts of the prior above, for hosts, suffixes and declared languages.
STRENGTH = 20.0
#: What is added to each trigram's count in each language.
SMOOTHING = 0.1
#: What a word counts that occurs once only under a declared value.
ONCE = 0.125
#: The class of texts that no language explains: all trigrams are equally likely in it. What is declared by this name declares nothing.
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
#: The first 256 characters, all but letters as spaces.
LATIN = bytes(c if LETTERS.match(chr(c)) else 32 for c in range(256))
#: Numbers kept for known words at most, one for each language and two more a word.
KEPT_SCORES = 3_000_000
#: Scores of new words that are worked out at once, one for each language.
NEW_SCORES = 80_000
#: What holds no tags of a page: comments, also empty or unclosed ones, and the insides of scripts and styles.
UNTAGGED = r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|<(script|style)\b.*?(?:</\1\s*>|\z)"
HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def words_of(text: str) -> list[str]:
    """Runs of letters; texts of Latin characters alone, most of them, take a shorter way."""
    try:
        return text.encode("latin-1").translate(LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return LETTERS.findall(text)


def trigrams(word: str) -> list[int]:
    w = f" {word} "
    if w.isascii():
        b = w.encode()
        return [zlib.crc32(b[i : i + 3]) % BUCKETS for i in range(len(b) - 2)]
    return [zlib.crc32(w[i : i + 3].encode()) % BUCKETS for i in range(len(w) - 2)]


def row_digest(*columns: str) -> Column:
    """64 bits of a row that tell nulls from empty texts and from each other's places."""
    return F.xxhash64(*(x for c in columns for x in (F.col(c), F.col(c).isNull())))


def from_documents(df: DataFrame) -> DataFrame:
    """Evidence of documents: their source stands for the host, the language column for what is declared."""
    return df.select("doc_id", F.lit(None).cast("long").alias("page_id"), F.col("text").alias("x"), F.lower("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.concat(F.lit("source:"), "source").alias("host"), row_digest("doc_id", "text", "lang", "source").alias("row"))


def from_pages(df: DataFrame) -> DataFrame:
    """Evidence of pages: the html tag's language, wherever the tag stands outside comments, scripts and styles, the last part of the host's name, the host."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    declared = F.lower(F.regexp_extract(F.regexp_replace("html", UNTAGGED, " "), r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    empty = lambda c: F.when(c != "", c)
    return df.select(F.lit(None).cast("long").alias("doc_id"), "page_id", F.col("html").alias("x"), empty(declared).alias("declared"), empty(F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1)).alias("suffix"), empty(host).alias("host"), row_digest("page_id", "url", "html").alias("row"))


def visible(text: str | None, page: bool) -> str:
    if not text:
        return ""
    if page:
        import html

        text = html.unescape(HIDDEN.sub(" ", text))
    return text.lower()


class TextModel:
    """Smoothed log-probabilities of trigrams in each language, as counts (bucket b, language i, n) above none: languages of few texts take little room. The last class is UNKNOWN."""

    def __init__(self, languages: list[str], b: np.ndarray, i: np.ndarray, n: np.ndarray):
        self.languages = [*languages, UNKNOWN]
        order = np.argsort(b, kind="stable")
        self.starts = np.searchsorted(b[order], np.arange(BUCKETS + 1))
        self.language, self.above = i[order].astype(np.int32), np.log(n[order] / SMOOTHING + 1.0)
        self.none = np.log(np.append(SMOOTHING / (np.bincount(i, weights=n, minlength=len(languages))[: len(languages)] + SMOOTHING * BUCKETS), 1 / BUCKETS))

    def log_likelihoods(self, words: list[list[int]]) -> np.ndarray:
        """A row for each word, given as its trigrams, a column for each language."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        grams = np.fromiter(itertools.chain.from_iterable(words), dtype=np.int64, count=int(sizes.sum()))
        first, held = self.starts[grams], self.starts[grams + 1] - self.starts[grams]
        at = np.arange(int(held.sum())) + np.repeat(first - np.cumsum(held) + held, held)
        n = len(self.languages)
        place = np.repeat(np.repeat(np.arange(len(words)), sizes), held) * n + self.language[at]
        return sizes[:, None] * self.none + np.bincount(place, weights=self.above[at], minlength=len(words) * n).reshape(-1, n)


def train(evidence: DataFrame) -> TextModel:
    """Trigram counts of all texts by declared language, each declared value being one.

    Words are counted in each batch and summed by grouped aggregation; a word that occurs only once under a value counts ONCE: strings at random hardly ever come again, words of a language
    do, so junk teaches little whatever it is declared as. Trigrams of the distinct words are summed into at most BUCKETS rows a language.
    """
    languages = sorted(r.declared for r in evidence.where(F.col("declared").isNotNull() & (F.col("declared") != UNKNOWN)).select("declared").distinct().collect())

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            seen: dict[int, Counter] = {}
            for x, declared, page in zip(rows_of(batch, "x"), rows_of(batch, "declared"), rows_of(batch, "page_id"), strict=True):
                if declared in place:
                    seen.setdefault(place[declared], Counter()).update(words_of(visible(x, page is not None)))
            own = [(i, list(c), list(c.values())) for i, c in seen.items()]
            flat = [w for _, ws, _ in own for w in ws]
            yield pa.record_batch([pa.array(np.repeat([i for i, _, _ in own], [len(ws) for _, ws, _ in own]).astype(np.int64)), pa.array(flat, pa.string()), pa.array([n for _, _, ns in own for n in ns], pa.int64())], ["i", "w", "n"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0)
        for batch in batches:
            own = [trigrams(w) for w in rows_of(batch, "w")]
            sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
            flat = np.fromiter(itertools.chain.from_iterable(own), dtype=np.int64, count=int(sizes.sum()))
            keys = np.r_[keys, np.repeat(np.asarray(batch.column(0)), sizes) * BUCKETS + flat]
            counts = np.r_[counts, np.repeat(np.asarray(batch.column(2)), sizes)]
            keys, at = np.unique(keys, return_inverse=True)
            counts = np.bincount(at, weights=counts, minlength=len(keys))
        yield pa.record_batch([pa.array(keys % BUCKETS), pa.array(keys // BUCKETS), pa.array(counts)], ["b", "i", "n"])

    none = np.zeros(0, dtype=np.int64)
    if not languages:
        return TextModel([], none, none, none)
    known = map_batches(evidence.select("x", "declared", "page_id"), words, "i long, w string, n long").groupBy("i", "w").agg(F.sum("n").alias("n"))
    weighed = known.select("i", "w", F.when(F.col("n") == 1, ONCE).otherwise(F.col("n").cast("double")).alias("n"))
    sums = map_batches(weighed, grams, "b long, i long, n double").groupBy("b", "i").agg(F.sum("n").alias("n")).toArrow()
    return TextModel(languages, *(sums.column(c).to_numpy() for c in ("b", "i", "n")))


def identify(evidence: DataFrame, model: TextModel | None = None, accept: float = 0.5) -> DataFrame:
    """(doc_id, page_id, row, language, posterior, text_language, n_letters, accepted) of every row of evidence.

    Languages are the declared values, and UNKNOWN, in which any trigram is as likely as any other: a text that no language explains better is of none. The posterior of a language is in proportion to its prior at the host times the likelihoods of the text, of the declared
    language and of the address suffix. Text: letter trigrams, tempered to TEXT_WEIGHT of them. The others come
    from grouped counts of the most likely language by text alone over all rows with letters: P(declared | language) and P(suffix | language) smoothed
    toward their overall shares; a host's prior smoothed toward its suffix's, that toward the overall prior. Unknown or missing
    evidence has the likelihood 1. Whole texts are read; a row without letters has text likelihood 1 and isn't accepted, others are if their posterior is at least
    `accept` and their language isn't UNKNOWN, where there is any other. Ties go to the first language by name. A row gives a row, repeated rows equal ones; an empty table gives none. Keys may have any type.

    A row carries a number for each language, as does a host. What declared values tell is kept for those pairs of them and languages that occur, so nothing grows with their square.
    """
    spark = evidence.sparkSession
    model = model or train(evidence)
    languages, n = model.languages, len(model.languages)
    shared = broadcast(spark, model)

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, step = shared.value, {}, max(100, NEW_SCORES // n)
        kept = np.zeros((KEPT_SCORES // (n + 2) + 1, n + 2), dtype=np.float32)  # scores of known words, their trigrams and letters
        for batch in batches:
            scores, letters = [], []
            for x, page in zip(rows_of(batch, "x"), rows_of(batch, "page_id"), strict=True):
                found = words_of(visible(x, page is not None))
                if len(known) + len(found) >= len(kept):
                    known.clear()
                    if len(found) >= len(kept):
                        kept = np.zeros((2 * len(found), kept.shape[1]), dtype=np.float32)
                new = [w for w in dict.fromkeys(found) if w not in known]
                for lo in range(0, len(new), step):
                    part = new[lo : lo + step]
                    grams, rows = [trigrams(w) for w in part], slice(len(known), len(known) + len(part))
                    kept[rows, :-2], kept[rows, -2], kept[rows, -1] = model.log_likelihoods(grams), [len(g) for g in grams], [len(w) for w in part]
                    known.update(zip(part, range(len(known), len(known) + len(part))))
                sums = kept[np.fromiter(map(known.__getitem__, found), dtype=np.int64, count=len(found))].sum(axis=0, dtype=np.float64)
                total = sums[-2]
                scores.append((sums[:-2] * min(1.0, TEXT_WEIGHT / total) if total else sums[:-2]).tolist())
                letters.append(int(sums[-1]))
            names = ["doc_id", "page_id", "declared", "suffix", "host", "row"]
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(scores, pa.list_(pa.float64())), pa.array(letters, pa.int64())], [*names, "text_log", "n_letters"])

    kept = f"doc_id {type_of(evidence, 'doc_id')}, page_id {type_of(evidence, 'page_id')}, declared string, suffix string, host string, row long, text_log array<double>, n_letters long"
    rows = saved(map_batches(evidence, likelihoods, kept))
    names = spark.createDataFrame([(languages,)], "names array<string>")  # a row, as the languages are too many for an expression each
    best = F.array_position("text_log", F.array_max("text_log")).cast("int") - 1
    first = F.when(F.col("n_letters") > 0, best)
    votes = rows.select("declared", "suffix", "host", first.alias("i")).where("i IS NOT NULL")
    listed = lambda *by: votes.groupBy(*by, "i").count().groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("i", F.col("count").cast("double")))).alias("m"))
    tally = lambda *by: listed(*by).select(*by, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0))).alias("c"))
    counted = votes.groupBy("declared", "i").count().collect()  # pairs that occur
    overall, rest = np.ones(n), np.zeros(n)
    pairs: dict[str, dict[int, int]] = {x: {} for x in languages}
    for r in counted:
        overall[r.i] += r["count"]
        if r.declared in pairs:
            pairs[r.declared][r.i] = r["count"]
        else:  # other names, or none
            rest[r.i] += r["count"]
    prior = overall / overall.sum()
    # P(declared | language) is (count + STRENGTH share) / (all + STRENGTH): a value's share where they don't meet, more by `more` where they do, over what the language alone gives
    shares = {x: (sum(c.values()) + 1) / (overall.sum() + n) for x, c in pairs.items()}
    met = [(x, float(np.log(STRENGTH * shares[x])), {i: float(np.log1p(m / (STRENGTH * shares[x]))) for i, m in c.items()}) for x, c in pairs.items()]
    said = saved(spark.createDataFrame(met, "said string, least double, more map<int, double>"))
    alone = -np.log(overall - 1 - rest + STRENGTH)
    array = lambda v: F.lit(np.asarray(v, dtype=np.float64))
    suffixes = tally("suffix").where("suffix IS NOT NULL")
    total = F.aggregate("sc", F.lit(0.0), lambda a, x: a + x)
    by_suffix = suffixes.select("suffix", F.col("c").alias("sc")).select("suffix", F.transform(F.arrays_zip("sc", array(prior).alias("p")), lambda z: (z["sc"] + STRENGTH * z["p"]) / (total + STRENGTH)).alias("sp"), F.transform(F.arrays_zip("sc", array(overall).alias("o")), lambda z: F.log((z["sc"] + STRENGTH * (total + 1) / float(overall.sum())) / (z["o"] + STRENGTH))).alias("sl"))
    host_total = F.aggregate("hc", F.lit(0.0), lambda a, x: a + x)
    # a host belongs to its smallest suffix: one each, as a suffix is part of the host's name
    every = rows.where("host IS NOT NULL").select("host", "suffix").distinct()
    ours = (F.col("ch") == F.col("host")) & F.col("cs").eqNullSafe(F.col("suffix"))
    own = every.join(tally("host", "suffix").select(F.col("host").alias("ch"), F.col("suffix").alias("cs"), "c"), ours, "left")
    priors = own.join(by_suffix, "suffix", "left").select("host", "suffix", F.coalesce("c", array(np.zeros(n))).alias("hc"), F.coalesce("sp", array(prior)).alias("sp"), "sl")
    by_host = saved(priors.select(F.xxhash64("host", "suffix", F.col("suffix").isNull()).alias("site"), F.transform(F.arrays_zip("hc", "sp"), lambda z: F.log((z["hc"] + STRENGTH * z["sp"]) / (host_total + STRENGTH))).alias("host_log"), F.col("sl").alias("suffix_log")))
    placed = rows.withColumn("site", F.when(F.col("host").isNotNull(), F.xxhash64("host", "suffix", F.col("suffix").isNull())))
    if by_host.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        fused = placed.join(F.broadcast(by_host), "site", "left")
    else:  # a large host is no task of its own, nor are rows without one
        fused = looked_up(saved(placed.where("site IS NOT NULL")), by_host, "site").unionByName(placed.where("site IS NULL"), allowMissingColumns=True)
    zero = array(np.zeros(n))
    fused = fused.join(said, fused["declared"] == said["said"], "left").crossJoin(F.broadcast(names))  # a row for each declared value: broadcast while it is small
    parts = F.arrays_zip(F.when(F.col("n_letters") > 0, F.col("text_log")).otherwise(zero).alias("t"), F.coalesce("host_log", array(np.log(prior))).alias("h"), F.coalesce("suffix_log", zero).alias("s"), F.when(F.col("least").isNotNull(), array(alone)).otherwise(zero).alias("d"))
    fused = fused.withColumn("logs", F.transform(parts, lambda z, i: z["t"] + z["h"] + z["s"] + z["d"] + F.coalesce("least", F.lit(0.0)) + F.coalesce(F.try_element_at("more", i), F.lit(0.0)))).withColumn("top", F.array_max("logs"))
    posterior = 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    at = F.array_position("logs", F.col("top")).cast("int")
    return fused.select("doc_id", "page_id", "row", F.element_at("names", at).alias("language"), posterior.alias("posterior"), F.when(first.isNotNull(), F.element_at("names", first + 1)).alias("text_language"), "n_letters", ((F.col("n_letters") > 0) & (posterior >= accept) & ((at < n) | F.lit(n == 1))).alias("accepted"))


def accepted_documents(df: DataFrame) -> DataFrame:
    """df without the documents that identify() doesn't accept; equal rows share their fate, all columns stay, whatever they are called."""
    (row,) = fresh(df, "row")
    gone = saved(identify(from_documents(df)).where("NOT accepted").select(F.col("row").alias(row)).distinct())  # its size is known by then: texts aren't shuffled for a few
    return df.withColumn(row, row_digest("doc_id", "text", "lang", "source")).join(gone, row, "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all documents (doc_id) and all pages (page_id), the latter with their markup, addresses and hosts."""
    return identify(from_documents(table(spark, sf_dir, "documents")).unionByName(from_pages(table(spark, sf_dir, "pages"))))
