"""Token counts by a digest cache."""

from __future__ import annotations

import functools
import hashlib
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colweave.llm.common import looked_up, map_batches, rows_of, table
from colweave.storage import at_end, delete, exists, saved, shared_folder

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
#: So many missing digests (32 bytes each) are broadcast at most.
BROADCAST_DIGESTS = 200_000


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def counts(path: str, texts: list[str]) -> list[int]:
    """Tokens of whole texts without added begin or end tokens; batches of about a megabyte bound the memory of the encodings."""
    tokenizer, out, at = load_tokenizer(path), [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= 1_000_000):
            size += len(texts[end])
            end += 1
        if path.endswith(".model"):
            out += map(len, tokenizer.encode(texts[at:end], num_threads=1))
        else:
            out += [len(x.ids) for x in tokenizer.encode_batch_fast(texts[at:end], add_special_tokens=False)]
        at = end
    return out


def tokenizer_version(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def token_counts(df: DataFrame, tokenizer_path: str, cache_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of every row; texts that the cache doesn't know are encoded once each and appended to it.

    The content is normalised to its UTF-8 bytes, null as empty: any further normalisation would change counts. The
    cache holds (digest, tokenizer, n_tokens), tokenizer being the SHA-256 of the tokenizer's file, so that another
    version never meets old counts. Digests of all rows are joined to stored counts; distinct misses are encoded and appended, and the rows joined to the
    cache, frequent digests by broadcast (looked_up()). Copies are combined on the map side before texts are shuffled; a group of
    copies that holds a third of the rows sends a row per task. With a cache at hand, missing digests are found
    first, and if there are few, only their texts move at all. A run that breaks off before its append has added
    nothing; one that is repeated finds what it lacks. An empty table gives none, repeated rows a row each, and a null key stays null.
    Columns other than key and text aren't looked at, and the key may have any type and name.
    """
    spark, version = df.sparkSession, tokenizer_version(tokenizer_path)
    t = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest")
    rows = saved(df.select(F.col(key).alias("k"), digest, F.octet_length(t).cast("long").alias("n_bytes")))
    texts = df.select(digest, t.alias("t"))
    known = None
    if exists(spark, cache_path):
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version).select("digest").distinct()
        missing = rows.select("digest").distinct().join(known, "digest", "left_anti")
        if missing.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
            texts, known = texts.join(F.broadcast(missing), "digest", "left_semi"), None
    misses = texts.groupBy("digest").agg(F.first("t").alias("t"))
    if known is not None:
        misses = misses.join(known, "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = counts(tokenizer_path, rows_of(batch, "t"))
            yield pa.record_batch([batch.column(0), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    map_batches(misses, encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    # two runs at once may both have added a digest: counts are equal, so any one will do
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return looked_up(rows, cache, "digest").select(F.col("k").alias(key), "n_bytes", "n_tokens")


def query(spark: SparkSession, sf_dir: str, cache: str | None = None) -> DataFrame:
    """op7: counts of all documents by the 50k byte-level vocabulary; without a `cache` from an earlier call, from one that is new."""
    import public_tokenizers

    if cache is None:
        cache = f"{shared_folder(spark)}/token-cache/{uuid.uuid4().hex}"
        at_end(lambda: delete(spark, cache))
    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)
