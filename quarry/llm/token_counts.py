"""Token counts through a digest cache.

The cache is a Parquet table in the shared folder: digest of the normalised
content, digest of the tokenizer version, token count.  A count run hashes each
text where it is read, joins the digests to the cache, encodes the distinct
misses only, and appends them as a new batch folder.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import chunk_tokens
from quarry.runtime import bounded, delete, shared_dir, stored

CACHE_SCHEMA = "content string, tokenizer string, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the tokenizer file and the library's version: a change of either starts new entries."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def content_digest(text):
    """SHA-256 of the text with ASCII white-space runs as one blank, none at the ends; the tokenizer drops them all the same."""
    return F.sha2(F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")).cast("binary"), 256)


def read_cache(spark, cache_dir: str) -> DataFrame:
    """The cached counts, one row a key; none where the folder does not exist yet."""
    try:
        cache = spark.read.schema(CACHE_SCHEMA).option("recursiveFileLookup", True).parquet(cache_dir)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        cache = spark.createDataFrame([], CACHE_SCHEMA)
    return cache


def _counts(path: str):
    def encode(batches):
        for batch in batches:
            texts = batch.column("text")
            n = [chunk_tokens.count_tokens(path, texts.slice(a, b - a)) for a, b in chunk_tokens.slices(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(np.concatenate(n) if n else [], pa.int64())], names=["content", "n_tokens"])

    return encode


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, cache_dir: str | None = None) -> DataFrame:
    """One row per row of *docs*: doc_id, n_bytes, n_tokens, over_limit, cached.

    n_tokens is what the library for *path* gives for the whole text without
    added tokens; over_limit is n_tokens > *limit*; cached tells whether the
    count was there before the run.  A null text counts as empty (0 tokens).
    Repeated texts and repeated ids give a row each; an empty table gives none.
    Other columns of *docs* are not read, so their names cannot clash.

    Texts that miss the cache move once, by digest, after copies within a task
    are put together; a count of the missing digests decides whether they are
    first singled out by a broadcast.  A run without misses writes nothing.
    """
    spark = docs.sparkSession
    cache_dir = cache_dir or f"{shared_dir(spark)}/token-cache"
    version = tokenizer_digest(path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = read_cache(spark, cache_dir).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    digests = stored(docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), content_digest(text).alias("content")), "digests")
    missing = stored(digests.select("content").distinct().join(known, "content", "left_anti"), "missing")
    join_back = lambda counts: digests.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cached")
    old = known.withColumn("cached", F.lit(True))
    if missing.isEmpty():
        return join_back(old)
    texts = docs.select(content_digest(text).alias("content"), text.alias("text"))
    distinct_misses = texts.dropDuplicates(["content"])
    if not known.isEmpty():
        distinct_misses = texts.join(bounded(missing), "content", "left_semi").dropDuplicates(["content"])
    batch = f"{cache_dir}/batch-{uuid.uuid4().hex}"
    distinct_misses.mapInArrow(_counts(path), "content string, n_tokens bigint").select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.parquet(batch)
    fresh = spark.read.schema(CACHE_SCHEMA).parquet(batch).select("content", "n_tokens", F.lit(False).alias("cached"))
    return join_back(old.join(missing, "content", "left_anti").unionByName(fresh))


def compact(spark, cache_dir: str) -> int:
    """Writes all batches of a cache as one, each key once, then deletes them; the number of keys.  For times when nothing else uses the cache."""
    old = sorted({f.rsplit("/", 2)[0] + "/" + f.rsplit("/", 2)[1] for f in read_cache(spark, cache_dir).inputFiles()})
    if not old:
        return 0
    batch = f"{cache_dir}/batch-{uuid.uuid4().hex}"
    read_cache(spark, cache_dir).groupBy("content", "tokenizer").agg(F.max("n_tokens").alias("n_tokens")).write.parquet(batch)
    for folder in old:
        delete(spark, folder)
    return spark.read.schema(CACHE_SCHEMA).parquet(batch).count()
