"""Keyword (BM25), vector and fused ranking."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quarry.functions import text
from quarry.runtime import stored

K1, B, RRF_K = 1.2, 0.75, 60


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query, by the same rule as the texts' tokens."""
    return sorted({t for t in re.split(r"[\W_]+", query.lower()) if len(t) >= 2})


def _is(word: str, x: Column) -> Column:
    return x == word


def bm25(files: DataFrame, query: str, k1: float = K1, b: float = B, key: str = "path") -> DataFrame:
    """(key, bm25) of every file; frequencies and lengths are those of *files* as they are, after any filter.

    One pass counts the query's terms in each text; the counts, a few numbers a
    file, are stored, so texts are read once.  The corpus numbers are one row (one
    document frequency a term), joined to all.
    """
    terms = query_terms(query)

    def counts(t: Column) -> Column:
        times = [F.size(F.filter(t, functools.partial(_is, w))) for w in terms]
        return F.struct(F.size(t).alias("length"), F.array(*times).cast("array<int>").alias("tf"))

    # the tokens are bound to a name, so that they are made once a text
    own = F.transform(F.array(text.tokens(F.coalesce("body", F.lit("")))), counts)[0]
    counted = stored(files.select(F.col(key), own.alias("c")).select(key, "c.*"), "counts")
    numbers = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.array(*(F.sum((F.get("tf", F.lit(i)) > 0).cast("int")) for i in range(len(terms)))).cast("array<bigint>").alias("df"))
    met = counted.crossJoin(F.broadcast(numbers))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.get("tf", F.lit(i)), F.get("df", F.lit(i))
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        length = F.when(F.col("mean") > 0, F.col("length") / F.col("mean")).otherwise(0.0)
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length))
    return met.select(key, score.alias("bm25"))


def top_k(scored: DataFrame, score: str, k: int, key: str = "path") -> DataFrame:
    """The *k* highest, ties by rising key; none if k < 1."""
    return scored.orderBy(F.col(score).desc(), F.col(key).asc()).limit(max(k, 0))


def cosine(vector: Column, query: list[float]) -> Column:
    """Dot product with a unit vector, added up from left to right in doubles."""
    pairs = F.zip_with(vector, F.array(*(F.lit(float(x)) for x in query)), lambda a, b: a.cast("double") * b)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def vector_top_k(chunks: DataFrame, query: list[float], k: int, key: str = "path", vector: str = "vec") -> DataFrame:
    """(key, similarity): each key's best chunk against *query*, the *k* best keys; partial maxima before the shuffle."""
    best = chunks.select(key, cosine(F.col(vector), query).alias("similarity")).groupBy(key).agg(F.max("similarity").alias("similarity"))
    return top_k(best, "similarity", k, key)


def best_chunk(chunks: DataFrame, query: list[float], key: str = "path", vector: str = "vec", chunk: str = "chunk_id") -> DataFrame:
    """(key, chunk, similarity) of each key's best chunk, of equals the first."""
    scored = chunks.select(key, chunk, cosine(F.col(vector), query).alias("similarity"))
    return scored.groupBy(key).agg(F.max_by(chunk, F.struct("similarity", (-F.col(chunk)).alias("first"))).alias(chunk), F.max("similarity").alias("similarity"))


def positions(scored: DataFrame, score: str, key: str = "path") -> DataFrame:
    """*scored* with ``position``: its place from 1 by falling score, ties by rising key.

    Ranges of the order are numbered apart and shifted by how many rows come
    before them, so no task sees more than its range.
    """
    spark = scored.sparkSession
    cuts = scored.agg(F.percentile_approx(score, [i / 64 for i in range(1, 64)], 10_000)).first()[0]
    cuts = sorted(set(cuts or []), reverse=True)
    part = F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: c > F.col(score))) if cuts else F.lit(0)
    dealt = scored.withColumn("__part", part)
    sizes = {r["__part"]: r["count"] for r in dealt.groupBy("__part").count().collect()}
    before, base = 0, []
    for p in range(len(cuts) + 1):
        base.append(before)
        before += sizes.get(p, 0)
    own = F.row_number().over(Window.partitionBy("__part").orderBy(F.col(score).desc(), F.col(key).asc()))
    return dealt.withColumn("position", own + F.get(F.array(*(F.lit(x).cast("bigint") for x in base)), F.col("__part"))).drop("__part")


def fuse(a: DataFrame, b: DataFrame, score_a: str, score_b: str, key: str = "path", k: int = RRF_K) -> DataFrame:
    """(key, rrf): reciprocal ranks in two full rankings, added up; the scores are stored, as ranking reads them several times."""
    a, b = (stored(df.select(key, score), "scores") for df, score in ((a, score_a), (b, score_b)))
    x = positions(a, score_a, key).select(key, F.col("position").alias("pa"))
    y = positions(b, score_b, key).select(key, F.col("position").alias("pb"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return x.join(y, key, "full_outer").select(key, (part("pa") + part("pb")).alias("rrf"))
