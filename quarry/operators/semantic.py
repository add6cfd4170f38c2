"""Embeddings of files through any function, kept in a table that knows what is stale."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import lines
from quarry.runtime import bounded, delete, stored

#: What a model takes: a list of texts -> a list of vectors, or None for a text it refuses.
Model = Callable[[list[str]], list]
#: Characters of a text that is tried once more, shortened, where the model refuses it whole.
RETRY = 2048
_KEYS = ("path", "size", "mod_time")
SCHEMA = "path string, size bigint, mod_time timestamp_ntz, model string, chunk_id int, start int, vec array<float>"


def embed(chunks: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """*chunks* with ``vec``: the unit vector of each text; null where the model refuses it and its first RETRY characters."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        own = texts.fillna("").tolist()
        found = list(model(own))
        for i, v in enumerate(found):
            if v is None:
                found[i] = model([own[i][:RETRY]])[0]
        unit = lambda v: None if v is None else (np.asarray(v, float) / (np.linalg.norm(v) or 1.0)).astype(np.float32)
        return pd.Series([unit(v) for v in found], dtype=object)

    return chunks.withColumn("vec", vectors(F.col(text)))


def embed_query(model: Model, query: str) -> list[float]:
    v = np.asarray(model([query])[0], float)
    return (v / (np.linalg.norm(v) or 1.0)).tolist()


def index(files: DataFrame, folder: str, model: Model, name: str, chunk_size: int = 8192) -> DataFrame:
    """The vectors of *files* (path, size, mod_time, body) from the table in *folder*, as SCHEMA.

    Files that the table has with the same size, time and model *name* are not
    embedded again; others are, and are added as a new batch.  Rows of changed or
    vanished files stay in the table but are not returned; see prune().
    """
    spark = files.sparkSession
    known = read(spark, folder).where(F.col("model") == name)
    now = stored(files.select(*_KEYS).where("size > 0"), "files")
    fresh = stored(known.select(*_KEYS).distinct().join(now, list(_KEYS), "left_semi"), "fresh")
    todo = now.join(bounded(fresh), list(_KEYS), "left_anti")
    if not todo.isEmpty():
        own = files.join(todo, list(_KEYS), "left_semi")
        cut = lines.chunks(own, chunk_size)
        made = embed(cut, model).join(own.select(*_KEYS), "path").withColumn("model", F.lit(name))
        made.selectExpr(*(f"cast({c} as {t}) as {c}" for c, t in (x.split() for x in SCHEMA.split(", ")))).write.parquet(f"{folder}/batch-{uuid.uuid4().hex}")
    return read(spark, folder).where(F.col("model") == name).join(now, list(_KEYS), "left_semi")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The table in *folder*; empty where there is none yet."""
    try:
        return spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)


def prune(files: DataFrame, folder: str) -> None:
    """Keeps only the vectors of *files* as they are now, in one batch."""
    spark = files.sparkSession
    old = sorted({f.rsplit("/", 2)[0] + "/" + f.rsplit("/", 2)[1] for f in read(spark, folder).inputFiles()})
    read(spark, folder).join(files.select(*_KEYS), list(_KEYS), "left_semi").write.parquet(f"{folder}/batch-{uuid.uuid4().hex}")
    for batch in old:
        delete(spark, batch)


def with_similarity(files: DataFrame, vectors: DataFrame, query: list[float]) -> DataFrame:
    """*files* with similarity: that of the best chunk in *vectors* (path, vec); null for a file without one."""
    from quarry.operators import relevance

    best = vectors.where("vec is not null").groupBy("path").agg(F.max(relevance.cosine(F.col("vec"), query)).alias("similarity"))
    return files.drop("similarity").join(best, "path", "left")
