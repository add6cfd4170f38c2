"""Exact deduplication by two-pass Bloom filtering.

The first pass puts the hash of every text into a Bloom filter of two bits a
slot ("seen", "seen again").  The second pass tests each row: one whose slots
have not all been seen again has a text of its own and passes straight through.
Only the others, the true copies and a few false hits, shuffle by digest and
are settled exactly.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.runtime import bounded, delete, run_dir, shuffle_partitions, stored

#: Slots a row; with three probes about one unique row in 150 is tested again by shuffle.
SLOTS_PER_ROW = 16
PROBES = 3
#: A filter has at most so many slots (16 MB); more hashes are dealt into parts of the hash space, with one filter each.
MAX_SLOTS = 1 << 27
#: Tasks that build a filter at once at most, each with one filter in memory.
BUILDERS = 64
#: A filter travels in pieces of so many slots.
SEGMENT = 1 << 18


def _slots(hashes: np.ndarray, slots: int) -> np.ndarray:
    """PROBES slots for each 64-bit hash, by double hashing."""
    h = hashes.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)
    return ((low[:, None] + steps * high[:, None]) & np.uint64(slots - 1)).astype(np.int64)


def _build(slots: int):
    def build(batches):
        seen, again = np.zeros(slots, bool), np.zeros(slots, bool)
        for batch in batches:
            h = np.asarray(batch.column("hash"))
            unique, n = np.unique(h, return_counts=True)
            at = _slots(unique, slots)
            # a slot that one hash probes twice is seen once by it
            at.sort(axis=1)
            first = np.ones(at.shape, bool)
            first[:, 1:] = at[:, 1:] != at[:, :-1]
            times = np.bincount(at[first], minlength=slots)
            again[at[n > 1].ravel()] = True
            again |= (times > 1) | (seen & (times > 0))
            seen |= times > 0
        for k in range(0, slots, SEGMENT):
            s, a = seen[k : k + SEGMENT], again[k : k + SEGMENT]
            if s.any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([k // SEGMENT], pa.int32()), "seen": [np.packbits(s).tobytes()], "again": [np.packbits(a).tobytes()]})

    return build


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    seen = again = None
    for s, a in zip(pdf["seen"], pdf["again"]):
        s, a = np.frombuffer(s, np.uint8), np.frombuffer(a, np.uint8)
        seen, again = (s, a) if seen is None else (seen | s, again | a | (seen & s))
    return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "seen": [b""], "again": [again.tobytes()]})


def _tester(shared, slots: int):
    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        filled = np.frombuffer(shared.value, np.uint8)
        at = _slots(h.to_numpy(np.int64), slots)
        return pd.Series(((filled[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1))

    return test


def filter_parts(rows: int) -> tuple[int, int]:
    """How many filters *rows* hashes take, and the slots of each."""
    parts = max(1, math.ceil(rows * SLOTS_PER_ROW / MAX_SLOTS))
    return parts, max(SEGMENT, 1 << math.ceil(math.log2(max(2, rows / parts * SLOTS_PER_ROW))))


def repeated_filter(hashes: DataFrame, slots: int):
    """The broadcast filter of *hashes* (one bigint column ``hash``), and a function (Column -> boolean Column).

    The function is true for every hash that occurs twice, and for few others (see SLOTS_PER_ROW).
    """
    built = hashes.coalesce(BUILDERS).mapInArrow(_build(slots), "segment int, seen binary, again binary")
    bits = np.zeros(slots // 8, np.uint8)
    merged = built.groupBy("segment").applyInPandas(_merge, "segment int, seen binary, again binary")
    for r in merged.select("segment", "again").toLocalIterator():
        at = r.segment * SEGMENT // 8
        bits[at : at + len(r.again)] = np.frombuffer(r.again, np.uint8)
    shared = hashes.sparkSession.sparkContext.broadcast(bits.tobytes())
    return shared, _tester(shared, slots)


def flagged(rows: DataFrame, n: int) -> DataFrame:
    """*rows* (narrow, stored, *n* of them, with a bigint ``hash``) with a boolean ``twice``: true for each hash that repeats, and few others.

    One filter does for MAX_SLOTS / SLOTS_PER_ROW rows, and no row moves.  More
    rows are dealt into parts by hash, once; each part is then built, tested and
    written by itself, with its own filter only, which goes before the next one
    comes: what a worker holds does not grow with the rows.
    """
    parts, slots = filter_parts(n)
    if parts == 1:
        return rows.withColumn("twice", repeated_filter(rows.select("hash"), slots)[1](F.col("hash")))
    spark = rows.sparkSession
    path = f"{run_dir(spark)}/parts-{uuid.uuid4().hex}"
    rows.withColumn("part", F.pmod("hash", F.lit(parts))).repartition(max(parts, shuffle_partitions(spark)), "part", F.col("hash") % 1009).write.partitionBy("part").parquet(f"{path}/in")
    for part in range(parts):
        own = _part(spark, rows, f"{path}/in", part)
        shared, test = repeated_filter(own.select("hash"), slots)
        own.withColumn("twice", test(F.col("hash"))).write.mode("append").parquet(f"{path}/out")
        shared.destroy()
    delete(spark, f"{path}/in")
    return spark.read.schema(rows.withColumn("twice", F.lit(True)).schema).parquet(f"{path}/out")


def _part(spark: SparkSession, rows: DataFrame, path: str, part: int) -> DataFrame:
    """One part of the rows that flagged() dealt; empty where no hash fell into it."""
    return spark.read.schema(rows.withColumn("part", F.lit(0)).schema).parquet(path).where(F.col("part") == part).drop("part")


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of *docs*: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text is empty.  Of equal texts
    the row with the largest doc_id stays (a null doc_id is below all; of rows
    alike in both one stays).  An empty table gives no rows; other columns of
    *docs* are not read.
    """
    digests = stored(docs.select(F.col(id_col).alias("doc_id"), F.sha2(_text(text_col).cast("binary"), 256).alias("text_sha256")).withColumn("row", F.monotonically_increasing_id()), "digests")
    tested = stored(flagged(digests.withColumn("hash", F.xxhash64("text_sha256")), digests.count()).drop("hash"), "tested")
    straight = tested.where(~F.col("twice")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = tested.where("twice")
    # stored, so that the join below stands alone and Spark can split a hot digest's rows
    groups = stored(maybe.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("stays"), F.count("*").alias("group_size")), "groups")
    settled = maybe.join(groups, "text_sha256").select("doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"), "text_sha256")
    return straight.unionByName(settled)


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of *docs* that stay (see exact_duplicates), with all their columns.

    A row whose hash passes the filter moves nowhere; of the others whole rows
    are put together within a task before they shuffle.  Where hashes take
    several filters, those that do repeat are settled first, and rows meet them
    by broadcast up to BROADCAST_ROWS, else by shuffle.  Columns may have any
    names.
    """
    text, whole = _text(text_col), F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    hashes = stored(docs.select(F.xxhash64(text).alias("hash")), "hashes")
    n = hashes.count()
    rows = docs.select(whole.alias("whole"), text.alias("text"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("hash"))
    parts, slots = filter_parts(n)
    if parts == 1:
        twice = repeated_filter(hashes, slots)[1](F.col("hash"))
        straight, maybe = rows.where(~twice), rows.where(twice)
    else:
        repeats = stored(flagged(hashes, n).where("twice").groupBy("hash").count().where("count > 1").select("hash"), "repeats")
        straight, maybe = rows.join(bounded(repeats), "hash", "left_anti"), rows.join(bounded(repeats), "hash", "left_semi")
    best = maybe.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("key")).agg(F.max_by("whole", F.struct("id")).alias("whole"))
    return straight.select("whole.*").union(best.select("whole.*"))
