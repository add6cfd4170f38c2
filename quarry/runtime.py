"""Where intermediate tables go, how sizes are checked before a broadcast, and how hot keys are split."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of (at most) a few longs that may be broadcast, and the bytes of a stored table; beyond either joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20
#: A key with more than this part of all rows is hot; so there are fewer hot keys than this.
HOT = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder; on a cluster it
    is an error, as each machine has temporary folders of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables; see clean()."""
    return f"{shared_dir(spark)}/quarry-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str = "step", **options: object) -> DataFrame:
    """*df* written as Parquet to the shared folder, with the writer's *options*, and read again.

    Cuts lineage: a lost executor costs only the tasks that read the table, and
    whatever reads it more than once does not compute it again.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._stored_at = path
    return again


def _bytes_at(spark: SparkSession, path: str) -> int:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes *path* where the shared folder is, local or remote."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Deletes the files of stored *tables* that nothing reads any more, such as the last round of a loop."""
    for df in tables:
        if getattr(df, "_stored_at", None):
            delete(df.sparkSession, df._stored_at)


def clean(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; for when its results have been written or read."""
    delete(spark, run_dir(spark))


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """*df* marked for broadcast if it has at most *rows* rows and, where stored, BROADCAST_BYTES bytes, else as it is.

    For narrow tables (ids and flags) that are already stored: counting them
    reads Parquet footers only.
    """
    if getattr(df, "_stored_at", None) and _bytes_at(df.sparkSession, df._stored_at) > BROADCAST_BYTES:
        return df
    return F.broadcast(df) if df.count() <= rows else df


def join_each(rows: DataFrame, one: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """*rows* joined with *one*, which has one row a key and the number of the key's rows as ``__n``; ``__n`` is dropped.

    With BROADCAST_ROWS rows (*total*, counted if not given) or fewer *one* has no
    more and is broadcast.  Else keys with more than a 1 / HOT part of all rows are
    fewer than HOT, so their rows of *one* are broadcast and the hot rows stay
    where they are; all others meet by shuffle.
    """
    if total is None:
        total = one.agg(F.sum("__n")).first()[0] or 0
    if total <= BROADCAST_ROWS:
        return rows.join(F.broadcast(one.drop("__n")), key)
    hot = F.broadcast(one.where(F.col("__n") * HOT > total).drop("__n"))
    cool = one.where(F.col("__n") * HOT <= total).drop("__n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cool.hint("merge"), key))


#: Rows that a Python worker turns into wide rows at a time, whose texts or contents have at most so many bytes (or one row).
SLICE_ROWS, SLICE_BYTES = 1024, 8 << 20


def slices(values: Iterable, rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, end) of stretches of *values* (texts, bytes or None) of at most *rows* values of *most* length in all, or of one value."""
    start, held, end = 0, 0, 0
    for i, value in enumerate(values):
        size, end = len(value) if value is not None else 0, i + 1
        if i > start and (i - start >= rows or held + size > most):
            yield start, i
            start, held = i, 0
        held += size
    if start < end:
        yield start, end


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def importable(spark: SparkSession) -> None:
    """Lets Python workers that this driver starts import this library from where the driver did."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, home])
