"""Complexity, coverage, review and generated-code reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complexity(rows: DataFrame, top: int = 50) -> DataFrame:
    """(path, function, complexity, start_line, lines): the most complex functions first."""
    span = F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))
    return rows.withColumn("lines", span).orderBy(F.col("complexity").desc(), "path", "start_line").limit(top)


def coverage_gaps(functions: DataFrame, blocks: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(path, function, start_line, total, covered, pct) of functions below *threshold*.

    functions(path, function, start_line, end_line), blocks(file, start_line,
    num_stmt, covered).  A range join within a file: spans are dealt into
    stretches of 64 lines, so a block meets only spans of its stretch.
    """
    stretch = 64
    spans = functions.withColumn("s", F.explode(F.sequence(F.floor(F.col("start_line") / stretch), F.floor(F.greatest("start_line", "end_line") / stretch))))
    own = blocks.select(F.col("file").alias("path"), F.col("start_line").alias("at"), "num_stmt", "covered", F.floor(F.col("start_line") / stretch).alias("s"))
    met = spans.join(own, ["path", "s"]).where(F.col("at").between(F.col("start_line"), F.col("end_line")))
    out = met.groupBy("path", "function", "start_line").agg(F.sum("num_stmt").alias("total"), F.sum(F.when(F.col("covered"), F.col("num_stmt")).otherwise(0)).alias("covered")).where("total > 0")
    return out.withColumn("pct", F.col("covered") / F.col("total")).where(F.col("pct") < threshold)


def review(now: DataFrame, base: DataFrame, ceiling: int = 15) -> DataFrame:
    """(path, symbol, value, before, verdict): fail above the ceiling and worse than before, warn above it, else pass."""
    old = base.groupBy("path", "symbol").agg(F.max("value").alias("before"))
    met = now.groupBy("path", "symbol").agg(F.max("value").alias("value")).join(old, ["path", "symbol"], "left")
    verdict = F.when((F.col("value") > ceiling) & (F.col("value") > F.coalesce("before", F.lit(0))), "fail").when(F.col("value") > ceiling, "warn").otherwise("pass")
    return met.withColumn("verdict", verdict)


def verdict(reviewed: DataFrame) -> DataFrame:
    """One row: fail if any fails, else warn if any warns, else pass."""
    has = lambda v: F.coalesce(F.bool_or(F.col("verdict") == v), F.lit(False))
    return reviewed.agg(F.when(has("fail"), "fail").when(has("warn"), "warn").otherwise("pass").alias("verdict"), F.count("*").alias("checked"))


def generated_hint(files: DataFrame) -> DataFrame:
    """One row: how many files are generated, and whether a hint is due (3 or more, and 34 % or more)."""
    n = F.count_if(F.coalesce("is_generated_code", F.lit(False)))
    return files.agg(F.count("*").alias("files"), n.alias("generated")).withColumn("hint", (F.col("generated") >= 3) & (F.col("generated") * 100 >= F.col("files") * 34))
