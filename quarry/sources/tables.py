"""Tables of documents, pages and others as files: one wide row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schema
from quarry.functions import text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(docs: DataFrame) -> DataFrame:
    """``documents`` as text files: docs/<source>/<lang>/<doc_id>.txt."""
    name = F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt"))
    folder = F.concat_ws("/", F.lit("docs"), "source", "lang")
    return docs.select(
        F.concat_ws("/", folder, name).alias("path"),
        name.alias("name"),
        folder.alias("dir"),
        F.lit(".txt").alias("ext"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.lit("text").alias("content_type"),
        F.col("lang").alias("language"),
        F.col("text").alias("body"),
        "doc_id",
        "source",
    )


def page_files(pages: DataFrame) -> DataFrame:
    """``pages`` as HTML files; the path is the address."""
    return pages.select(
        F.col("url").alias("path"),
        F.element_at(F.split("url", "/"), -1).alias("name"),
        F.lit("html").alias("content_type"),
        F.octet_length("html").cast("bigint").alias("size"),
        text.html_title(F.col("html")).alias("title"),
        text.html_lang(F.col("html")).alias("language"),
        F.col("html").alias("body"),
        "page_id",
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, target): every href of every page, repeats included."""
    links = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", "url", F.explode(links).alias("target"))


def variables(files: DataFrame) -> dict[str, tuple[str, Column]]:
    """What an expression over *files* may name: every known variable, and its other columns of a known type.

    A missing column, like a null, reads as the type's zero.
    """
    there = dict(files.dtypes)
    found: dict[str, tuple[str, Column]] = {}
    content_type = F.coalesce(F.col("content_type"), F.lit("")) if "content_type" in there else F.lit("")
    for name, kind in schema.TYPES.items():
        if name in there:
            found[name] = (kind, F.coalesce(F.col(f"`{name}`").cast(schema.SPARK_TYPES[kind]) if kind != "map" else F.col(f"`{name}`"), schema.zero(kind)))
        elif name in schema.FLAG_OF:
            found[name] = ("bool", schema.flag(name, content_type))
        else:
            found[name] = (kind, schema.zero(kind))
    for name, spark_type in there.items():
        kind = schema.kind_of(spark_type)
        if name not in found and kind:
            found[name] = (kind, F.coalesce(F.col(f"`{name}`").cast(schema.SPARK_TYPES[kind]) if kind != "map" else F.col(f"`{name}`"), schema.zero(kind)))
    return found
