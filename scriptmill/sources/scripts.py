"""Scripts in and out: files, tables, pages' inline scripts, memory; text or tables as results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INLINE = r"(?is)<script\b(?![^>]*\bsrc\s*=)[^>]*>(.*?)</script\s*>"


def from_files(spark: SparkSession, path: str | list[str], pattern: str = "*.js") -> DataFrame:
    """path and source of each whole file; unreadable paths raise."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.decode("content", "UTF-8").alias("source"))


def from_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    """In-memory scripts, numbered."""
    return spark.createDataFrame(list(enumerate(texts)), "script_id long, source string")


def inline_scripts(html: str | Column) -> Column:
    """The array of a page's inline scripts."""
    return F.regexp_extract_all(F.col(html) if isinstance(html, str) else html, F.lit(INLINE), F.lit(1))


def from_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages' own columns without the html, with ordinal and source of each inline script."""
    rest = [c for c in pages.columns if c != html]
    return pages.select(*rest, F.posexplode(inline_scripts(html)).alias("ordinal", "source"))


def to_files(rewrites: DataFrame, path: str, code: str = "code", key: str | None = None) -> None:
    """Text files of JSON lines, one for each script, so that code of many lines comes back whole: see from_lines."""
    columns = [F.col(key).alias("script_id")] if key else []
    rewrites.select(*columns, F.col(code).alias("source")).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def from_lines(spark: SparkSession, path: str, key_type: str | None = None) -> DataFrame:
    """What to_files wrote: source, and script_id if it has a type."""
    return spark.read.schema(", ".join([*([f"script_id {key_type}"] if key_type else []), "source string"])).json(path)


def to_table(rewrites: DataFrame, path: str) -> None:
    rewrites.write.mode("overwrite").parquet(path)
