"""Reading saved pages and crawl responses, and writing envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.functions.charsets import decode_body, inflate
from pagegrain.operators.responses import check_body_len, header_value

SPREAD_SPLITS = 32
HEADERS = "array<struct<name:string,value:string>>"


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Saved pages as (url, body or html, status, headers). Local files have no status and no headers.

    fmt: parquet, json, orc, csv (columns url, html and any others), binary (files of any kind) or text (one file a row).
    """
    if fmt == "binary":
        df = spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), F.col("content").alias("body"))
        return without_response(df)
    if fmt == "text":
        return without_response(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html")))
    if fmt not in ("parquet", "json", "orc", "csv"):
        raise ValueError(f"unknown format: {fmt}")
    reader = spark.read.format(fmt)
    return without_response((reader.option("header", True).option("multiLine", True) if fmt == "csv" else reader).load(path))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it comes in fewer splits than there are, and in ``SPREAD_SPLITS`` at most; else as it is.

    A split is 128 MB at most by Spark's default, so only a table of a few GB is ever dealt, on however many cores.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores) if splits < min(cores, SPREAD_SPLITS + 1) else df


def without_response(df: DataFrame) -> DataFrame:
    """Adds a null status and no headers where a table has none."""
    if "status" not in df.columns:
        df = df.withColumn("status", F.lit(None).cast("int"))
    return df if "headers" in df.columns else df.withColumn("headers", F.array().cast(HEADERS))


def decode_responses(df: DataFrame) -> DataFrame:
    """Raw bodies to text: over-long ones are errors, codings are taken off, charsets resolved. Adds html, charset and error."""
    df = check_body_len(df)
    df = df.withColumn("_plain", inflate(F.when(F.col("error").isNull(), F.col("body")), header_value(F.col("headers"), "content-encoding")))
    broken = F.when(F.col("_plain.error").isNotNull(), F.struct(F.lit("fetch.body").alias("kind"), F.col("_plain.error").alias("message")))
    df = df.withColumn("_text", decode_body(F.col("_plain.body"), header_value(F.col("headers"), "content-type")))
    return df.withColumns({"error": F.coalesce("error", broken), "html": F.col("_text.body"), "charset": F.col("_text.charset")}).drop("_plain", "_text", "body")


def write_envelopes(df: DataFrame, path: str) -> None:
    """One JSON line a row, from the column ``envelope``."""
    df.select("envelope").write.text(path)
