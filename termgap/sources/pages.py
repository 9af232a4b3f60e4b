"""Crawled pages: outcome classification, text extraction, split into usable pages and failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termgap.functions.charset import decode_body
from termgap.functions.html import main_text
from termgap.params import DEFAULT, Params
from termgap.schema import CRAWL
from termgap.session import lookup_side


def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CRAWL).parquet(path)


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """Saved page files, one row per file, as successful answers without a header. The path is the URL."""
    files = spark.read.format("binaryFile").load(path)
    return decode_bodies(files.select(
        F.col("path").alias("url"), F.lit(200).alias("status"), F.lit("OK").alias("reason"), F.lit("text/html").alias("content_type"),
        F.lit(None).cast("string").alias("error_class"), F.col("content").alias("body"),
    ))


def decode_bodies(crawl: DataFrame) -> DataFrame:
    """A crawl whose bodies are bytes, with the bodies as text."""
    return crawl.withColumn("body", decode_body(F.col("body"), F.col("content_type")))


def is_html(content_type: Column) -> Column:
    return F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("html"))


def classify(crawl: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Extract the text of every page and name the first thing that went wrong.

    Adds ``text`` (null on failure), ``error_code`` and ``error_detail`` (null on success). Extraction runs only for
    bodies that could be read.
    """
    status, body = F.col("status"), F.col("body")
    readable = (
        F.col("error_class").isNull()
        & status.between(200, 399)
        & is_html(F.col("content_type"))
        & (F.coalesce(body, F.lit("")) != "")
    )
    out = crawl.withColumn("_text", F.when(readable, main_text(body))).withColumn("_chars", F.length("_text"))
    code = (
        F.when(F.col("error_class").isin("Timeout", "ConnectionError", "ChunkedEncodingError"), "network_retries")
        .when(status.between(400, 499), "http_client")
        .when(status >= 500, "http_server")
        .when(F.col("error_class").isNotNull() | status.isNull() | ~status.between(200, 399), "network")
        .when(~is_html(F.col("content_type")), "not_html")
        .when(F.coalesce(body, F.lit("")) == "", "empty_body")
        .when(F.col("_text").isNull(), "parser_failed")
        .when(F.col("_chars") == 0, "no_main_text")
        .when(F.col("_chars") < params.min_chars, "too_short")
    )
    detail = (
        F.when(F.col("error_code").isin("network_retries", "network"), F.coalesce("error_class", F.lit("N/A")))
        .when(
            F.col("error_code").isin("http_client", "http_server"),
            F.concat(status.cast("string"), F.lit(" ("), F.coalesce("reason", F.lit("N/A")), F.lit(")")),
        )
        .when(F.col("error_code") == "not_html", F.lower(F.coalesce("content_type", F.lit(""))))
        .when(
            F.col("error_code") == "too_short",
            F.concat(F.col("_chars").cast("string"), F.lit("/"), F.lit(str(params.min_chars))),
        )
    )
    return (
        out.withColumn("error_code", code)
        .withColumn("error_detail", detail)
        .withColumn("text", F.when(F.col("error_code").isNull(), F.col("_text")))
        .drop("_text", "_chars")
    )


def one_per_url(classified: DataFrame) -> DataFrame:
    """One outcome for each URL: with a text if one of its rows has one, then the smallest text.

    URLs crawled once, nearly all, pass as they are; texts are compared only for the others.
    """
    again = classified.groupBy("url").count().where("count > 1").select("url")
    least = F.min(F.struct(F.col("error_code").isNotNull().alias("_bad"), "error_code", "error_detail", "text"))
    columns = ["url", "text", "error_code", "error_detail"]
    several = classified.join(lookup_side(again), "url", "left_semi").groupBy("url").agg(least.alias("_o"))
    once = classified.join(lookup_side(again), "url", "left_anti").select(*columns)
    return once.unionByName(several.select("url", "_o.text", "_o.error_code", "_o.error_detail"))


def attach_pages(results: DataFrame, classified: DataFrame) -> DataFrame:
    """Join result URLs to their page outcome; a URL nobody crawled fails as ``not_crawled``.

    Stage ``classified`` first if its extraction is costly: it is read three times.
    """
    outcome = one_per_url(classified).withColumn("_seen", F.lit(True))
    return (
        results.join(outcome, "url", "left")
        .withColumn("error_code", F.when(F.col("_seen").isNull(), "not_crawled").otherwise(F.col("error_code")))
        .drop("_seen")
    )


def failure_reason(code: Column, detail: Column) -> Column:
    return F.when(detail.isNull(), code).otherwise(F.concat(code, F.lit(": "), detail))


def valid_pages(attached: DataFrame) -> DataFrame:
    return attached.where(F.col("error_code").isNull() & (F.coalesce("text", F.lit("")) != ""))


def failed_pages(attached: DataFrame) -> DataFrame:
    """Every result that gave no text, with its reason. Together with ``valid_pages`` it covers all results."""
    code = F.coalesce("error_code", F.when(F.coalesce("text", F.lit("")) == "", "no_text"))
    return (
        attached.withColumn("error_code", code)
        .where(F.col("error_code").isNotNull())
        .select("query_id", "rank", "url", failure_reason(F.col("error_code"), F.col("error_detail")).alias("reason"))
    )
