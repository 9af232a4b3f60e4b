"""Own texts to compare against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termgap.functions.naming import base_name


def read_reference_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per UTF-8 text file: ``reference_name``, ``ref_text`` (null when the file is empty)."""
    texts = spark.read.text(path, wholetext=True).withColumn("_path", F.input_file_name())
    return texts.select(
        base_name(F.col("_path")).alias("reference_name"),
        F.nullif("value", F.lit("")).alias("ref_text"),
    )


def attach_references(requests: DataFrame, references: DataFrame) -> DataFrame:
    """Requests with their own text, if any. An empty text counts as none."""
    own = references.select("query_id", F.nullif("ref_text", F.lit("")).alias("ref_text"))
    return requests.join(own, "query_id", "left").withColumn("has_reference", F.col("ref_text").isNotNull())
