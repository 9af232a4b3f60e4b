"""Token counts with a digest cache: only texts never counted before are encoded."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termgap.llm.bpe import encoder, slices
from termgap.llm.common import exists, keep, shown_id, texts

CACHE = "tokenizer string, digest binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def stored_counts(spark: SparkSession, cache_path: str, tokenizer: str) -> DataFrame:
    """Counts kept for one tokenizer version, one row per digest (writers that ran at once may both have added it)."""
    rows = spark.read.schema(CACHE).parquet(cache_path) if exists(spark, cache_path) else spark.createDataFrame([], CACHE)
    return rows.filter(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache_path: str, tokenizer_path: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row of `docs`; new counts are appended to the cache.

    The content digest is SHA-256 of the text as UTF-8, null normalised to empty: a byte-level tokenizer gives other
    ids for any other change, so nothing more may be normalised. The version digest is SHA-256 of the tokenizer's file.
    One text per digest and map task is shuffled (partial aggregation), so a text with a third of all rows costs as many
    rows as there are tasks. The append commits as a whole; a job that failed leaves the cache as it was.

    Null ids stay null; null and empty texts have 0 bytes and 0 tokens; repeated rows are counted once and returned
    each; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    rows = texts(docs).withColumn("digest", F.unhex(F.sha2("text", 256)))
    known = stored_counts(spark, cache_path, version)
    misses = rows.groupBy("digest").agg(F.first("text").alias("text")).join(known.select("digest"), "digest", "left_anti")

    def count(batches):
        bpe = encoder(tokenizer_path)
        for batch in batches:
            n = []
            for _, part in slices(batch.column("text")):
                n += [len(x) // 4 for x in bpe.encode(part)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    counted = misses.mapInArrow(count, "digest binary, n_tokens long")
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    # written, so that the join sees two plain exchanges and a text with many copies can be split between tasks
    stored = keep(stored_counts(spark, cache_path, version), "token-counts")
    sized = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return sized.join(stored, "digest").select(shown_id(), "n_bytes", "n_tokens")
