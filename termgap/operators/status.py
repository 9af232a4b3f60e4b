"""Which stage a keyword got to, and its counts. Keywords without any row stay visible."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termgap.params import DEFAULT, Params


def page_counts(attached: DataFrame) -> DataFrame:
    """``(query_id, n_results, n_processed, n_failed)``."""
    ok = F.col("error_code").isNull() & (F.coalesce("text", F.lit("")) != "")
    return attached.groupBy("query_id").agg(
        F.count("*").alias("n_results"), F.count_if(ok).alias("n_processed"), F.count_if(~ok).alias("n_failed")
    )


def joined_reasons(failed: DataFrame) -> DataFrame:
    """``url: reason; …`` in rank order. A keyword has at most as many failures as it has accepted results (100)."""
    return failed.groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "url", "reason"))),
                lambda f: F.concat(f["url"], F.lit(": "), f["reason"]),
            ),
            "; ",
        ).alias("error_detail")
    )


def run_status(
    requests: DataFrame, searches: DataFrame, counts: DataFrame, usable: DataFrame, vocab: DataFrame
) -> DataFrame:
    """First failing stage per request, null when all stages gave rows; ``success`` follows from it."""
    errors = searches.select("query_id", F.col("error").alias("search_error"))
    features = vocab.groupBy("query_id").agg(F.count("*").alias("n_features"))
    joined = (
        requests.join(errors, "query_id", "left")
        .join(counts, "query_id", "left")
        .join(usable, "query_id", "left")
        .join(features, "query_id", "left")
    )

    def none(name: str):
        return F.coalesce(name, F.lit(0)) == 0

    return joined.withColumn(
        "error",
        F.when(F.col("search_error").isNotNull(), "search_failed")
        .when(none("n_results"), "no_results")
        .when(none("n_processed"), "no_texts")
        .when(none("n_pages"), "no_usable_texts")
        .when(none("n_features"), "no_features"),
    ).withColumn("success", F.col("error").isNull())


def enabled(rows: DataFrame, requests: DataFrame, flag: str) -> DataFrame:
    """Rows of the keywords that asked for an optional stage; the others cost nothing.

    Rows that carry the flag themselves need no join, which keeps page texts out of a shuffle.
    """
    if flag in rows.columns:
        return rows.where(F.col(flag))
    return rows.join(requests.where(F.col(flag)).select("query_id"), "query_id", "left_semi")


def failed_preview(failed: DataFrame, params: Params = DEFAULT) -> DataFrame:
    first = Window.partitionBy("query_id").orderBy("rank", "url")
    return failed.withColumn("ord", F.row_number().over(first)).where(F.col("ord") <= params.failed_preview)
