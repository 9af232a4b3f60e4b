"""Analysis requests: validation, defaults, language fallback, manifest for the crawler."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termgap.params import DEFAULT, Params


def validate_requests(raw: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Add ``reject_reason`` (null when accepted); the first broken rule is reported.

    Reads ``query``, ``language``, ``num_results_raw`` and ``reference_name``, all strings. A missing count or language
    is not an error: the default fills it.
    """
    count = F.btrim(F.col("num_results_raw")).try_cast("int")
    asked = F.col("num_results_raw").isNotNull()
    in_range = F.coalesce(count.between(1, params.max_results), F.lit(False))
    name = F.coalesce("reference_name", F.lit(""))
    return raw.withColumn(
        "reject_reason",
        F.when(F.btrim(F.coalesce("query", F.lit(""))) == "", "empty_keyword")
        .when(asked & ~in_range, "bad_num_results")
        .when(F.col("language").isNotNull() & ~F.col("language").isin(*params.languages), "unknown_language")
        .when((name != "") & ~F.endswith(F.lower(name), F.lit(".txt")), "reference_not_txt"),
    )


def with_defaults(raw: DataFrame, params: Params = DEFAULT) -> DataFrame:
    return raw.select(
        "*",
        F.coalesce("language", F.lit(params.default_language)).alias("language_effective"),
        F.coalesce(F.btrim(F.col("num_results_raw")).try_cast("int"), F.lit(params.num_results)).alias(
            "num_results_effective"
        ),
    )


def resource_language(language: Column, params: Params = DEFAULT) -> Column:
    """The language whose resources serve a request; anything unknown falls back to the default."""
    return F.when(language.isin(*params.languages), language).otherwise(F.lit(params.default_language))


def search_manifest(requests: DataFrame) -> DataFrame:
    """What an external crawler must ask the search service for each request."""
    lang = F.col("language")
    return requests.select(
        "query_id",
        F.col("query").alias("q"),
        (F.col("num_results") * 2).alias("num"),
        lang.alias("hl"),
        F.when(F.length(lang) == 2, F.upper(lang)).otherwise("DE").alias("gl"),
        F.concat(F.lit("lang_"), lang).alias("lr"),
    )


def accept_requests(raw: DataFrame, params: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Accepted requests with defaults filled in, and rejected ones with their ``reject_reason``."""
    checked = with_defaults(validate_requests(raw, params), params)
    filled = checked.withColumn("language", F.col("language_effective")).withColumn("num_results", F.col("num_results_effective"))
    kept = ["query_id", "query", "language", "num_results", "ner", "cluster", "sentiment"]
    return filled.where(F.col("reject_reason").isNull()).select(*kept), filled.where(F.col("reject_reason").isNotNull()).select(*kept, "reject_reason")
