"""Search-result payloads: parsing, accepted organic results, related questions, shape check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termgap.params import DEFAULT, Params
from termgap.schema import PAYLOADS, SEARCH_PAYLOAD


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Captured payloads as JSON lines."""
    return spark.read.schema(PAYLOADS).json(path)


def payload_error(parsed: Column) -> Column:
    status = F.col("status")
    return (
        F.when(F.col("error_class").isNotNull(), F.concat(F.lit("network: "), F.col("error_class")))
        .when(status >= 400, F.concat(F.lit("http: "), status.cast("string")))
        .when(F.get_json_object("payload", "$").isNull(), "invalid_json")
        .when(parsed.isNull(), "invalid_json")
    )


def _is_object(item: Column) -> Column:
    return F.coalesce(F.get_json_object(item, "$").startswith("{"), F.lit(False))


def _organic_item(item: Column) -> Column:
    return F.struct(
        F.get_json_object(item, "$.position").cast("int").alias("position"),
        F.get_json_object(item, "$.title").alias("title"),
        F.get_json_object(item, "$.link").alias("link"),
    )


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """One row per search: ``organic``, ``questions``, ``error``. A failed search keeps empty lists.

    Items of the organic list that are not objects are skipped; the others stay.

    The question list is chosen by presence, not by emptiness: an empty first list wins over a filled second one.
    """
    parsed = payloads.withColumn("_p", F.from_json("payload", SEARCH_PAYLOAD)).withColumn(
        "error", payload_error(F.col("_p"))
    )
    ok = F.col("error").isNull()
    return parsed.select(
        "query_id",
        "query",
        "language",
        F.when(ok, F.transform(F.filter("_p.organic_results", _is_object), _organic_item)).alias("organic"),
        F.when(ok, F.coalesce("_p.related_questions", "_p.people_also_ask")).alias("questions"),
        "error",
    )


def usable_result(title: Column, link: Column) -> Column:
    return (
        (F.coalesce(title, F.lit("")) != "")
        & (F.coalesce(link, F.lit("")) != "")
        & (link.startswith("http://") | link.startswith("https://"))
    )


def organic_results(searches: DataFrame, limits: DataFrame | None = None, params: Params = DEFAULT) -> DataFrame:
    """The first N accepted results of each search, ranked in result order.

    N comes from ``limits(query_id, num_results)`` when given, else from the parameters. The rank counts accepted
    items only. It is computed within the search's own array, so no shuffle is needed.
    """
    if limits is not None:
        searches = searches.join(limits.select("query_id", "num_results"), "query_id", "left")
        limit = F.coalesce("num_results", F.lit(params.num_results))
    else:
        limit = F.lit(params.num_results)
    accepted = F.filter("organic", lambda item: usable_result(item["title"], item["link"]))
    return (
        searches.withColumn("_accepted", F.slice(F.coalesce(accepted, F.array()), F.lit(1), limit))
        .select("query_id", F.posexplode_outer("_accepted").alias("_pos", "_item"))
        .where(F.col("_item").isNotNull())
        .select(
            "query_id",
            (F.col("_pos") + 1).alias("rank"),
            F.col("_item.title").alias("title"),
            F.col("_item.link").alias("url"),
        )
    )


def related_questions(searches: DataFrame) -> DataFrame:
    """Non-empty questions in list order; items that are not objects are skipped."""
    return (
        searches.select("query_id", F.posexplode_outer("questions").alias("_pos", "_item"))
        .withColumn("question", F.get_json_object("_item", "$.question"))
        .where(F.coalesce("question", F.lit("")) != "")
        .select("query_id", (F.col("_pos") + 1).alias("pos"), "question")
    )


def result_urls(organic: DataFrame) -> DataFrame:
    return organic.where(F.col("url").isNotNull()).select("query_id", "rank", "url")


def first_accepted(results: DataFrame, limit: Column | int, order: str = "pos") -> DataFrame:
    """The same rule for results that arrive as rows: filter, then rank, then keep the first N.

    The rank limit becomes a WindowGroupLimit below the shuffle, so a keyword with very many rows sends at most N of
    them per task.
    """
    ranked = results.where(usable_result(F.col("title"), F.col("url"))).withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order))
    )
    return ranked.where(F.col("rank") <= limit)


def has_search_shape(payload: Column) -> Column:
    """A stored search entry must be an object holding both lists; the older bare list is rejected."""
    return (
        F.get_json_object(payload, "$.organic_results").isNotNull()
        & F.get_json_object(payload, "$.related_questions").isNotNull()
    )


def has_extraction_shape(payload: Column) -> Column:
    """A stored page text must be a list of exactly two elements (text, error)."""
    return F.coalesce(F.json_array_length(payload) == 2, F.lit(False))
