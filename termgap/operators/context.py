"""Data block handed to a writer of recommendations: one row of ready texts per keyword."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termgap.params import DEFAULT, Params

# Texts shown when a part is empty.
NO_TERMS = "Keine gefunden."
NO_MISSING = "Keine (oder kein Referenztext vorhanden)."
NO_CLUSTERS = "Keine Cluster gefunden."
NO_ENTITIES = "Keine relevanten Entitäten gefunden."
NO_SENTIMENT = "N/A."
NO_QUESTIONS = "Keine 'People Also Ask'-Fragen gefunden."
NO_REFERENCE = "Keiner vorhanden."


def two_digits(value: Column) -> Column:
    return F.format_string("%.2f", value)


def _in_order(order: list[str], value: Column, separator: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(*order, value.alias("_v"))))
    return F.array_join(F.transform(rows, lambda r: r["_v"]), separator)


def term_line(top: DataFrame, params: Params = DEFAULT) -> DataFrame:
    shown = F.concat("term", F.lit(" ("), two_digits(F.col("score")), F.lit(")"))
    return top.where(F.col("rank") <= params.context_terms).groupBy("query_id").agg(
        _in_order(["rank"], shown, ", ").alias("top_terms")
    )


def missing_line(missing: DataFrame) -> DataFrame:
    return missing.groupBy("query_id").agg(_in_order(["rank"], F.col("term"), ", ").alias("missing"))


def cluster_lines(terms: DataFrame, params: Params = DEFAULT) -> DataFrame:
    shown = F.when(F.col("rank") <= params.context_cluster_terms, F.struct("rank", "term"))
    per_cluster = terms.groupBy("query_id", "cluster").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda r: r["term"]), ", ").alias("_list"),
        F.when(F.max("rank") > params.context_cluster_terms, "...").otherwise("").alias("_more"),
    )
    line = F.concat(F.lit("  - Cluster "), F.col("cluster").cast("string"), F.lit(": "), F.col("_list"), F.col("_more"))
    return per_cluster.groupBy("query_id").agg(_in_order(["cluster"], line, "\n").alias("clusters"))


def entity_lines(entities: DataFrame, params: Params = DEFAULT) -> DataFrame:
    shown = F.concat("surface", F.lit(" ("), F.col("n").cast("string"), F.lit("x)"))
    per_label = (
        entities.where(F.col("rank") <= params.context_entities)
        .groupBy("query_id", "label")
        .agg(_in_order(["rank"], shown, ", ").alias("_list"))
    )
    line = F.concat(F.lit("  - "), F.col("label"), F.lit(": "), F.col("_list"))
    return per_label.groupBy("query_id").agg(_in_order(["label"], line, "\n").alias("entities"))


def question_lines(questions: DataFrame) -> DataFrame:
    """The questions of one keyword come from one payload, which bounds the list."""
    return questions.groupBy("query_id").agg(
        _in_order(["pos"], F.concat(F.lit("  - "), "question"), "\n").alias("questions")
    )


def reference_excerpt(text: Column, params: Params = DEFAULT) -> Column:
    size = params.context_reference_chars
    quoted = F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)
    return F.when(F.coalesce(text, F.lit("")) == "", NO_REFERENCE).otherwise(F.concat(F.lit("'"), quoted, F.lit("'")))


def recommendation_context(
    requests: DataFrame,
    top: DataFrame,
    missing: DataFrame,
    clusters: DataFrame,
    entities: DataFrame,
    questions: DataFrame,
    sentiment: DataFrame,
    references: DataFrame,
    params: Params = DEFAULT,
) -> DataFrame:
    """One row per request; every part has its text for "nothing found"."""
    joined = requests.select("query_id", "query")
    for part in (
        term_line(top, params),
        missing_line(missing),
        cluster_lines(clusters, params),
        entity_lines(entities, params),
        question_lines(questions),
        sentiment.select("query_id", two_digits(F.col("sentiment")).alias("sentiment")),
        references.select("query_id", reference_excerpt(F.col("ref_text"), params).alias("reference")),
    ):
        joined = joined.join(part, "query_id", "left")
    fallback = {
        "top_terms": NO_TERMS,
        "missing": NO_MISSING,
        "clusters": NO_CLUSTERS,
        "entities": NO_ENTITIES,
        "questions": NO_QUESTIONS,
        "sentiment": NO_SENTIMENT,
        "reference": NO_REFERENCE,
    }
    return joined.select("query_id", "query", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in fallback.items()])
