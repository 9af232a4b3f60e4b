"""Top terms missing from the own text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termgap.operators.tokens import page_tokens
from termgap.params import DEFAULT, Params
from termgap.sources.resources import Resources


def reference_tokens(references: DataFrame, resources: Resources, params: Params = DEFAULT) -> DataFrame:
    """``(query_id, ref_tokens, ref_norm)`` for every non-empty own text, preprocessed like a page."""
    as_docs = references.where(F.coalesce("ref_text", F.lit("")) != "").select(
        "query_id", F.lit(0).cast("bigint").alias("doc_ord"), "lang", F.col("ref_text").alias("text")
    )
    return page_tokens(as_docs, resources, params).select(
        "query_id", F.array_distinct("tokens").alias("ref_tokens"), F.array_join("tokens", " ").alias("ref_norm")
    )


def is_missing(term: Column, ref_norm: Column, ref_tokens: Column) -> Column:
    """Neither a substring of the preprocessed text nor made up of its tokens."""
    parts_known = F.forall(F.split(term, " "), lambda part: F.array_contains(ref_tokens, part))
    return ~F.contains(ref_norm, term) & ~parts_known


def missing_terms(top: DataFrame, ref_tokens: DataFrame) -> DataFrame:
    """Top terms absent from the own text, in rank order. Keywords without an own text give no rows."""
    return top.join(ref_tokens, "query_id").where(
        is_missing(F.col("term"), F.col("ref_norm"), F.col("ref_tokens"))
    ).select("query_id", "rank", "term", "score")
