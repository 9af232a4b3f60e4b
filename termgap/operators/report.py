"""Report rows, summary rows, and the wide term table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgap.functions.lookup import bind
from termgap.functions.naming import short_url
from termgap.operators.tfidf import vocabulary_rows
from termgap.params import DEFAULT, Params
from termgap.session import lookup_side

COLUMNS = ("query_id", "section", "ord", "sub", "label", "value")


def section(rows: DataFrame, name: str, ord_, sub, label, value) -> DataFrame:
    return rows.select(
        "query_id",
        F.lit(name).alias("section"),
        ord_.cast("bigint").alias("ord"),
        sub.cast("bigint").alias("sub"),
        label.cast("string").alias("label"),
        value.cast("string").alias("value"),
    )


def report_rows(parts: dict[str, DataFrame], params: Params = DEFAULT) -> DataFrame:
    """All report sections as rows ordered by (ord, sub) within a section. Missing parts are left out.

    Values stay unformatted numbers cast to text at six decimals; use ``display_rows`` for the shown form.
    """
    col, lit = F.col, F.lit
    zero = lit(0)
    url = short_url(col("url"), params.display_url_chars)

    def number(c):
        return F.round(c, 6)

    builders = {
        "cloud": lambda d: section(d, "cloud", zero, zero, col("word"), number(col("weight"))),
        "top_terms": lambda d: section(d, "top_terms", col("rank"), zero, col("term"), number(col("score"))),
        "missing": lambda d: section(d, "missing", col("rank"), zero, col("term"), lit(None)),
        "entities": lambda d: section(d, "entities", col("rank"), zero, F.concat_ws(": ", "label", "surface"), col("n")),
        "clusters": lambda d: section(d, "clusters", col("cluster"), col("rank"), col("term"), lit(None)),
        "overall_sentiment": lambda d: section(d, "overall_sentiment", zero, zero, lit(None), number(col("sentiment"))),
        "sentiment": lambda d: section(d, "sentiment", col("doc_ord"), zero, url, number(col("sentiment"))),
        "questions": lambda d: section(d, "questions", col("pos"), zero, col("question"), lit(None)),
        "page_terms": lambda d: section(d, "page_terms", col("doc_ord"), col("rank"), url, col("term")),
        "context": lambda d: section(
            d.select("query_id", F.explode(F.create_map(*[x for c in d.columns[2:] for x in (lit(c), col(c))])).alias("part", "text")),
            "context", zero, zero, col("part"), col("text"),
        ),
        "failed": lambda d: section(d, "failed", col("rank"), zero, url, col("reason")),
    }
    chosen = [builders[name](df) for name, df in parts.items() if name in builders]
    return reduce(DataFrame.unionByName, chosen)


def display_score(score):
    return F.format_string("%.3f", score)


def display_sentiment(sentiment):
    return F.when(sentiment.isNull(), "N/A").otherwise(F.format_string("%.2f", sentiment))


def summary_rows(
    status: DataFrame, top: DataFrame, missing: DataFrame, entities: DataFrame, clusters: DataFrame,
    sentiment: DataFrame, questions: DataFrame,
) -> DataFrame:
    """One nested row per keyword with every list that is bounded per keyword.

    Lists that grow with the number of pages (terms, tone and failures per page) are rows of their own, see
    ``page_summary_rows``: gathering them here would put a very large keyword into one row.
    """

    def ordered(df, name, order, *fields):
        return df.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias(name))

    per_label = entities.groupBy("query_id", "label").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "surface", "n"))),
            lambda e: F.struct(e["surface"].alias("entity"), e["n"].alias("count")),
        ).alias("_list")
    )
    per_cluster = clusters.groupBy("query_id", "cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda t: t["term"]).alias("_list")
    )
    out = status
    for part in (
        ordered(top, "overall_top_terms_with_scores", "rank", "term", "score"),
        ordered(missing, "missing_terms", "rank", "term"),
        per_label.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "_list"))).alias("overall_entities")),
        per_cluster.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cluster", "_list")))).alias("clusters")),
        sentiment.select("query_id", F.col("sentiment").alias("overall_sentiment")),
        ordered(questions, "related_questions", "pos", "question"),
    ):
        out = out.join(part, "query_id", "left")
    return out


def page_summary_rows(page_top: DataFrame, sentiment: DataFrame, failed: DataFrame) -> DataFrame:
    """Page-level parts of the summary: ``(query_id, part, ord, url, payload)`` with a JSON payload per page."""
    terms = page_top.groupBy("query_id", "doc_ord", "url").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda t: t["term"])).alias("payload")
    )
    parts = [
        terms.select("query_id", F.lit("top_terms_by_url").alias("part"), F.col("doc_ord").alias("ord"), "url", "payload"),
        sentiment.select(
            "query_id", F.lit("sentiment_by_url").alias("part"), F.col("doc_ord").alias("ord"), "url",
            F.col("sentiment").cast("string").alias("payload"),
        ),
        failed.select(
            "query_id", F.lit("failed_urls").alias("part"), F.col("rank").cast("bigint").alias("ord"), "url",
            F.col("reason").alias("payload"),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def term_tables(scored: DataFrame, vocab: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """``(query_id, doc_ord, page, names, weights)``: the wide term table of every keyword.

    names are all kept terms of the keyword in order, weights their scores on the page, zero where it lacks them. Both
    are positional, so keywords with different terms share one schema. Every usable page has a row.
    """
    usable = scored.where(F.col("n_tokens") >= params.min_page_tokens)
    names = vocabulary_rows(vocab).select("query_id", "names")
    weight = lambda at: lambda _, i: F.coalesce(F.get("scores", F.array_position(at, i).cast("int") - 1)["score"], F.lit(0.0))
    dense = bind(F.transform("scores", lambda s: s["ix"]), lambda at: F.transform("names", weight(at)))
    return usable.join(lookup_side(names), "query_id").select("query_id", "doc_ord", F.col("url").alias("page"), "names", dense.alias("weights"))


def records(df: DataFrame) -> DataFrame:
    """Each row as one JSON record."""
    return df.select(F.to_json(F.struct("*")).alias("record"))
