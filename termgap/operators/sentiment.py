"""Lexicon sentiment per page and per keyword."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termgap.functions.lookup import HashTable, bind
from termgap.functions.text import by_language, words
from termgap.params import DEFAULT, Params
from termgap.session import lookup_side
from termgap.sources.requests import resource_language


def _modified(lang: Column, modifiers: list[tuple[str, str, float]], before: int) -> Column:
    """The array ``_words`` as (word, factor): the product of the modifiers among the words before each, one without any."""
    one = F.lit(1.0)

    def listed(code: str) -> Column:
        table = HashTable({word: repr(float(f)) for of, word, f in modifiers if of == code})
        return F.transform("_words", lambda w: F.coalesce(table.get(w).cast("double"), one))

    factors = by_language(lang, {code: listed(code) for code in {m[0] for m in modifiers}}, F.transform("_words", lambda w: one))

    def product(f: Column) -> Column:
        def row(w: Column, i: Column) -> Column:
            found = one
            for k in range(1, before + 1):
                found = found * F.when(i >= k, F.get(f, i - k)).otherwise(one)
            return F.struct(w.alias("word"), found.alias("factor"))

        return F.transform("_words", row)

    return bind(factors, product)


def page_sentiment(
    docs: DataFrame, polarity: DataFrame, params: Params = DEFAULT, modifiers: list[tuple[str, str, float]] | None = None
) -> DataFrame:
    """``(query_id, doc_ord, url, counted, sentiment)``: mean polarity of the known words, 0.0 when there is none.

    One scan and one shuffle: unknown words pass the left lookup as nulls and the partial average folds a page to one
    row before it leaves its task.

    ``modifiers`` (lang, word, factor), once each, change the polarity of a word that follows within
    ``params.modifier_words`` words: negations turn it, others raise or lower it, several are multiplied, and the result is held
    between -1 and 1. Sentence ends are not looked at. They are looked up inside the page row, without a shuffle.
    """
    found = docs.select(
        "query_id",
        "doc_ord",
        "url",
        resource_language(F.col("lang"), params).alias("lang"),
        (F.coalesce(F.length("text"), F.lit(0)) >= params.min_sentiment_chars).alias("counted"),
        words(F.col("text")).alias("_words"),
    )
    keys = ("query_id", "doc_ord", "url", "lang", "counted")
    value = F.col("polarity")
    if modifiers:
        rows = found.select(*keys, F.inline_outer(_modified(F.col("lang"), modifiers, params.modifier_words)))
        value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value * F.col("factor")))
        value = F.when(F.col("polarity").isNotNull(), value)
    else:
        rows = found.select(*keys, F.explode_outer("_words").alias("word"))
    scored = rows.join(lookup_side(polarity.select("lang", "word", "polarity")), ["lang", "word"], "left")
    return (
        scored.groupBy("query_id", "doc_ord", "url", "counted")
        .agg(F.avg(value).alias("_mean"))
        .select(
            "query_id",
            "doc_ord",
            "url",
            "counted",
            F.when(F.col("counted"), F.coalesce("_mean", F.lit(0.0))).otherwise(0.0).alias("sentiment"),
        )
    )


def overall_sentiment(pages: DataFrame) -> DataFrame:
    """Mean over the pages long enough to count, 0.0 when there is none."""
    return pages.groupBy("query_id").agg(
        F.coalesce(F.avg(F.when(F.col("counted"), F.col("sentiment"))), F.lit(0.0)).alias("sentiment")
    )
