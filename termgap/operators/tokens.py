"""Page preprocessing: words, stop words, lexicon lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgap.functions.text import by_language, keep_lemmas, keep_words, words
from termgap.params import DEFAULT, Params
from termgap.session import lookup_side
from termgap.sources.requests import resource_language
from termgap.sources.resources import KEPT_POS, Resources


def page_tokens(docs: DataFrame, resources: Resources, params: Params = DEFAULT, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(query_id, doc_ord, *carry, tokens, n_tokens)``: the kept words of each page in text order.

    Unknown words keep their own form and count as nouns. With a lexicon given as a short list the whole step is
    row-local; a lexicon table is joined by form, and the words of a page are gathered again.
    """
    keys = ("query_id", "doc_ord", *carry)
    lang = resource_language(F.col("lang"), params)
    found = docs.select(*keys, lang.alias("lang"), words(F.col("text")).alias("_words"))
    if isinstance(resources.lexicon, DataFrame):
        return _joined_tokens(found, keys, resources, params)
    spoken = {
        code: keep_lemmas("_words", listed, resources.lemmas(code, params.min_token_chars), params.min_token_chars)
        for code, listed in resources.stop_words.items()
    }
    plain = keep_words("_words", [], params.min_token_chars)
    kept = by_language(F.col("lang"), spoken, plain)
    return found.withColumn("tokens", kept).select(*keys, "tokens", F.size("tokens").alias("n_tokens"))


def _joined_tokens(found: DataFrame, keys: tuple[str, ...], resources: Resources, params: Params) -> DataFrame:
    spoken = {code: keep_words("_words", listed, 1) for code, listed in resources.stop_words.items()}
    unstopped = found.select(*keys, "lang", by_language(F.col("lang"), spoken, F.col("_words")).alias("_w"))
    placed = unstopped.select(*keys, "lang", F.posexplode_outer("_w").alias("pos", "word"))
    lemma = lemmas(placed, resources.lexicon)
    kept_lemma = F.when(F.length("lemma") >= params.min_token_chars, F.struct("pos", "lemma"))
    return (
        lemma.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(kept_lemma)).alias("_placed"))
        .select(*keys, F.transform("_placed", lambda x: x["lemma"]).alias("tokens"))
        .withColumn("n_tokens", F.size("tokens"))
    )


def lemmas(placed: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Left lookup by (lang, form). ``lemma`` is null where the part of speech is not kept.

    A form listed more than once counts once: as a part of speech that is kept if it has one, then by lemma.
    """
    order = F.struct((~F.coalesce("pos", F.lit("NOUN")).isin(*KEPT_POS)).alias("_dropped"), F.col("lemma").alias("_lemma"), F.col("pos").alias("_pos"))
    entries = lexicon.groupBy("lang", F.col("form").alias("word")).agg(F.min(order).alias("_e")).select("lang", "word", "_e._lemma", "_e._pos")
    kept = F.coalesce("_pos", F.lit("NOUN")).isin(*KEPT_POS)
    return (
        placed.join(lookup_side(entries), ["lang", "word"], "left")
        .withColumn("lemma", F.when(kept, F.lower(F.coalesce("_lemma", "word"))))
        .drop("_lemma", "_pos")
    )


def word_rows(docs: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One row per word: ``(query_id, doc_ord, lang, pos, word)``."""
    found = docs.select("query_id", "doc_ord", resource_language(F.col("lang"), params).alias("lang"), words(F.col("text")).alias("_words"))
    return found.select("query_id", "doc_ord", "lang", F.posexplode_outer("_words").alias("pos", "word")).where(
        F.col("word").isNotNull()
    )


def without_stop_words(rows: DataFrame, stop_words: DataFrame) -> DataFrame:
    """The join form of stop-word removal, for lists kept in a table."""
    return rows.join(lookup_side(stop_words.select("lang", "word")), ["lang", "word"], "left_anti")
