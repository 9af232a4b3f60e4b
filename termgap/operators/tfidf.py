"""TF-IDF over one- and two-word terms, grouped by keyword.

Term counts come out of the scan stage already aggregated per page. Document frequencies are partially aggregated per
task before they meet. A capped vocabulary needs only terms that can get into it: a first pass counts words, and pages
then count the terms made of words as frequent as the last place asks for. The capped vocabulary of a keyword is one row with a hash table of its terms; a page meets it by
``query_id`` and prunes, weights and ranks its terms inside the row, so terms of pages are never rows of a shuffle. A very
large keyword is a skewed join of page rows, which AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termgap.functions.lookup import bind
from termgap.functions.text import with_listed_counts, with_previous_terms, with_term_counts
from termgap.params import DEFAULT, Params
from termgap.session import Staging, lookup_side

PAGE_MARK = ""
#: Slots of a keyword's hash table; a vocabulary has fewer entries, so a slot holds one or two.
SLOTS = 256
#: At most so many for a keyword's frequent words, and how many of them may be listed in a row; beyond that its pages count all terms.
WORD_SLOTS, MAX_LISTED_WORDS = 1024, 4096


def page_terms(tokens: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per page: ``terms`` as an array of (term, tf), empty for pages with too few tokens."""
    return with_term_counts(tokens, params.min_page_tokens)


def frequent_words(tokens: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """``(query_id, word_slots)``: a hash table of the words that terms of the capped vocabulary can be made of.

    A pair of words occurs at most as often as either word. So a term as frequent as the last of the first
    ``max_features`` words that are surely on ``min_df`` pages has only words as frequent as that. Null where this does not
    bound a term (a token of several words may be written like a pair) or leaves too many words: such pages count all terms.
    """
    usable = F.when(F.size("tokens") >= params.min_page_tokens, F.col("tokens"))
    rows = tokens.select("query_id", "doc_ord", F.explode_outer(usable).alias("word")).where(F.col("word").isNotNull())
    counted = rows.groupBy("query_id", "word").agg(F.count("*").alias("ctf"), F.min("doc_ord").alias("_first"), F.max("doc_ord").alias("_last"))
    sure = F.coalesce(F.col("_first") != F.col("_last"), F.lit(False)) if params.min_df == 2 else F.lit(params.min_df < 2)
    several = F.contains("word", F.lit(" "))
    by_count = Window.partitionBy("query_id").orderBy(F.desc(several), F.desc("ctf"))
    listed = (
        counted.where((F.col("ctf") >= params.min_df) | several)
        .select("query_id", "word", "ctf", sure.alias("sure"), several.alias("several"), F.row_number().over(by_count).alias("_nth"))
        .where(F.col("_nth") <= MAX_LISTED_WORDS + 1)
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("ctf", "word", "sure")), asc=False).alias("_w"), F.bool_or("several").alias("_several"))
    )
    place = F.get(F.filter("_w", lambda w: w["sure"]), F.lit(params.max_features - 1))["ctf"]
    least = listed.withColumn("_least", F.greatest(F.coalesce(place, F.lit(params.min_df)), F.lit(params.min_df)))
    whole = (F.size("_w") <= MAX_LISTED_WORDS) | (F.element_at("_w", -1)["ctf"] < F.col("_least"))
    names = F.transform(F.filter("_w", lambda w: w["ctf"] >= F.col("_least")), lambda w: w["word"])
    size = lambda v: F.greatest(F.lit(1), F.least(F.lit(WORD_SLOTS), 4 * F.size(v)))
    slots = bind(names, lambda v: F.transform(F.sequence(F.lit(0), size(v) - 1), lambda s: F.filter(v, lambda w: _slot(w, size(v)) == s)))
    return least.select("query_id", F.when(whole & ~F.col("_several"), slots).alias("word_slots"))


def frequent_terms(tokens: DataFrame, staging: Staging, params: Params = DEFAULT) -> DataFrame:
    """Like ``page_terms``, without terms that cannot be in the capped vocabulary.

    The tokens are staged, so texts are read and tokenised once; then the frequent words are counted and staged.
    """
    tokens = staging.keep(tokens, "tokens")
    words = staging.keep(frequent_words(tokens, params), "frequent_words").withColumnRenamed("query_id", "_keyword")
    joined = tokens.join(lookup_side(words), F.col("query_id").eqNullSafe(F.col("_keyword")), "left").drop("_keyword")
    known = lambda w: F.col("word_slots").isNull() | F.array_contains(F.get("word_slots", _slot(w, F.size("word_slots"))), w)
    return with_listed_counts(joined, known, params.min_page_tokens).drop("word_slots")


def term_counts(pages: DataFrame) -> DataFrame:
    """``(query_id, doc_ord, term, tf)``. The outer form keeps Catalyst from pushing a size filter under the tokeniser."""
    return pages.select("query_id", "doc_ord", F.inline_outer("terms")).where(F.col("term").isNotNull())


def usable_counts(pages: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Usable pages per keyword, counted from the pages, so pages without any kept term still count."""
    return pages.groupBy("query_id").agg(F.count_if(F.col("n_tokens") >= params.min_page_tokens).alias("n_pages"))


def term_frequency(pages: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """``(query_id, term, df, ctf)``: pages and total count per term, terms on fewer than ``min_df`` pages dropped.

    Every page with terms also counts once under the empty term, so the number of usable pages comes out of the same
    aggregation as the document frequencies: the texts are tokenised once and nothing is joined.
    """
    page_mark = F.array(F.struct(F.lit(PAGE_MARK).alias("term"), F.lit(1).cast("bigint").alias("tf")))
    marked = pages.select("query_id", F.inline_outer(F.concat(page_mark, "terms")))
    return (
        marked.where(F.col("term").isNotNull())
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))
        .where((F.col("term") == PAGE_MARK) | (F.col("df") >= params.min_df))
    )


def every_frequency(tokens: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """``term_frequency`` of all terms, counted from the tokens without the empty term.

    A page's terms are sorted, and each comes as a row with the one before it: a page counts at the first of equal terms.
    Rows are compared in compiled code, which a function over an array is not.
    """
    return (
        with_previous_terms(tokens, params.min_page_tokens)
        .groupBy("query_id", "term")
        .agg(F.count_if(~F.col("term").eqNullSafe(F.col("previous"))).alias("df"), F.count("*").alias("ctf"))
        .where(F.col("df") >= params.min_df)
    )


def vocabulary(pages: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """``(query_id, term, df, ctf, vocab_rank, idf)``: the ``max_features`` most frequent terms, with smoothed idf.

    The empty term is ranked first and leaves again once its count has been read.
    """
    is_mark = F.col("term") == PAGE_MARK
    by_count = Window.partitionBy("query_id").orderBy(F.desc(is_mark), F.desc("ctf"), "term")
    keyword = Window.partitionBy("query_id")
    return (
        # the limit is on the bare row number: only then does each task keep no more rows of a keyword than that
        term_frequency(pages, params).withColumn("_nth", F.row_number().over(by_count))
        .where(F.col("_nth") <= params.max_features + 1)
        .withColumn("vocab_rank", F.col("_nth") - 1)
        .withColumn("_pages", F.max(F.when(is_mark, F.col("df"))).over(keyword))
        .where(~is_mark)
        .withColumn("idf", F.log((1 + F.col("_pages")) / (1 + F.col("df"))) + 1)
        .drop("_pages", "_nth")
    )


def _slot(term: Column, slots: Column | int = SLOTS) -> Column:
    return F.pmod(F.hash(term), slots if isinstance(slots, Column) else F.lit(slots))


def vocabulary_rows(vocab: DataFrame) -> DataFrame:
    """``(query_id, names, slots)``: the terms of a keyword in order, and a hash table of (term, ix, idf, df)."""
    listed = vocab.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "idf", "df"))).alias("_v"))
    numbered = F.transform("_v", lambda v, i: F.struct(v["term"].alias("term"), i.alias("ix"), v["idf"].alias("idf"), v["df"].alias("df"), _slot(v["term"]).alias("slot")))
    slots = bind(numbered, lambda v: F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: F.filter(v, lambda e: e["slot"] == s)))
    return listed.select("query_id", F.transform("_v", lambda v: v["term"]).alias("names"), slots.alias("slots"))


def _kept(terms: Column, slots: Column) -> Column:
    """(term, tf, e) of a page's terms that the vocabulary has, e being its entry."""
    entry = lambda term: F.get(F.filter(F.get(slots, _slot(term)), lambda e: e["term"] == term), F.lit(0))
    return F.filter(F.transform(terms, lambda x: F.struct(x["term"].alias("term"), x["tf"].alias("tf"), entry(x["term"]).alias("e"))), lambda y: y["e"].isNotNull())


def kept_counts(pages: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(query_id, doc_ord, term, tf, df)`` of the terms in the vocabulary."""
    joined = pages.join(lookup_side(vocabulary_rows(vocab)), "query_id")
    rows = joined.select("query_id", "doc_ord", F.inline(_kept(F.col("terms"), F.col("slots"))))
    return rows.select("query_id", "doc_ord", "term", "tf", "e.df")


def page_scores(pages: DataFrame, vocab: DataFrame) -> DataFrame:
    """The pages with ``scores`` in place of their terms: (ix, term, tf, score) in term order, scaled to unit length.

    ix is the term's place in the keyword's vocabulary in term order. Pages without any kept term have none. Stage
    ``vocab`` first if you can: a written table has an exact size, so it is broadcast whenever it is small.
    """

    def scaled(kept: Column) -> Column:
        weight = lambda y: y["tf"] * y["e"]["idf"]
        norm = F.sqrt(F.aggregate(kept, F.lit(0.0), lambda total, y: total + weight(y) * weight(y)))
        score = lambda n: F.transform(kept, lambda y: F.struct(y["e"]["ix"].alias("ix"), y["term"].alias("term"), y["tf"].alias("tf"), (weight(y) / n).alias("score")))
        return bind(norm, score)

    joined = pages.join(lookup_side(vocabulary_rows(vocab).select("query_id", "slots")), "query_id", "left")
    none = F.array().cast("array<struct<ix:int,term:string,tf:bigint,score:double>>")
    scores = F.coalesce(bind(_kept(F.col("terms"), F.col("slots")), scaled), none).alias("scores")
    return joined.select(*[c for c in pages.columns if c != "terms"], scores)


def score_rows(scored: DataFrame) -> DataFrame:
    """A row for each kept term of each page."""
    return scored.select("query_id", "doc_ord", *[c for c in ("url",) if c in scored.columns], F.inline("scores")).drop("ix")


def tfidf(pages: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(query_id, doc_ord, term, tf, score)``."""
    return score_rows(page_scores(pages, vocab))


def page_top_terms(scored: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Best terms of each page above the score threshold; ties at nine decimals go by term."""
    ordered = F.array_sort(F.transform("scores", lambda s: F.struct((-F.round(s["score"], 9)).alias("o"), s["term"].alias("term"), s["score"].alias("score"))))
    best = F.posexplode(F.slice(ordered, 1, params.page_terms)).alias("_pos", "_t")
    keys = ["query_id", "doc_ord", *[c for c in ("url",) if c in scored.columns]]
    rows = scored.select(*keys, best).select(*keys, (F.col("_pos") + 1).alias("rank"), "_t.term", "_t.score")
    return rows.where(F.col("score") > params.min_score)


def term_means(page_top: DataFrame) -> DataFrame:
    """Mean score of a term over the pages whose top terms hold it, not over all pages."""
    return page_top.groupBy("query_id", "term").agg(F.avg("score").alias("score"), F.count("*").alias("pages"))


def top_terms(means: DataFrame, params: Params = DEFAULT) -> DataFrame:
    by_score = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "term")
    return means.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= params.top_terms)


def cloud_weights(top: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Word-cloud weights: word counts over the top-term strings, scaled to the largest count of the keyword."""
    counted = (
        top.where(F.col("rank") <= params.cloud_terms)
        .select("query_id", F.explode(F.split("term", " ")).alias("word"))
        .groupBy("query_id", "word")
        .agg(F.count("*").alias("n"))
    )
    return counted.withColumn("weight", F.col("n") / F.max("n").over(Window.partitionBy("query_id")))
