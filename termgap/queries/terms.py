"""TF-IDF, rankings, gap and word cloud over the documents, one keyword per source."""

from __future__ import annotations

from pyspark.sql import functions as F

from termgap.functions import text
from termgap.operators import gap, report, tfidf
from termgap.operators.tokens import page_tokens
from termgap.plans.analysis import term_gap
from termgap.queries import tables as t
from termgap.queries.fixtures import resources
from termgap.queries.registry import query
from termgap.queries.sql import with_
from termgap.session import Staging
from termgap.sinks import writers


def tokens(spark, sf, carry=()):
    return page_tokens(t.docs(spark, sf), resources(spark), carry=carry)


def pages(spark, sf, carry=()):
    return tfidf.page_terms(tokens(spark, sf, carry))


def frequent(spark, sf, carry=()):
    """Pages with the terms that can be in the vocabulary."""
    return tfidf.frequent_terms(tokens(spark, sf, carry), Staging(spark))


def vocab(spark, sf):
    return tfidf.vocabulary(frequent(spark, sf))


def staged(spark, sf, carry=(), staging=None):
    """Those pages and the vocabulary, both staged; the folder outlives the call, as the caller runs the query."""
    staging = staging or Staging(spark)
    found = staging.keep(tfidf.frequent_terms(tokens(spark, sf, carry), staging), "page_terms")
    return found, staging.keep(tfidf.vocabulary(found), "vocabulary")


def scored(spark, sf, carry=()):
    """Pages with their scores, and the vocabulary."""
    found, kept = staged(spark, sf, carry)
    return tfidf.page_scores(found, kept), kept


def scores(spark, sf):
    return tfidf.score_rows(scored(spark, sf)[0])


def page_top(spark, sf):
    return tfidf.page_top_terms(scored(spark, sf)[0])


def top(spark, sf):
    return tfidf.top_terms(tfidf.term_means(page_top(spark, sf)))


def ref_tokens(spark, sf):
    return gap.reference_tokens(t.references(spark, sf), resources(spark))


def missing(spark, sf):
    return gap.missing_terms(top(spark, sf), ref_tokens(spark, sf))


def six(name):
    return F.round(name, 6).alias(name)


@query("m6_preprocess", with_("""
    SELECT p.query_id, p.doc_ord, CAST(p.n_tokens AS INTEGER) AS n_tokens, coalesce(t.v, '') AS preprocessed FROM page_sizes p
    LEFT JOIN (SELECT query_id, doc_ord, string_agg(token, ' ' ORDER BY ix) AS v FROM tokens GROUP BY 1, 2) t
    ON t.query_id = p.query_id AND t.doc_ord = p.doc_ord"""))
def m6(spark, sf):
    return tokens(spark, sf).select("query_id", "doc_ord", "n_tokens", F.array_join("tokens", " ").alias("preprocessed"))


@query("c13_usable_pages", with_("SELECT query_id, doc_ord FROM page_sizes WHERE n_tokens >= 2"))
def c13(spark, sf):
    return tokens(spark, sf).where(F.col("n_tokens") >= 2).select("query_id", "doc_ord")


@query("j2_page_keys", with_("""
    SELECT t.query_id, t.doc_ord, p.url, count(*) AS tokens FROM tokens t
    JOIN page_sizes p ON p.query_id = t.query_id AND p.doc_ord = t.doc_ord GROUP BY ALL"""))
def j2(spark, sf):
    counted = tokens(spark, sf).select("query_id", "doc_ord", F.col("n_tokens").cast("bigint").alias("tokens"))
    keys = t.docs(spark, sf).select("query_id", "doc_ord", "url")
    return counted.where(F.col("tokens") > 0).join(keys, ["query_id", "doc_ord"])


@query("u1_one_and_two_word_terms", with_("""
    SELECT p.query_id, p.doc_ord, CAST(coalesce(t.n, 0) AS BIGINT) AS n_terms FROM page_sizes p
    LEFT JOIN (SELECT query_id, doc_ord, count(*) AS n FROM terms GROUP BY 1, 2) t
    ON t.query_id = p.query_id AND t.doc_ord = p.doc_ord"""))
def u1(spark, sf):
    total = F.aggregate("terms", F.lit(0).cast("bigint"), lambda acc, x: acc + x["tf"])
    return pages(spark, sf).select("query_id", "doc_ord", F.coalesce(total, F.lit(0).cast("bigint")).alias("n_terms"))


@query("a1_term_frequency", with_("SELECT query_id, doc_ord, term, tf FROM counts"))
def a1(spark, sf):
    return tfidf.term_counts(pages(spark, sf))


@query("a2_document_frequency", with_("SELECT query_id, term, df, ctf FROM frequency"))
def a2(spark, sf):
    return tfidf.every_frequency(tokens(spark, sf))


@query("a3_vocabulary_cap", with_("SELECT query_id, term, ctf, CAST(vocab_rank AS INTEGER) AS vocab_rank FROM vocab"))
def a3(spark, sf):
    return vocab(spark, sf).select("query_id", "term", "ctf", "vocab_rank")


@query("t2_vocabulary_size", with_("SELECT query_id, count(*) AS terms, CAST(min(ctf) AS BIGINT) AS least FROM vocab GROUP BY 1"))
def t2(spark, sf):
    return a3(spark, sf).groupBy("query_id").agg(F.count("*").alias("terms"), F.min("ctf").alias("least"))


@query("a4_smoothed_idf", with_("SELECT query_id, term, df, round(idf, 6) AS idf FROM vocab"))
def a4(spark, sf):
    return vocab(spark, sf).select("query_id", "term", "df", six("idf"))


@query("j3_counts_in_vocabulary", with_("""
    SELECT c.query_id, c.doc_ord, c.term, c.tf, v.df FROM counts c JOIN vocab v ON v.query_id = c.query_id AND v.term = c.term"""))
def j3(spark, sf):
    return tfidf.kept_counts(*staged(spark, sf))


@query("a5_unit_length", with_("""
    SELECT query_id, doc_ord, count(*) AS terms, round(sum(score * score), 6) AS length FROM scores GROUP BY ALL"""))
def a5(spark, sf):
    return scores(spark, sf).groupBy("query_id", "doc_ord").agg(
        F.count("*").alias("terms"), F.round(F.sum(F.col("score") * F.col("score")), 6).alias("length")
    )


@query("m1_tfidf", with_("SELECT query_id, doc_ord, term, tf, round(score, 6) AS score FROM scores"))
def m1(spark, sf):
    return scores(spark, sf).select("query_id", "doc_ord", "term", "tf", six("score"))


@query("t3_page_top_terms", with_("""
    SELECT query_id, doc_ord, CAST(rank AS INTEGER) AS rank, term, round(score, 6) AS score FROM page_top"""))
def t3(spark, sf):
    return page_top(spark, sf).select("query_id", "doc_ord", "rank", "term", six("score"))


@query("a6_mean_top_score", with_("SELECT query_id, term, round(score, 6) AS score, pages FROM means"))
def a6(spark, sf):
    return tfidf.term_means(page_top(spark, sf)).select("query_id", "term", six("score"), "pages")


@query("t4_top_terms", with_("""
    SELECT query_id, CAST(rank AS INTEGER) AS rank, term, round(score, 6) AS score, pages FROM top"""))
def t4(spark, sf):
    return top(spark, sf).select("query_id", "rank", "term", six("score"), "pages")


@query("a18_reference_tokens", with_("SELECT query_id, unnest(list_distinct(ref_tokens)) AS token FROM ref_words"))
def a18(spark, sf):
    return ref_tokens(spark, sf).select("query_id", F.explode("ref_tokens").alias("token"))


@query("j12_terms_in_reference", with_("""
    SELECT t.query_id, t.term, contains(r.ref_norm, t.term) AS as_text FROM top t JOIN ref_words r ON r.query_id = t.query_id"""))
def j12(spark, sf):
    return top(spark, sf).join(ref_tokens(spark, sf), "query_id").select(
        "query_id", "term", F.contains("ref_norm", "term").alias("as_text")
    )


GAP_OF_WORDS = with_("""
    SELECT q.query_id, q.term, NOT contains(r.ref_norm, q.term) AND NOT list_has_all(r.ref_tokens, string_split(q.term, ' ')) AS missing
    FROM (SELECT DISTINCT query_id, term FROM terms) q JOIN ref_words r ON r.query_id = q.query_id""")


@query("c14_gap_predicate", GAP_OF_WORDS)
def c14(spark, sf):
    """The predicate on every distinct term of the pages, not only on the top terms."""
    every = tfidf.term_counts(pages(spark, sf)).select("query_id", "term").distinct()
    flag = gap.is_missing(F.col("term"), F.col("ref_norm"), F.col("ref_tokens"))
    return every.join(ref_tokens(spark, sf), "query_id").select("query_id", "term", flag.alias("missing"))


@query("m7_missing_terms", with_("SELECT query_id, CAST(rank AS INTEGER) AS rank, term, round(score, 6) AS score FROM missing"))
def m7(spark, sf):
    return missing(spark, sf).select("query_id", "rank", "term", six("score"))


@query("m2_term_gap", with_("""
    SELECT t.query_id, CAST(t.rank AS INTEGER) AS rank, t.term, round(t.score, 6) AS score, t.pages, m.term IS NOT NULL AS is_missing
    FROM top t LEFT JOIN missing m ON m.query_id = t.query_id AND m.term = t.term"""))
def m2(spark, sf):
    found = term_gap(t.docs(spark, sf), t.references(spark, sf), resources(spark), Staging(spark))
    return found.withColumn("score", F.round("score", 6))


@query("a15_cloud_weights", with_("SELECT query_id, word, n, round(weight, 6) AS weight FROM cloud"))
def a15(spark, sf):
    return tfidf.cloud_weights(top(spark, sf)).select("query_id", "word", "n", six("weight"))


@query("t9_cloud_terms", with_("SELECT query_id, CAST(rank AS INTEGER) AS rank, term FROM top WHERE rank <= 50"))
def t9(spark, sf):
    return top(spark, sf).where(F.col("rank") <= 50).select("query_id", "rank", "term")


EVERY_CELL = """
    SELECT p.query_id, p.doc_ord, p.url AS page, v.term, round(coalesce(s.score, 0), 6) AS score FROM page_sizes p
    JOIN vocab v ON v.query_id = p.query_id
    LEFT JOIN scores s ON s.query_id = p.query_id AND s.doc_ord = p.doc_ord AND s.term = v.term WHERE p.n_tokens >= 2"""


def term_table(spark, sf):
    return report.term_tables(*scored(spark, sf, carry=("url",)))


@query("w1_term_table", with_(f"SELECT query_id, page, term, score FROM ({EVERY_CELL})"))
def w1(spark, sf):
    """The table written as CSV files and read back."""
    path = f"{Staging(spark).root}/term_table"
    writers.write_term_tables(term_table(spark, sf), path)
    return writers.read_term_tables(spark, path).select("query_id", "page", "term", six("score"))


@query("r4_long_to_wide", with_(f"""
    SELECT query_id, doc_ord, page, string_agg(printf('%.6f', score), ',' ORDER BY term) AS weights FROM ({EVERY_CELL}) GROUP BY ALL"""))
def r4(spark, sf):
    shown = F.array_join(F.transform("weights", lambda w: F.format_string("%.6f", w)), ",")
    return term_table(spark, sf).select("query_id", "doc_ord", "page", shown.alias("weights"))


@query("r2_zero_fill", with_(f"SELECT query_id, doc_ord, count(*) FILTER (score = 0) AS zeros, count(*) AS terms FROM ({EVERY_CELL}) GROUP BY ALL"))
def r2(spark, sf):
    size = lambda c: F.size(c).cast("bigint")
    zeros = F.filter("weights", lambda w: F.round(w, 6) == 0)
    return term_table(spark, sf).select("query_id", "doc_ord", size(zeros).alias("zeros"), size("weights").alias("terms"))


@query("r3_key_column", with_(f"SELECT query_id, page, string_agg(term, ',' ORDER BY term) AS header FROM ({EVERY_CELL}) GROUP BY query_id, doc_ord, page"))
def r3(spark, sf):
    """The page's URL as the key column in front of the term columns."""
    return term_table(spark, sf).select("query_id", "page", F.array_join("names", ",").alias("header"))


@query("r5_records", with_("""
    SELECT '{"query_id":"' || query_id || '","rank":' || rank || ',"term":"' || term || '"}' AS record FROM top"""))
def r5(spark, sf):
    return report.records(top(spark, sf).select("query_id", "rank", "term"))
