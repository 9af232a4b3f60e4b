"""Sources, filters, projections and joins of the input funnel."""

from __future__ import annotations

from pyspark.sql import functions as F

from termgap.functions import naming
from termgap.functions.html import main_text
from termgap.operators import status, tokens
from termgap.params import DEFAULT
from termgap.queries import fixtures
from termgap.queries import tables as t
from termgap.queries.registry import query
from termgap.queries.sql import lit, with_, with_main_text
from termgap.session import Staging
from termgap.sources import pages, references, requests, resources, search

COUNT = "CAST(count(*) AS BIGINT)"


def classified(spark, sf):
    return pages.classify(t.crawl(spark, sf))


def outcomes(spark, sf):
    """Page outcomes, staged; the folder outlives the call, as the caller runs the query."""
    return Staging(spark).keep(classified(spark, sf).select("url", "text", "error_code", "error_detail"), "classified")


def attached(spark, sf):
    return pages.attach_pages(t.results(spark, sf).withColumnRenamed("pos", "rank"), outcomes(spark, sf))


def searches(spark, sf):
    return search.parse_payloads(t.payloads(spark, sf))


def organic(spark, sf):
    return search.organic_results(searches(spark, sf), t.payloads(spark, sf).select("query_id", "num_results"))


@query("s1_search_results", with_("""
    SELECT s.query_id, s.error, coalesce(i.n, 0) AS items, coalesce(q.n, 0) AS asked FROM searches s
    LEFT JOIN (SELECT query_id, count(*) AS n FROM search_items GROUP BY 1) i ON i.query_id = s.query_id
    LEFT JOIN (SELECT query_id, CASE WHEN page_id % 3 = 2 THEN 0 ELSE 4 END AS n FROM searches WHERE error IS NULL) q
    ON q.query_id = s.query_id"""))
def s1(spark, sf):
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return searches(spark, sf).select("query_id", "error", size("organic").alias("items"), size("questions").cast("int").alias("asked"))


@query("s2_page_source", with_("""
    SELECT url, CAST(status AS INTEGER) AS status, reason, content_type, error_class, length(body) AS body_chars FROM crawl"""))
def s2(spark, sf):
    return t.crawl(spark, sf).select(
        "url", "status", "reason", "content_type", "error_class", F.length("body").cast("bigint").alias("body_chars")
    )


@query("s2_page_charsets", f"""
    SELECT page_id, md5(replace(html, '<meta charset="utf-8">', CASE page_id % 6 WHEN 2 THEN
        '<meta http-equiv=''Content-Type'' content=''text/html; charset=Windows-1252''>' WHEN 3 THEN '<meta charset="utf-8">' ELSE '' END)
        || {lit(t.TAIL)}) AS text_md5 FROM pages""")
def s2_charsets(spark, sf):
    decoded = pages.decode_bodies(t.page_bytes(spark, sf))
    return decoded.select("page_id", F.md5("body").alias("text_md5"))


@query("s3_reference_texts", with_("""
    SELECT r.query_id, f.ref_text IS NOT NULL AS has_reference, f.ref_text FROM requests r LEFT JOIN refs f ON f.query_id = r.query_id"""))
def s3(spark, sf):
    return references.attach_references(t.requests(spark, sf), t.references(spark, sf)).select(
        "query_id", "has_reference", "ref_text"
    )


@query("s4_cached_results", with_("SELECT cache_type, cache_key, payload FROM live"))
def s4(spark, sf):
    from termgap.operators import reuse

    live = t.store(spark, sf).view().latest().where(reuse.is_fresh(F.expr(t.NOW)) & reuse.is_well_formed())
    return live.select("cache_type", "cache_key", "payload")


@query("s5_legacy_snapshots", with_("""
    SELECT cache_key, CASE WHEN page_id % 11 = 0 THEN 'list_shaped' END AS reject_reason FROM cache WHERE cache_type = 'serp_v2'"""))
def s5(spark, sf):
    _, newer = t.cache(spark, sf)
    return newer.where(F.col("cache_type") == "serp_v2").select("cache_key", F.when(~search.has_search_shape(F.col("payload")), "list_shaped").alias("reject_reason"))


@query("s6_language_resources", with_(f"""
    SELECT r.kind, r.lang, r.word, {COUNT} AS uses FROM words w JOIN (
        SELECT 'stop_word' AS kind, lang, word FROM stop_words
        UNION ALL SELECT 'lexicon', lang, form FROM lexicon UNION ALL SELECT 'polarity', lang, word FROM polarity) r
    ON r.lang = w.lang AND r.word = w.word GROUP BY ALL"""))
def s6(spark, sf):
    stop = spark.sql(resources.STOP_WORDS_SQL).select(F.lit("stop_word").alias("kind"), "lang", "word")
    lexicon = spark.sql(fixtures.LEXICON_SQL).select(F.lit("lexicon").alias("kind"), "lang", F.col("form").alias("word"))
    polarity = spark.sql(fixtures.POLARITY_SQL).select(F.lit("polarity").alias("kind"), "lang", "word")
    listed = stop.unionByName(lexicon).unionByName(polarity)
    used = tokens.word_rows(t.docs(spark, sf)).groupBy("lang", "word").agg(F.count("*").alias("n"))
    return used.join(listed, ["lang", "word"]).select("kind", "lang", "word", F.col("n").alias("uses"))


REJECT = """CASE WHEN trim(query) = '' THEN 'empty_keyword'
    WHEN num_results_raw IS NOT NULL AND coalesce(TRY_CAST(num_results_raw AS INTEGER) NOT BETWEEN 1 AND 100, true) THEN 'bad_num_results'
    WHEN language NOT IN ('de', 'en', 'es', 'fr') THEN 'unknown_language'
    WHEN lower(reference_name) NOT LIKE '%.txt' THEN 'reference_not_txt' END"""


@query("c1_request_validation", with_(f"SELECT doc_id, {REJECT} AS reject_reason FROM raw_requests"))
def c1(spark, sf):
    return requests.validate_requests(t.raw_requests(spark, sf)).select("doc_id", "reject_reason")


@query("c2_defaults", with_("""
    SELECT doc_id, coalesce(language, 'de') AS language_effective,
           coalesce(TRY_CAST(num_results_raw AS INTEGER), 10) AS num_results_effective FROM raw_requests"""))
def c2(spark, sf):
    return requests.with_defaults(t.raw_requests(spark, sf)).select("doc_id", "language_effective", "num_results_effective")


@query("c3_language_fallback", with_("""
    SELECT doc_id, language, CASE WHEN language IN ('de', 'en', 'es', 'fr') THEN language ELSE 'de' END AS resource_language
    FROM raw_requests"""))
def c3(spark, sf):
    return t.raw_requests(spark, sf).select(
        "doc_id", "language", requests.resource_language(F.col("language")).alias("resource_language")
    )


@query("c4_request_manifest", with_("""
    SELECT query_id, query AS q, num_results * 2 AS num, language AS hl,
           CASE WHEN length(language) = 2 THEN upper(language) ELSE 'DE' END AS gl, 'lang_' || language AS lr FROM searches"""))
def c4(spark, sf):
    return requests.search_manifest(t.payloads(spark, sf))


@query("c5_organic_results", with_("SELECT * FROM organic"))
def c5(spark, sf):
    return organic(spark, sf)


@query("c6_related_questions", with_("SELECT query_id, CAST(pos AS INTEGER) AS pos, question FROM questions"))
def c6(spark, sf):
    return search.related_questions(searches(spark, sf))


@query("c7_result_urls", with_("SELECT query_id, rank, url FROM organic WHERE url IS NOT NULL"))
def c7(spark, sf):
    return search.result_urls(organic(spark, sf))


@query("c8_fetch_outcome", with_("SELECT url, error_code, error_detail FROM classified"))
def c8(spark, sf):
    return classified(spark, sf).select("url", "error_code", "error_detail")


@query("c9_html_content_type", with_("SELECT url, contains(lower(coalesce(content_type, '')), 'html') AS html FROM crawl"))
def c9(spark, sf):
    return t.crawl(spark, sf).select("url", pages.is_html(F.col("content_type")).alias("html"))


AWKWARD = f"""SELECT page_id, replace(html, '</body>', CASE page_id % {len(t.FRAGMENTS)} {
    ' '.join(f"WHEN {k} THEN {lit(text)}" for k, text in enumerate(t.FRAGMENTS))} END || '</body>') AS html FROM pages"""


@query("c10_main_text", f"SELECT page_id, main_text AS text FROM ({with_main_text(AWKWARD, 'html')})")
def c10(spark, sf):
    return t.awkward_pages(spark, sf).select("page_id", main_text(F.col("html")).alias("text"))


@query("c11_minimum_length", with_("SELECT url, length(text) AS chars FROM classified WHERE text IS NOT NULL"))
def c11(spark, sf):
    return classified(spark, sf).where(F.col("text").isNotNull()).select("url", F.length("text").cast("bigint").alias("chars"))


@query("c12_valid_failed_split", with_("""
    SELECT query_id, rank, url, true AS valid FROM attached WHERE error_code IS NULL
    UNION ALL SELECT query_id, rank, url, false FROM failed"""))
def c12(spark, sf):
    rows = attached(spark, sf)
    keys = ["query_id", "rank", "url"]
    return pages.valid_pages(rows).select(*keys, F.lit(True).alias("valid")).unionByName(
        pages.failed_pages(rows).select(*keys, F.lit(False).alias("valid"))
    )


@query("c18_optional_stages", with_("""
    SELECT d.query_id, d.doc_ord FROM docs d JOIN requests r ON r.query_id = d.query_id WHERE r.ner"""))
def c18(spark, sf):
    return status.enabled(t.docs(spark, sf).select("query_id", "doc_ord"), t.requests(spark, sf), "ner")


@query("j1_pages_by_url", with_("SELECT query_id, rank, url, error_code FROM attached"))
def j1(spark, sf):
    return attached(spark, sf).select("query_id", "rank", "url", "error_code")


@query("j4_stop_word_exclusion", with_(f"""
    SELECT w.lang, w.word, {COUNT} AS n FROM words w
    WHERE NOT EXISTS (SELECT 1 FROM stop_words s WHERE s.lang = w.lang AND s.word = w.word) GROUP BY ALL"""))
def j4(spark, sf):
    rows = tokens.without_stop_words(tokens.word_rows(t.docs(spark, sf)), spark.sql(resources.STOP_WORDS_SQL))
    return rows.groupBy("lang", "word").agg(F.count("*").alias("n"))


@query("j5_lexicon_lookup", with_(f"""
    SELECT w.query_id, w.word, lower(coalesce(l.lemma, w.word)) AS lemma, {COUNT} AS n FROM words w
    LEFT JOIN lexicon l ON l.lang = w.lang AND l.form = w.word
    WHERE coalesce(l.pos, 'NOUN') IN ('NOUN', 'VERB', 'ADJ', 'PROPN') GROUP BY ALL"""))
def j5(spark, sf):
    rows = tokens.lemmas(tokens.word_rows(t.docs(spark, sf)), spark.sql(fixtures.LEXICON_SQL))
    return rows.where(F.col("lemma").isNotNull()).groupBy("query_id", "word", "lemma").agg(F.count("*").alias("n"))


@query("t1_first_accepted", with_("SELECT query_id, CAST(rank AS INTEGER) AS rank, title, url FROM accepted"))
def t1(spark, sf):
    return search.first_accepted(t.results(spark, sf), DEFAULT.max_results).select("query_id", "rank", "title", "url")


@query("a13_page_counts", with_("""
    SELECT query_id, count(*) AS n_results, count(*) FILTER (WHERE error_code IS NULL) AS n_processed,
           count(error_code) AS n_failed FROM attached GROUP BY 1"""))
def a13(spark, sf):
    return status.page_counts(attached(spark, sf))


@query("a14_joined_reasons", with_("""
    SELECT a.query_id, string_agg(a.url || ': ' || c.error_code || coalesce(': ' || c.error_detail, ''), '; ' ORDER BY a.rank) AS error_detail
    FROM accepted a JOIN classified c ON c.url = a.url WHERE c.error_code IS NOT NULL GROUP BY 1"""))
def a14(spark, sf):
    kept = search.first_accepted(t.results(spark, sf), DEFAULT.max_results)
    return status.joined_reasons(pages.failed_pages(pages.attach_pages(kept, outcomes(spark, sf))))


@query("w5_failed_urls", with_("SELECT * FROM failed"))
def w5(spark, sf):
    return pages.failed_pages(attached(spark, sf))


@query("t10_failed_preview", with_("""
    SELECT query_id, CAST(ord AS INTEGER) AS ord, url, reason FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, url) AS ord FROM failed) WHERE ord <= 5"""))
def t10(spark, sf):
    return status.failed_preview(pages.failed_pages(attached(spark, sf))).select("query_id", "ord", "url", "reason")


@query("u2_failures_of_all_stages", with_("""
    SELECT query_id, 'search' AS stage, error AS reason FROM searches WHERE error IS NOT NULL
    UNION ALL SELECT query_id, 'page', reason FROM failed"""))
def u2(spark, sf):
    found = searches(spark, sf).where(F.col("error").isNotNull())
    failed = pages.failed_pages(attached(spark, sf))
    return found.select("query_id", F.lit("search").alias("stage"), F.col("error").alias("reason")).unionByName(
        failed.select("query_id", F.lit("page").alias("stage"), "reason")
    )


@query("r1_explode_items", with_("SELECT query_id, CAST(p AS INTEGER) AS position, title, link FROM search_items"))
def r1(spark, sf):
    return searches(spark, sf).select("query_id", F.explode("organic").alias("i")).select("query_id", "i.position", "i.title", "i.link")


URL70 = "CASE WHEN length(url) > 70 THEN left(url, 70) || '...' ELSE url END"


@query("c17_display_forms", f"""
    SELECT page_id, {URL70.replace('70', '40')} AS shown_url, printf('%.3f', page_id / 7.0) AS score,
           CASE WHEN page_id % 5 = 0 THEN 'N/A' ELSE printf('%.2f', page_id / 7.0) END AS sentiment FROM pages""")
def c17(spark, sf):
    """The page URLs are short, so the cut is shown at 40 characters; the report cuts at 70."""
    from termgap.operators.report import display_score, display_sentiment

    x = F.col("page_id") / F.lit(7.0)
    return t.read(spark, sf, "pages").select(
        "page_id",
        naming.short_url(F.col("url"), 40).alias("shown_url"),
        display_score(x).alias("score"),
        display_sentiment(F.when(F.col("page_id") % 5 != 0, x)).alias("sentiment"),
    )
