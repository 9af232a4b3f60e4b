"""Scalar functions over whole texts, titles and URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from termgap.functions import naming, text
from termgap.params import DEFAULT
from termgap.queries import sql as s
from termgap.queries import tables as t
from termgap.queries.registry import query
from termgap.queries.sql import lit, sub


def _docs(spark, sf):
    from termgap.session import spread

    return spread(t.read(spark, sf, "documents").select("doc_id", "text"), "doc_id")


@query("f1_strip_urls", f"""
    SELECT doc_id, {sub("'see ' || 'https://host/' || doc_id || ' for ' || text", text.URL, "' '")} AS cleaned FROM documents""")
def f1(spark, sf):
    linked = F.concat(F.lit("see https://host/"), F.col("doc_id").cast("string"), F.lit(" for "), F.col("text"))
    return _docs(spark, sf).select("doc_id", text.strip_urls(linked).alias("cleaned"))


@query("f2_strip_digits", f"SELECT doc_id, {sub('text', text.DIGITS, lit(' '))} AS cleaned FROM documents")
def f2(spark, sf):
    return _docs(spark, sf).select("doc_id", text.strip_digits(F.col("text")).alias("cleaned"))


@query("f3_strip_quotes", """SELECT doc_id, translate(text, '"''-', '   ') AS cleaned FROM documents""")
def f3(spark, sf):
    return _docs(spark, sf).select("doc_id", text.strip_quotes(F.col("text")).alias("cleaned"))


@query("f4_squeeze_spaces", f"SELECT doc_id, trim({sub('text', text.SPACES, lit(' '))}, ' ') AS cleaned FROM documents")
def f4(spark, sf):
    return _docs(spark, sf).select("doc_id", text.squeeze(F.col("text")).alias("cleaned"))


@query("f5_words", f"""
    SELECT doc_id, array_to_string(regexp_extract_all(lower({s.normalise('text')}), {lit(text.WORD)}), ' ') AS words FROM documents""")
def f5(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(text.words(F.col("text")), " ").alias("words"))


@query("f6_split_join", """
    SELECT doc_id, array_to_string(string_split(text, ' '), '_') AS joined, len(string_split(text, ' ')) AS parts FROM documents""")
def f6(spark, sf):
    parts = F.split("text", " ")
    return _docs(spark, sf).select("doc_id", F.array_join(parts, "_").alias("joined"), F.size(parts).cast("bigint").alias("parts"))


@query("f7_entity_cleanup", f"""
    SELECT doc_id, surface, length(surface) > 2 AND NOT regexp_matches(surface, '^\\p{{Nd}}+$') AS kept FROM (
        SELECT doc_id, trim({sub('text', text.SPACES, lit(' '))}, ' ') AS surface FROM documents)""")
def f7(spark, sf):
    from termgap.operators.entities import clean_surface, keep_surface

    return (
        _docs(spark, sf)
        .select("doc_id", clean_surface(F.col("text")).alias("surface"))
        .select("doc_id", "surface", keep_surface(F.col("surface")).alias("kept"))
    )


@query("f8_term_tokens", f"""
    SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS n FROM documents""")
def f8(spark, sf):
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return _docs(spark, sf).select("doc_id", F.size(found).cast("bigint").alias("n"))


#: Bytes of documents whose pairs one task counts.
PAIRS_BYTES = 4 << 20


@query("f9_bigrams", s.with_("""
    SELECT doc_ord, pair, CAST(count(*) AS BIGINT) AS n FROM (
        SELECT doc_ord, word || ' ' || lead(word) OVER (PARTITION BY query_id, doc_ord ORDER BY pos) AS pair FROM words)
    WHERE pair IS NOT NULL GROUP BY ALL"""))
def f9(spark, sf):
    """Pairs are counted where their document lies; a task holds those of a few MB of texts, however many there are."""
    found = t.docs(spark, sf, task_bytes=PAIRS_BYTES).select("doc_ord", text.words(F.col("text")).alias("w"))
    pairs = found.select("doc_ord", F.when(F.size("w") > 1, text.bigrams(F.col("w"))).alias("pairs"))
    rows = pairs.select("doc_ord", F.explode_outer("pairs").alias("pair")).where(F.col("pair").isNotNull())
    return rows.groupBy("doc_ord", "pair").agg(F.count("*").alias("n"))


@query("f10_cluster_count", f"""
    SELECT n_chars, CAST(least({s.clusters_for('n_chars')}, n_chars) AS INTEGER) AS k FROM (
        SELECT DISTINCT n_chars FROM documents)""")
def f10(spark, sf):
    n = t.read(spark, sf, "documents").select("n_chars").distinct()
    k = F.least(naming.cluster_count(F.col("n_chars"), DEFAULT.max_clusters), F.col("n_chars"))
    return n.select("n_chars", k.cast("int").alias("k"))


@query("f11_content_key", "SELECT page_id, md5(lower('text_v2_' || url || '_' || page_id)) AS cache_key FROM pages")
def f11(spark, sf):
    return t.read(spark, sf, "pages").select(
        "page_id", naming.content_key(F.lit("text_v2"), F.col("url"), F.col("page_id")).alias("cache_key")
    )


@query("f12_cache_file", "SELECT page_id, 'text_v2_' || md5(lower('text_v2_' || url)) || '.json' AS file FROM pages")
def f12(spark, sf):
    from termgap.operators.reuse import text_key

    return t.read(spark, sf, "pages").select(
        "page_id", naming.cache_file(F.lit("text_v2"), text_key(F.col("url"))).alias("file")
    )


@query("f13_safe_names", f"SELECT doc_id, {s.safe_name('text')} AS name FROM documents")
def f13(spark, sf):
    return _docs(spark, sf).select("doc_id", naming.safe_name(F.col("text")).alias("name"))


@query("f14_output_base", f"""
    SELECT page_id, {s.safe_name("CASE WHEN page_id % 3 = 0 THEN 'run ' || page_id ELSE " + s.TITLE + " END")}
        || '_' || strftime(TIMESTAMP '2024-01-08 12:34:56', '%Y%m%d-%H%M%S') AS base FROM pages""")
def f14(spark, sf):
    i = F.col("page_id")
    prefix = F.when(i % 3 == 0, F.concat(F.lit("run "), i.cast("string"))).when(i % 3 == 1, "")
    title = F.regexp_extract("html", t.TITLE, 1)
    at = F.expr("TIMESTAMP '2024-01-08 12:34:56'")
    return t.read(spark, sf, "pages").select("page_id", naming.output_base(prefix, title, at).alias("base"))


@query("f15_number_format", """
    SELECT doc_id, printf('%.2f', n_chars / 7.0) AS two, printf('%.3f', n_chars / 7.0) AS three FROM documents""")
def f15(spark, sf):
    x = F.col("n_chars") / F.lit(7.0)
    return t.read(spark, sf, "documents").select(
        "doc_id", F.format_string("%.2f", x).alias("two"), F.format_string("%.3f", x).alias("three")
    )


@query("f16_json_round_trip", "SELECT doc_id, text, lang FROM documents")
def f16(spark, sf):
    encoded = t.read(spark, sf, "documents").select("doc_id", F.to_json(F.struct("text", "lang")).alias("j"))
    decoded = encoded.select("doc_id", F.from_json("j", "text STRING, lang STRING").alias("d"))
    return decoded.select("doc_id", "d.text", "d.lang")


@query("f17_string_tests", """
    SELECT page_id, starts_with(url, 'https://') AS secure, contains(lower(html), '<table') AS has_table,
           upper(left(trim(url, ' '), 4)) AS scheme, ends_with(url, '#top') AS at_top, length(html) AS chars FROM pages""")
def f17(spark, sf):
    return t.read(spark, sf, "pages").select(
        "page_id",
        F.col("url").startswith("https://").alias("secure"),
        F.contains(F.lower("html"), F.lit("<table")).alias("has_table"),
        F.upper(F.left(F.btrim("url", F.lit(" ")), F.lit(4))).alias("scheme"),
        F.col("url").endswith("#top").alias("at_top"),
        F.length("html").cast("bigint").alias("chars"),
    )


@query("f18_base_name", "SELECT page_id, string_split(url, '/')[-1] AS name FROM pages")
def f18(spark, sf):
    return t.read(spark, sf, "pages").select("page_id", naming.base_name(F.col("url")).alias("name"))


@query("f19_safe_integer", s.with_("SELECT doc_id, TRY_CAST(num_results_raw AS INTEGER) AS n FROM raw_requests"))
def f19(spark, sf):
    return t.raw_requests(spark, sf).select("doc_id", F.col("num_results_raw").try_cast("int").alias("n"))
