"""How the provided tables stand in for the inputs, in Spark and as SQL relations for the oracle.

documents: the page texts of 20 keywords (``source``). benchmark: own texts. pages: crawled pages, search payloads and
cache entries. Status codes, content types and request fields that the tables lack are derived from row numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termgap.session import spread

NOW = "TIMESTAMP '2024-01-08 00:00:00'"
TITLE = r"(?s)<title>(.*?)</title>"
LANG = r'<html lang="([a-z]+)"'
ANCHOR = r'<a href="([^"]*)">([^<]*)</a>'
SITE = r"^(https?://[^/?#]+)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str, task_bytes: int | None = None) -> DataFrame:
    out = read(spark, sf_dir, "documents").select(
        F.col("source").alias("query_id"),
        F.col("doc_id").alias("doc_ord"),
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"),
        "lang",
        "text",
    )
    return spread(out, "doc_ord", task_bytes=task_bytes)


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("query_id"),
        F.lit("en").alias("lang"),
        F.col("text").alias("ref_text"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per keyword; language, limit and flags follow from the keyword number."""
    n = F.substring("query_id", 4, 10).cast("int")
    return (
        read(spark, sf_dir, "documents")
        .select(F.col("source").alias("query_id"))
        .distinct()
        .select(
            "query_id",
            F.concat(F.lit("topic "), "query_id").alias("query"),
            F.when(n % 4 == 0, "de").when(n % 4 == 1, "en").when(n % 4 == 2, "es").otherwise("fr").alias("language"),
            (n % 20 + 1).alias("num_results"),
            (n % 2 == 0).alias("ner"),
            (n % 3 == 0).alias("cluster"),
            (n % 5 != 0).alias("sentiment"),
        )
    )


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One form submission per document, many of them faulty."""
    i = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        i,
        F.when(i % 10 == 0, "   ").otherwise(F.col("text")).alias("query"),
        F.when(i % 9 == 0, "xx").when(i % 9 != 1, F.col("lang")).alias("language"),
        F.when(i % 7 == 0, "0").when(i % 7 == 1, "101").when(i % 7 == 2, "x")
        .when(i % 7 != 3, (i % 100 + 1).cast("string")).alias("num_results_raw"),
        F.when(i % 8 == 0, "notes.pdf").when(i % 8 == 1, "own.TXT").when(i % 8 != 2, "own.txt").alias("reference_name"),
    )


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    return spread(
        read(spark, sf_dir, "pages").select(
            i,
            "url",
            F.when(i % 17 == 0, 404).when(i % 19 == 0, 503).otherwise(200).alias("status"),
            F.when(i % 17 == 0, "Not Found").when(i % 19 == 0, "Service Unavailable").otherwise("OK").alias("reason"),
            F.when(i % 23 == 0, "application/pdf").otherwise("text/HTML; charset=utf-8").alias("content_type"),
            F.when(i % 29 == 0, "ConnectionError").when(i % 31 == 0, "InvalidURL").alias("error_class"),
            F.when(i % 37 == 0, "").when(i % 41 == 0, "<html><body><p>Only a few words.</p></body></html>").otherwise(F.col("html")).alias("body"),
        ),
        "page_id",
    )


# Pieces of pages that a first-closing-tag rule gets wrong, and references of every kind.
FRAGMENTS = (
    '<div class="ad">AD<div>inner</div>leaked ad</div>',
    "<table><tr><td>a<table><tr><td>b</td></tr></table>leaked cell</td></tr></table>",
    "<p>M&uuml;nchen &#8211; Gr&ouml;&szlig;e &amp;lt; &#x41;&#128; &copy 2020 &euro;5 &nosuch; &#xD800;</p>",
    "<p>pick <select><option>a<option>b</select>one <button>go</button>now<svg><text>s</text></svg></p><iframe src=x><p>old</iframe>",
    "<div><nav>never closed</div><p>back again</p>",
    "<section class='x comments y'><p>c</p></section><p>a < b &amp;&amp; c > d</p>",
    '<script>if (a < b) { "</div><nav>" }</script><p>&lt;tag&gt; &nbsp;x&nbsp; &hellip;</p><!-- <nav> -->',
    "<form><div></form>open</div><NAV/><Div Class=ads>w</dIV><p>after</p>",
)


def awkward_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, with one of FRAGMENTS at the end of its body."""
    fragment = F.get(F.array(*map(F.lit, FRAGMENTS)), (F.col("page_id") % len(FRAGMENTS)).cast("int"))
    html = F.replace(F.col("html"), F.lit("</body>"), F.concat(fragment, F.lit("</body>")))
    return spread(read(spark, sf_dir, "pages").select("page_id", html.alias("html")), "page_id")


# A tail with characters that only Windows-1252 has at these bytes, and their bytes as Latin-1.
TAIL, TAIL_LATIN = "€ “x” – …", "\x80 \x93x\x94 \x96 \x85"


def page_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as bytes: UTF-8 and one-byte charsets, named by the header, by a meta tag or not at all."""
    i, kind = F.col("page_id"), F.col("page_id") % 6
    meta = F.when(kind == 2, "<meta http-equiv='Content-Type' content='text/html; charset=Windows-1252'>").when(kind == 3, '<meta charset="utf-8">').otherwise("")
    plain = F.replace("html", F.lit('<meta charset="utf-8">'), meta)
    latin = F.encode(F.concat(plain, F.lit(TAIL_LATIN)), "ISO-8859-1")
    return spread(read(spark, sf_dir, "pages"), "page_id").select(
        i, "url", F.lit(200).alias("status"), F.lit("OK").alias("reason"), F.lit(None).cast("string").alias("error_class"),
        F.when(kind == 0, "text/html; Charset=ISO-8859-1").when(kind == 1, 'text/html; charset="utf-8"').otherwise("text/html").alias("content_type"),
        F.when(kind.isin(0, 2, 4), latin).otherwise(F.encode(F.concat(plain, F.lit(TAIL)), "UTF-8")).alias("body"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results as rows: the page language is the keyword, the page number the position."""
    i = F.col("page_id")
    return read(spark, sf_dir, "pages").select(
        F.regexp_extract("html", LANG, 1).alias("query_id"),
        i.alias("pos"),
        F.when(i % 13 != 0, F.regexp_extract("html", TITLE, 1)).alias("title"),
        F.when(i % 43 == 0, F.concat(F.lit("ftp://host/"), i.cast("string"))).otherwise(F.col("url")).alias("url"),
    )


GROUP = 12  # pages of a keyword of the whole run


def run_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw request for each dozen of pages; some are faulty, some ask for one result."""
    k = F.floor(F.col("page_id") / GROUP)
    keyword = read(spark, sf_dir, "pages").select(k.alias("k")).distinct()
    k = F.col("k")
    return keyword.select(
        F.concat(F.lit("k"), k.cast("string")).alias("query_id"),
        F.when(k % 10 == 9, " ").otherwise(F.concat(F.lit("topic "), k.cast("string"))).alias("query"),
        F.when(k % 4 == 0, "de").when(k % 4 == 1, "en").when(k % 4 == 2, "es").otherwise("fr").alias("language"),
        F.when(k % 7 == 5, "1").when(k % 7 != 6, "9").alias("num_results_raw"),
        F.lit(None).cast("string").alias("reference_name"),
        (k % 2 == 0).alias("ner"), (k % 3 == 0).alias("cluster"), (k % 5 != 0).alias("sentiment"),
    )


def run_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captured search of each keyword: its pages as results, and a question. Some failed, some found nothing or only
    pages that nobody crawled.
    """
    k = F.floor(F.col("page_id") / GROUP)
    link = F.when(k % 8 == 3, F.concat(F.lit("https://nowhere.example/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    item = F.struct(F.col("page_id").alias("position"), F.regexp_extract("html", TITLE, 1).alias("title"), link.alias("link"))
    pages = read(spark, sf_dir, "pages").select(k.alias("k"), item.alias("item"))
    k = F.col("k")
    found = pages.groupBy("k").agg(F.sort_array(F.collect_list("item")).alias("items"))  # a dozen
    organic = F.when(k % 9 == 4, F.lit("[]")).otherwise(F.to_json("items"))
    asked = F.to_json(F.array(F.struct(F.concat(F.lit("What of "), k.cast("string"), F.lit("?")).alias("question"))))
    return found.select(
        F.concat(F.lit("k"), k.cast("string")).alias("query_id"), F.lit("").alias("query"), F.lit("").alias("language"),
        F.when(k % 11 == 10, 500).otherwise(200).alias("status"), F.lit(None).cast("string").alias("error_class"),
        F.concat(F.lit('{"organic_results":'), organic, F.lit(',"related_questions":'), asked, F.lit("}")).alias("payload"),
    )


def run_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.concat(F.lit("k"), F.col("item_id").cast("string")).alias("query_id"), F.lit("en").alias("lang"), F.col("text").alias("ref_text"))


def _items(html: Column, url: Column, own_title: Column) -> Column:
    """Organic items of a page's payload: the page itself, then its navigation links, some of them unusable."""
    hrefs = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1))
    names = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2))
    site = F.regexp_extract(url, SITE, 1)

    def item(position, title, link):
        return F.struct(position.cast("int").alias("position"), title.alias("title"), link.alias("link"))

    links = F.zip_with(
        F.transform(hrefs, lambda h, k: F.struct(h.alias("h"), (k + 2).alias("p"))),
        names,
        lambda a, name: item(
            a["p"],
            F.when(a["p"] % 4 == 0, "").otherwise(name),
            F.when(a["p"] % 5 == 0, F.concat(F.lit("ftp://host"), a["h"])).otherwise(F.concat(site, a["h"])),
        ),
    )
    return F.concat(F.array(item(F.lit(1), own_title, url)), links)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One captured search payload per page, as JSON text; some searches failed or hold broken JSON."""
    i = F.col("page_id")
    title = F.regexp_extract("html", TITLE, 1)
    organic = F.to_json(_items(F.col("html"), F.col("url"), title))
    asked = F.concat(
        F.lit("["),
        F.to_json(F.struct(F.concat(title, F.lit("?")).alias("question"))),
        F.lit(',"text",{"question":""},'),
        F.to_json(F.struct(F.concat(F.lit("Why "), i.cast("string"), F.lit("?")).alias("question"))),
        F.lit("]"),
    )
    questions = (
        F.when(i % 3 == 0, F.concat(F.lit(',"related_questions":'), asked))
        .when(i % 3 == 1, F.concat(F.lit(',"people_also_ask":'), asked))
        .otherwise(F.concat(F.lit(',"related_questions":[],"people_also_ask":'), asked))
    )
    good = F.concat(F.lit('{"organic_results":'), organic, questions, F.lit("}"))
    return spread(read(spark, sf_dir, "pages"), "page_id").select(
        F.concat(F.lit("q"), i.cast("string")).alias("query_id"),
        title.alias("query"),
        F.regexp_extract("html", LANG, 1).alias("language"),
        (i % 8 + 1).cast("int").alias("num_results"),
        F.when(i % 31 == 0, 503).otherwise(200).alias("status"),
        F.when(i % 41 == 0, "Timeout").alias("error_class"),
        F.when(i % 37 == 0, '{"organic_results": [').otherwise(good).alias("payload"),
    )


def cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Older and newer entries: page texts of which some were stored before, and a search entry that is sometimes list-shaped."""
    i = F.col("page_id")
    pages = read(spark, sf_dir, "pages")
    from termgap.operators.reuse import SEARCH_KIND, TEXT_KIND, search_key, text_key

    title = F.regexp_extract("html", TITLE, 1)
    at = F.expr(f"{NOW} - make_interval(0, 0, 0, 0, CAST(page_id AS INT), 0, 0)")
    text = pages.select(
        i,
        F.lit(TEXT_KIND).alias("cache_type"),
        text_key(F.col("url")).alias("cache_key"),
        F.when(i % 7 == 0, F.lit('"text"')).otherwise(F.to_json(F.array("url", F.lit("second")))).alias("payload"),
        at.alias("cached_at"),
    )
    older = text.where(i % 2 == 0).select(
        i, "cache_type", "cache_key", F.lit('["old",null]').alias("payload"),
        F.expr("cached_at - make_interval(0, 0, 0, 0, 500, 0, 0)").alias("cached_at"),
    )
    search = pages.select(
        i,
        F.lit(SEARCH_KIND).alias("cache_type"),
        search_key(title, (i % 8 + 1).cast("int"), F.regexp_extract("html", LANG, 1)).alias("cache_key"),
        F.when(i % 11 == 0, F.to_json(F.array(F.struct("url"))))
        .otherwise(F.lit('{"organic_results":[],"related_questions":[]}')).alias("payload"),
        at.alias("cached_at"),
    )
    return older, text.unionByName(search)


def store(spark: SparkSession, sf_dir: str):
    """A store with both, saved one after the other. Its folder outlives the call, as the caller runs the query."""
    from termgap.operators.reuse import Store
    from termgap.session import Staging

    kept = Store(spark, f"{Staging(spark).root}/store")
    for entries in cache(spark, sf_dir):
        kept.save(entries.drop("page_id"))
    return kept
