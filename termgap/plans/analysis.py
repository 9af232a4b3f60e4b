"""The analysis from page texts, and the whole run from search payloads and crawled pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termgap.operators import clusters as cl
from termgap.operators import context, entities, gap, report, reuse, sentiment, status, tfidf
from termgap.operators.reuse import Store
from termgap.operators.tokens import page_tokens
from termgap.params import DEFAULT, Params
from termgap.session import Staging, lookup_side, spread
from termgap.sources.pages import attach_pages, classify, failed_pages, one_per_url, valid_pages
from termgap.sources.references import attach_references
from termgap.sources.requests import accept_requests
from termgap.sources.resources import Resources
from termgap.sources.search import organic_results, parse_payloads, related_questions

FLAGS = ("ner", "cluster", "sentiment")


def term_gap(
    docs: DataFrame, references: DataFrame, resources: Resources, staging: Staging, params: Params = DEFAULT
) -> DataFrame:
    """Top terms per keyword and whether the own text lacks them.

    The tokens of the texts are staged: frequent words are counted from them, then the terms made of these. The terms and
    the vocabulary are staged too: it is small and its exact size decides how it is joined.
    """
    tokens = page_tokens(spread(docs, "query_id", "doc_ord"), resources, params)
    pages = staging.keep(tfidf.frequent_terms(tokens, staging, params), "page_terms")
    scored = tfidf.page_scores(pages, staging.keep(tfidf.vocabulary(pages, params), "vocabulary"))
    top = tfidf.top_terms(tfidf.term_means(tfidf.page_top_terms(scored, params)), params)
    own = gap.reference_tokens(references, resources, params)
    missing = gap.is_missing(F.col("term"), F.col("ref_norm"), F.col("ref_tokens"))
    return top.join(own, "query_id", "left").select(
        "query_id", "rank", "term", "score", "pages", F.coalesce(missing, F.lit(False)).alias("is_missing")
    )


def analyze(
    requests: DataFrame,
    docs: DataFrame,
    references: DataFrame,
    resources: Resources,
    staging: Staging,
    params: Params = DEFAULT,
) -> dict[str, DataFrame]:
    """All analysis outputs for ``docs(query_id, doc_ord, url, lang, text)``.

    Pages are tokenised once. Their tokens and the counts of the terms made of frequent words are staged; every later step
    reads only the columns it needs.
    Optional stages run for the keywords whose request has the flag set.
    """
    docs = spread(docs, "query_id", "doc_ord")
    carry = ("url", *[flag for flag in FLAGS if flag in docs.columns])
    pages = staging.keep(tfidf.frequent_terms(page_tokens(docs, resources, params, carry=carry), staging, params), "page_terms")
    page_key = pages.where(F.col("n_tokens") >= params.min_page_tokens).select("query_id", "doc_ord")
    vocab = staging.keep(tfidf.vocabulary(pages, params), "vocabulary")
    scored = staging.keep(tfidf.page_scores(pages, vocab), "scores")
    page_top = tfidf.page_top_terms(scored, params)
    top = staging.keep(tfidf.top_terms(tfidf.term_means(page_top), params), "top_terms")
    out = {
        "usable": tfidf.usable_counts(pages, params),
        "vocabulary": vocab,
        "tfidf": tfidf.score_rows(scored),
        "term_table": report.term_tables(scored, vocab, params),
        "page_terms": page_top,
        "top_terms": top,
        "missing": gap.missing_terms(top, gap.reference_tokens(references, resources, params)),
        "cloud": tfidf.cloud_weights(top, params),
    }

    found = entities.entity_matches(status.enabled(docs, requests, "ner"), resources.gazetteer, params)
    per_page = entities.page_entities(found).join(page_key, ["query_id", "doc_ord"], "left_semi")
    out["page_entities"] = staging.keep(per_page, "page_entities")
    out["entities"] = entities.overall_entities(out["page_entities"], params)

    tone = sentiment.page_sentiment(status.enabled(docs, requests, "sentiment"), resources.polarity, params, resources.modifiers)
    out["sentiment"] = staging.keep(tone.join(page_key, ["query_id", "doc_ord"], "left_semi"), "page_sentiment")
    out["overall_sentiment"] = sentiment.overall_sentiment(out["sentiment"])

    indexed = staging.keep(cl.indexed_vocabulary(vocab), "indexed_vocabulary")
    vectors = staging.keep(cl.page_vectors(status.enabled(scored, requests, "cluster"), params), "page_vectors")
    assigned, centres = cl.fit(vectors, indexed, staging, params)
    out["assigned"] = assigned.select("query_id", "doc_ord", "cluster", "d2")
    out["clusters"] = cl.cluster_terms(centres, indexed, params)
    return out


def _searches(requests: DataFrame, payloads: DataFrame, store: Store | None, run_at: Column, staging: Staging, params: Params) -> tuple[DataFrame, DataFrame | None]:
    """Payloads of the requests, from the store where it has them, and what the lookup found. New good ones are saved."""
    payloads = payloads.join(requests.select("query_id"), "query_id", "left_semi")
    if store is None:
        return payloads, None
    key = reuse.search_key(F.col("query"), F.col("num_results"), F.col("language"))
    asked = requests.select("query_id", "query", "language", "num_results", key.alias("cache_key"))
    looked = staging.keep(store.view().lookup(asked, reuse.SEARCH_KIND, run_at, params), "search_lookup")
    missing = looked.where(F.col("payload").isNull()).select("query_id", "query", "language", "num_results")
    captured = payloads.drop("query", "language", "num_results").join(missing, "query_id")
    new = captured.join(parse_payloads(captured).select("query_id", "error"), "query_id")
    store.save(reuse.search_entries(new, run_at))
    stored = looked.where(F.col("payload").isNotNull()).select(
        "query_id", "query", "language", F.lit(200).alias("status"), F.lit(None).cast("string").alias("error_class"), "payload"
    )
    return stored.unionByName(captured.select(*stored.columns)), looked


def _outcomes(urls: DataFrame, crawl: DataFrame, store: Store | None, run_at: Column, staging: Staging, params: Params) -> tuple[DataFrame, DataFrame | None]:
    """Outcomes of the pages that some result names; only those without a stored one are extracted, and saved."""
    columns = ["url", "text", "error_code", "error_detail"]
    looked = None
    if store is not None:
        asked = urls.withColumn("cache_key", reuse.text_key(F.col("url")))
        looked = staging.keep(store.view().lookup(asked, reuse.TEXT_KIND, run_at, params), "text_lookup")
        urls = looked.where(F.col("payload").isNull()).select("url")
    wanted = crawl.join(lookup_side(urls), "url", "left_semi")
    new = staging.keep(classify(spread(wanted, "url"), params).select(*columns), "classified")
    if store is None:
        return new, None
    store.save(reuse.text_entries(one_per_url(new), run_at))
    return reuse.stored_outcomes(looked).unionByName(new), looked


def run(
    requests: DataFrame,
    payloads: DataFrame,
    crawl: DataFrame,
    references: DataFrame,
    resources: Resources,
    staging: Staging,
    run_at: Column,
    params: Params = DEFAULT,
    store: Store | None = None,
    use_cache: bool = True,
) -> dict[str, DataFrame]:
    """From requests, captured search payloads and crawled pages to every output table.

    Requests with ``num_results_raw`` are checked first; rejected ones appear in ``runs`` only. With a store, searches and
    pages it answers are not parsed or extracted again, and new outcomes are saved; ``use_cache=False`` leaves it alone.
    The result URLs take language and flags from their request before page texts are attached, so texts are joined once
    and never again.
    """
    rejected = None
    if "num_results_raw" in requests.columns:
        requests, rejected = accept_requests(requests, params)
    store = store if use_cache else None
    payloads, searched = _searches(requests, payloads, store, run_at, staging, params)
    searches = parse_payloads(payloads)
    organic = staging.keep(organic_results(searches, requests, params), "organic")
    questions = related_questions(searches)
    flags = requests.select("query_id", F.col("language").alias("lang"), *FLAGS)
    outcomes, read = _outcomes(organic.select("url").distinct(), crawl, store, run_at, staging, params)
    attached = staging.keep(attach_pages(organic.join(flags, "query_id"), outcomes), "attached")
    failed = failed_pages(attached)
    docs = valid_pages(attached).select(
        "query_id", F.col("rank").cast("bigint").alias("doc_ord"), "url", "lang", "text", *FLAGS
    )
    out = analyze(requests, docs, references, resources, staging, params)
    counts = status.page_counts(attached)
    runs = status.run_status(requests, searches, counts, out["usable"], out["vocabulary"])
    runs = runs.join(status.joined_reasons(failed), "query_id", "left")
    own = attach_references(requests.select("query_id"), references.select("query_id", "ref_text"))
    runs = runs.join(own.select("query_id", F.col("has_reference").alias("reference_used")), "query_id", "left")
    if rejected is not None:
        refused = rejected.select("*", F.lit(False).alias("success"), F.concat(F.lit("rejected: "), "reject_reason").alias("error")).drop("reject_reason")
        runs = runs.unionByName(refused, allowMissingColumns=True)
    runs = runs.withColumn("run_at", run_at).withColumn("cache_used", F.lit(store is not None))
    out |= {
        "questions": questions,
        "failed": failed,
        "runs": runs,
        "context": context.recommendation_context(
            requests, out["top_terms"], out["missing"], out["clusters"], out["entities"], questions,
            out["overall_sentiment"], own, params,
        ),
    }
    if store is not None:
        found = F.count_if(F.col("payload").isNotNull())
        kinds = [df.groupBy().agg(F.lit(kind).alias("kind"), found.alias("hits"), (F.count("*") - found).alias("misses")) for kind, df in (("search", searched), ("page", read))]
        out["reuse"] = kinds[0].unionByName(kinds[1])
    out["summary"] = report.summary_rows(
        runs, out["top_terms"], out["missing"], out["entities"], out["clusters"], out["overall_sentiment"], questions
    )
    out["page_summary"] = report.page_summary_rows(out["page_terms"], out["sentiment"], failed)
    out["report"] = report.report_rows(out, params)
    return out
