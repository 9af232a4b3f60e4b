"""Reuse of stored results, assembled outputs and sinks."""

from __future__ import annotations

import functools
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgap.operators import context, report, reuse, sentiment, tfidf
from termgap.plans.analysis import run
from termgap.queries import inputs, mining, terms
from termgap.queries import tables as t
from termgap.queries.fixtures import resources
from termgap.queries.registry import query
from termgap.queries.sql import RUN, lit, with_
from termgap.session import Staging
from termgap.sinks import writers
from termgap.sinks.writers import context_text
from termgap.sources.references import attach_references


def now():
    return F.expr(t.NOW)


WANTED = """SELECT page_id, md5(lower('text_v2_' || url)) AS cache_key FROM pages"""


def wanted_texts(spark, sf):
    return t.read(spark, sf, "pages").select("page_id", reuse.text_key(F.col("url")).alias("cache_key"))


@query("k1_reuse_keys", with_("""
    SELECT query_id, md5(lower('serp_v2_' || query || '_' || num_results || '_' || language)) AS cache_key FROM searches"""))
def k1(spark, sf):
    key = reuse.search_key(F.col("query"), F.col("num_results"), F.col("language"))
    return t.payloads(spark, sf).select("query_id", key.alias("cache_key"))


@query("k2_namespaces", with_("SELECT cache_type, count(*) AS entries, count(DISTINCT cache_key) AS keys FROM stored GROUP BY 1"))
def k2(spark, sf):
    entries = t.store(spark, sf).view().entries()
    return entries.groupBy("cache_type").agg(F.count("*").alias("entries"), F.countDistinct("cache_key").alias("keys"))


@query("k3_fresh_entries", with_(f"""
    SELECT page_id, cache_type, cache_key, CAST(epoch(cached_at) AS BIGINT) AS at, epoch({t.NOW}) - epoch(cached_at) < 604800 AS fresh FROM cache"""))
def k3(spark, sf):
    """Every entry of both commits, the stale and the replaced ones too, and whether it is fresh."""
    older, newer = t.cache(spark, sf)
    return older.unionByName(newer).select("page_id", "cache_type", "cache_key", F.unix_timestamp("cached_at").alias("at"), reuse.is_fresh(now()).alias("fresh"))


def looked_up(spark, sf, use_cache=True):
    return t.store(spark, sf).view().lookup(wanted_texts(spark, sf), reuse.TEXT_KIND, now(), use_cache=use_cache)


@query("k4_hits_and_misses", with_(f"""
    SELECT w.page_id, w.cache_key, l.payload, l.cache_key IS NOT NULL AS hit FROM ({WANTED}) w
    LEFT JOIN live l ON l.cache_key = w.cache_key AND l.cache_type = 'text_v2'"""))
def k4(spark, sf):
    return looked_up(spark, sf).select("page_id", "cache_key", "payload", F.col("payload").isNotNull().alias("hit"))


@query("j11_cache_lookup", with_(f"""
    SELECT w.page_id FROM ({WANTED}) w WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.cache_key = w.cache_key)"""))
def j11(spark, sf):
    return looked_up(spark, sf).where(F.col("payload").isNull()).select("page_id")


@query("k5_latest_entry", with_("SELECT cache_type, cache_key, payload, CAST(epoch(cached_at) AS BIGINT) AS at FROM latest"))
def k5(spark, sf):
    return t.store(spark, sf).view().latest().select("cache_type", "cache_key", "payload", F.unix_timestamp("cached_at").alias("at"))


@query("k6_stored_outcomes", with_("""
    SELECT md5(lower('text_v2_' || url)) AS cache_key, text IS NULL AS negative,
           error_code || coalesce(': ' || error_detail, '') AS reason FROM classified
    UNION ALL SELECT md5(lower('serp_v2_' || query || '_' || num_results || '_' || language)), false, NULL FROM searches WHERE error IS NULL"""))
def k6(spark, sf):
    texts = reuse.text_entries(inputs.classified(spark, sf), now())
    found = t.payloads(spark, sf).join(inputs.searches(spark, sf).select("query_id", "error"), "query_id")
    entries = texts.unionByName(reuse.search_entries(found, now()))
    is_text = F.col("cache_type") == "text_v2"
    stored, reason = reuse.stored_text(F.col("payload"))
    return entries.select(
        "cache_key",
        F.when(is_text, stored.isNull()).otherwise(False).alias("negative"),
        F.when(is_text, reason).alias("reason"),
    )


@query("w6_cache_entries", with_("""
    SELECT 'text_v2' AS cache_type, md5(lower('text_v2_' || url)) AS cache_key, text, error_code || coalesce(': ' || error_detail, '') AS reason FROM classified
    UNION ALL SELECT DISTINCT 'serp_v2', md5(lower('serp_v2_' || query || '_' || num_results || '_' || language)), NULL, NULL FROM searches WHERE error IS NULL"""))
def w6(spark, sf):
    """Outcomes of a run saved in two commits and read back."""
    kept = reuse.Store(spark, f"{Staging(spark).root}/store")
    kept.save(reuse.text_entries(inputs.classified(spark, sf), now()))
    found = t.payloads(spark, sf).join(inputs.searches(spark, sf).select("query_id", "error"), "query_id")
    kept.save(reuse.search_entries(found, now()))
    is_text = F.col("cache_type") == reuse.TEXT_KIND
    text, reason = reuse.stored_text(F.col("payload"))
    return kept.view().latest().select("cache_type", "cache_key", F.when(is_text, text).alias("text"), F.when(is_text, reason).alias("reason"))


GERMAN = "SELECT md5(lower('serp_v2_' || query || '_' || num_results || '_' || language)) FROM searches WHERE language = 'de'"


def german(spark, sf):
    return t.payloads(spark, sf).where(F.col("language") == "de")


@query("k7_invalidated", with_(f"SELECT cache_type, cache_key FROM latest WHERE cache_key NOT IN ({GERMAN})"))
def k7(spark, sf):
    kept = t.store(spark, sf)
    kept.invalidate(german(spark, sf))
    return kept.view().latest().select("cache_type", "cache_key")


@query("k8_cleared", with_(f"""
    SELECT 1 AS step, 'save' AS action, cache_type, count(DISTINCT cache_key) AS keys FROM cache WHERE payload = '["old",null]' GROUP BY ALL
    UNION ALL SELECT 2, 'save', cache_type, count(*) FROM latest GROUP BY ALL
    UNION ALL SELECT 3, 'invalidate', cache_type, count(*) FROM latest WHERE cache_key NOT IN ({GERMAN}) GROUP BY ALL
    UNION ALL SELECT 5, 'save', cache_type, count(DISTINCT cache_key) FROM cache WHERE payload = '["old",null]' GROUP BY ALL
    UNION ALL SELECT 6, 'invalidate', cache_type, count(DISTINCT cache_key) FROM cache WHERE payload = '["old",null]' GROUP BY ALL
    UNION ALL SELECT 7, 'save', cache_type, count(*) FROM latest GROUP BY ALL"""))
def k8(spark, sf):
    """Live keys of a store after each of its commits, read by version: the fourth clears it, so that step has no row."""
    kept = t.store(spark, sf)
    older, newer = t.cache(spark, sf)
    kept.invalidate(german(spark, sf))
    kept.clear()
    kept.save(older.drop("page_id"))
    kept.invalidate(german(spark, sf))
    kept.save(newer.drop("page_id"))
    states = [
        kept.view(version).latest().groupBy("cache_type").agg(F.count("*").alias("keys")).select(F.lit(k).alias("step"), F.lit(action).alias("action"), "cache_type", "keys")
        for k, (version, action) in enumerate(kept.commits(), 1)
    ]
    return reduce(DataFrame.unionByName, states)


@query("k9_bypass", with_(f"""
    SELECT w.page_id, l.cache_key IS NOT NULL AS hit, false AS hit_when_bypassed FROM ({WANTED}) w
    LEFT JOIN live l ON l.cache_key = w.cache_key AND l.cache_type = 'text_v2'"""))
def k9(spark, sf):
    used = looked_up(spark, sf).select("page_id", F.col("payload").isNotNull().alias("hit"))
    bypassed = looked_up(spark, sf, use_cache=False).select("page_id", F.col("payload").isNotNull().alias("hit_when_bypassed"))
    return used.join(bypassed, "page_id")


def cluster_lines_input(spark, sf, given=None):
    """Cluster rows for the texts: the first step of the clustering, which SQL can repeat."""
    from termgap.operators import clusters as cl

    centres, indexed = mining.centroids(spark, sf, given)
    return cl.cluster_terms(centres, indexed)


def keyword_questions(spark, sf):
    """The user turns of one conversation as the questions of keyword ``src<n>``: the first of those with number n mod 20."""
    turns = t.read(spark, sf, "conversations").withColumn("query_id", F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")))
    first = turns.groupBy("query_id").agg(F.min("conv_id").alias("conv_id"))
    return turns.join(first, ["query_id", "conv_id"], "left_semi").where("role = 'user'").select("query_id", F.col("turn").alias("pos"), F.col("text").alias("question"))


def conversation_questions(spark, sf):
    """The user turns of every conversation, each a keyword of its own."""
    turns = t.read(spark, sf, "conversations").where("role = 'user'")
    return turns.select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("query_id"), F.col("turn").alias("pos"), F.col("text").alias("question"))


ASKED = """SELECT 'src' || (conv_id % 20) AS query_id, turn AS pos, text AS question FROM conversations
    WHERE role = 'user' AND conv_id IN (SELECT min(conv_id) FROM conversations GROUP BY conv_id % 20)"""


def page_parts(spark, sf):
    """Scored pages, their top terms and tone, and the vocabulary, each staged once for every output that reads it.

    The folder outlives the call, as the caller runs the query.
    """
    staging = Staging(spark)
    scored, vocab = terms.scored(spark, sf, carry=("url",))
    scored = staging.keep(scored, "scores")
    return {
        "given": (scored, vocab, staging),
        "page_terms": staging.keep(tfidf.page_top_terms(scored), "page_top"),
        "sentiment": staging.keep(mining.tone(spark, sf), "tone"),
    }


def context_parts(spark, sf):
    """Those and what the context shows of a keyword, staged too."""
    pages = page_parts(spark, sf)
    staging = pages["given"][2]
    top = staging.keep(tfidf.top_terms(tfidf.term_means(pages["page_terms"])), "top_terms")
    return pages | {
        "top_terms": top,
        "missing": terms.gap.missing_terms(top, terms.ref_tokens(spark, sf)),
        "entities": staging.keep(mining.entities.overall_entities(mining.per_page(spark, sf)), "entities"),
        "clusters": staging.keep(cluster_lines_input(spark, sf, pages["given"]), "clusters"),
        "questions": keyword_questions(spark, sf),
        "overall_sentiment": sentiment.overall_sentiment(pages["sentiment"]),
    }


def contexts(spark, sf, parts=None):
    parts = parts or context_parts(spark, sf)
    own = attach_references(t.requests(spark, sf), t.references(spark, sf))
    named = [parts[name] for name in ("top_terms", "missing", "clusters", "entities", "questions", "overall_sentiment")]
    return context.recommendation_context(t.requests(spark, sf), *named, own)


CONTEXT_SQL = """
    SELECT r.query_id, r.query,
           coalesce(a.v, 'Keine gefunden.') AS top_terms, coalesce(b.v, 'Keine (oder kein Referenztext vorhanden).') AS missing,
           'Keine Cluster gefunden.' AS clusters, coalesce(c.v, 'Keine relevanten Entitäten gefunden.') AS entities,
           'Keine ''People Also Ask''-Fragen gefunden.' AS questions, coalesce(printf('%.2f', d.sentiment), 'N/A.') AS sentiment,
           CASE WHEN e.ref_text IS NULL THEN 'Keiner vorhanden.' WHEN length(e.ref_text) > 200
                THEN '''' || left(e.ref_text, 200) || '...''' ELSE '''' || e.ref_text || '''' END AS reference
    FROM requests r
    LEFT JOIN (SELECT query_id, string_agg(term || ' (' || printf('%.2f', score) || ')', ', ' ORDER BY rank) AS v
               FROM top WHERE rank <= 20 GROUP BY 1) a ON a.query_id = r.query_id
    LEFT JOIN (SELECT query_id, string_agg(term, ', ' ORDER BY rank) AS v FROM missing GROUP BY 1) b ON b.query_id = r.query_id
    LEFT JOIN (SELECT query_id, string_agg('  - ' || label || ': ' || v, chr(10) ORDER BY label) AS v FROM (
                   SELECT query_id, label, string_agg(surface || ' (' || n || 'x)', ', ' ORDER BY rank) AS v
                   FROM entities WHERE rank <= 5 GROUP BY ALL) GROUP BY 1) c ON c.query_id = r.query_id
    LEFT JOIN overall_tone d ON d.query_id = r.query_id
    LEFT JOIN refs e ON e.query_id = r.query_id"""
CLUSTER_LINES = f"""
    SELECT query_id, string_agg('  - Cluster ' || cluster || ': ' || v || CASE WHEN n > 8 THEN '...' ELSE '' END, chr(10) ORDER BY cluster) AS clusters
    FROM (SELECT query_id, cluster, string_agg(term, ', ' ORDER BY rank) FILTER (WHERE rank <= 8) AS v, max(rank) AS n
          FROM ({mining.CLUSTER_TERMS}) GROUP BY ALL) GROUP BY 1"""
QUESTION_LINES = f"SELECT query_id, string_agg('  - ' || question, chr(10) ORDER BY pos) AS questions FROM ({ASKED}) GROUP BY 1"
NO_QUESTIONS = "'Keine ''People Also Ask''-Fragen gefunden.' AS questions"
CONTEXT_OF_STEP = (
    CONTEXT_SQL.replace("'Keine Cluster gefunden.' AS clusters", "coalesce(k.clusters, 'Keine Cluster gefunden.') AS clusters")
    .replace(NO_QUESTIONS, "coalesce(q.questions, " + NO_QUESTIONS.replace(" AS", ") AS"))
    + f" LEFT JOIN ({CLUSTER_LINES}) k ON k.query_id = r.query_id LEFT JOIN ({QUESTION_LINES}) q ON q.query_id = r.query_id"
)
CONTEXT = mining.step_sql(CONTEXT_OF_STEP)


@query("c15_recommendation_context", CONTEXT)
def c15(spark, sf):
    return contexts(spark, sf)


@query("w4_context_file", mining.step_sql(f"""
    SELECT query_id, concat_ws(chr(10), 'Empfehlungen für: ' || query, '20240108-000000', repeat('=', 30), '',
        'top_terms: ' || top_terms, 'missing: ' || missing, 'clusters: ' || clusters, 'entities: ' || entities,
        'questions: ' || questions, 'sentiment: ' || sentiment, 'reference: ' || reference) AS value FROM ({CONTEXT_OF_STEP})"""))
def w4(spark, sf):
    return context_text(contexts(spark, sf), now())


@query("t8_context_prefixes", with_("""
    SELECT query_id, 'terms' AS part, string_agg(term, ', ' ORDER BY rank) AS shown FROM top WHERE rank <= 20 GROUP BY 1
    UNION ALL SELECT query_id, 'reference', CASE WHEN length(ref_text) > 200 THEN '''' || left(ref_text, 200) || '...''' ELSE '''' || ref_text || '''' END
    FROM refs WHERE ref_text <> ''"""))
def t8(spark, sf):
    listed = terms.top(spark, sf).where(F.col("rank") <= 20).groupBy("query_id").agg(
        context._in_order(["rank"], F.col("term"), ", ").alias("shown")
    )
    excerpt = t.references(spark, sf).where("ref_text <> ''").select(
        "query_id", F.lit("reference").alias("part"), context.reference_excerpt(F.col("ref_text")).alias("shown")
    )
    return listed.select("query_id", F.lit("terms").alias("part"), "shown").unionByName(excerpt)


@query("c15_cluster_lines", mining.step_sql(CLUSTER_LINES))
def c15_clusters(spark, sf):
    return context.cluster_lines(cluster_lines_input(spark, sf))


@query("c15_question_lines", """
    SELECT 'conv' || conv_id AS query_id, string_agg('  - ' || text, chr(10) ORDER BY turn) AS questions
    FROM conversations WHERE role = 'user' GROUP BY 1""")
def c15_questions(spark, sf):
    return context.question_lines(conversation_questions(spark, sf))


def report_parts(spark, sf):
    """Every section, the context from the same staged parts."""
    parts = context_parts(spark, sf)
    return parts | {"cloud": tfidf.cloud_weights(parts["top_terms"]), "context": contexts(spark, sf, parts), "failed": inputs.w5(spark, sf)}


def _sections(page_tops: str, questions: str, entities: str = "entities", tone: str = "tone", overall: str = "overall_tone") -> str:
    def part(name, ord_, sub, label, value, source):
        return f"SELECT query_id, {lit(name)} AS section, CAST({ord_} AS BIGINT) AS ord, CAST({sub} AS BIGINT) AS sub, {label} AS label, {value} AS value FROM {source}"

    url = inputs.URL70
    n = "CAST(round({}, 6) AS VARCHAR)"
    return " UNION ALL ".join([
        part("cloud", 0, 0, "word", n.format("weight"), "cloud"),
        part("top_terms", "rank", 0, "term", n.format("score"), "top"),
        part("missing", "rank", 0, "term", "NULL", "missing"),
        part("entities", "rank", 0, "label || ': ' || surface", "CAST(n AS VARCHAR)", entities),
        part("overall_sentiment", 0, 0, "NULL", n.format("sentiment"), overall),
        part("sentiment", "doc_ord", 0, url, n.format("sentiment"), tone),
        part("questions", "pos", 0, "question", "NULL", questions),
        part("page_terms", "doc_ord", "rank", url, "term", page_tops),
        part("failed", "rank", 0, url, "reason", "failed"),
    ])


PAGE_TOPS = "(SELECT t.*, p.url FROM page_top t JOIN page_sizes p ON p.query_id = t.query_id AND p.doc_ord = t.doc_ord)"


def _context_rows(context: str, parts: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT query_id, 'context' AS section, CAST(0 AS BIGINT) AS ord, CAST(0 AS BIGINT) AS sub, {lit(part)} AS label, {part} AS value FROM ({context})" for part in parts
    )


PARTS = ("top_terms", "missing", "entities", "questions", "sentiment", "reference")


def _report_sql() -> str:
    clusters = f"SELECT query_id, 'clusters', CAST(cluster AS BIGINT), CAST(rank AS BIGINT), term, NULL FROM ({mining.CLUSTER_TERMS})"
    return " UNION ALL ".join([_sections(PAGE_TOPS, f"({ASKED})"), clusters, _context_rows(CONTEXT_OF_STEP, (*PARTS, "clusters"))])


def _run_context() -> str:
    """The context as rows, without its line of clusters."""
    context = CONTEXT_SQL.replace("FROM entities WHERE", "FROM run_entities WHERE").replace("JOIN overall_tone", "JOIN run_overall")
    context = context.replace(NO_QUESTIONS, "coalesce('  - ' || q.question, " + NO_QUESTIONS.replace(" AS", ") AS")) + " LEFT JOIN questions q ON q.query_id = r.query_id"
    return _context_rows(context, PARTS)


@functools.cache
def full_run(spark, sf):
    """Every output of the whole run from requests, payloads and crawled pages, with a store of its own.

    Queries of one session share it: it is staged, and its folder outlives the call, as the caller runs the query.
    """
    staging = Staging(spark)
    kept = reuse.Store(spark, f"{staging.root}/store")
    out = run(t.run_requests(spark, sf), t.run_payloads(spark, sf), t.crawl(spark, sf), t.run_references(spark, sf), resources(spark), staging, now(), store=kept)
    return out | {"report": staging.keep(out["report"], "report"), "runs": staging.keep(out["runs"], "runs"), "store": kept}


@query("m2_full_run", with_(
    _sections(PAGE_TOPS, "questions", "run_entities", "run_tone", "run_overall").replace(" AS section", " AS part")
    + " UNION ALL SELECT query_id, 'status', 0, 0, coalesce(error, 'ok'), NULL FROM run_state UNION ALL " + _run_context(), RUN))
def m2_full(spark, sf):
    """All sections of the report and every keyword's status; the clusters, which SQL can't repeat, are a query of their own."""
    out = full_run(spark, sf)
    rows = out["report"].where("section <> 'clusters' AND NOT (section = 'context' AND label = 'clusters')").withColumnRenamed("section", "part")
    zero = F.lit(0).cast("bigint")
    state = out["runs"].select("query_id", F.lit("status").alias("part"), zero.alias("ord"), zero.alias("sub"), F.coalesce("error", F.lit("ok")).alias("label"), F.lit(None).cast("string").alias("value"))
    return rows.unionByName(state)


@query("m2_full_run_clusters")
def m2_clusters(spark, sf):
    """The clusters of the whole run, as the report and the context show them."""
    return full_run(spark, sf)["report"].where("section = 'clusters' OR (section = 'context' AND label = 'clusters')").withColumnRenamed("section", "part")


@query("m2_second_run", with_("""
    SELECT 'search' AS kind, count(*) FILTER (WHERE k % 11 <> 10) AS hits, count(*) FILTER (WHERE k % 11 = 10) AS misses FROM requests
    UNION ALL SELECT 'page', count(*) FILTER (WHERE c.url IS NOT NULL), count(*) FILTER (WHERE c.url IS NULL)
    FROM (SELECT DISTINCT url FROM run_results) r LEFT JOIN classified c ON c.url = r.url""", RUN))
def m2_second(spark, sf):
    """What a second run finds stored: all searches but the failed ones, and every page that was crawled."""
    staging, store = Staging(spark), full_run(spark, sf)["store"]
    out = run(t.run_requests(spark, sf), t.run_payloads(spark, sf), t.crawl(spark, sf), t.run_references(spark, sf), resources(spark), staging, now(), store=store)
    return out["reuse"].select("kind", "hits", "misses")


@query("w3_report", mining.step_sql(_report_sql()))
def w3(spark, sf):
    return report.report_rows(report_parts(spark, sf))


@query("u3_report_sections", mining.step_sql(f"SELECT section, count(*) AS n FROM ({_report_sql()}) GROUP BY 1"))
def u3(spark, sf):
    return w3(spark, sf).groupBy("section").agg(F.count("*").alias("n"))


COUNTED = """
    SELECT r.query_id, r.query, r.language, r.num_results, s.error IS NULL AS success, s.error, coalesce(a.n, 0) AS n_results, coalesce(a.ok, 0) AS n_processed,
           coalesce(u.n_pages, 0) AS n_pages, coalesce(v.n, 0) AS n_features, e.query_id IS NOT NULL AND e.ref_text <> '' AS reference_used
    FROM requests r JOIN run_state s ON s.query_id = r.query_id
    LEFT JOIN (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE error_code IS NULL) AS ok FROM run_attached GROUP BY 1) a ON a.query_id = r.query_id
    LEFT JOIN usable u ON u.query_id = r.query_id LEFT JOIN (SELECT query_id, count(*) AS n FROM vocab GROUP BY 1) v ON v.query_id = r.query_id
    LEFT JOIN refs e ON e.query_id = r.query_id"""


def _counted(runs):
    """The record of each accepted keyword."""
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    known = runs.where("error IS NULL OR error NOT LIKE 'rejected%'")
    return known.select("query_id", "query", "language", "num_results", "success", "error", zero("n_results"), zero("n_processed"), zero("n_pages"), zero("n_features"), "reference_used")


@query("a16_summary", with_(f"""
    SELECT c.query_id, c.success, coalesce(t.n, 0) AS terms, coalesce(m.n, 0) AS missing, coalesce(e.n, 0) AS labels, coalesce(e.first, '') AS first_entity,
           coalesce(q.n, 0) AS questions, round(o.sentiment, 6) AS sentiment, r.k % 3 = 0 AND coalesce(c.n_features, 0) > 0 AS clustered
    FROM ({COUNTED}) c JOIN requests r ON r.query_id = c.query_id
    LEFT JOIN (SELECT query_id, count(*) AS n FROM top GROUP BY 1) t ON t.query_id = c.query_id
    LEFT JOIN (SELECT query_id, count(*) AS n FROM missing GROUP BY 1) m ON m.query_id = c.query_id
    LEFT JOIN (SELECT query_id, count(DISTINCT label) AS n, arg_min(surface || ' ' || n, label) FILTER (WHERE rank = 1) AS first FROM run_entities GROUP BY 1) e ON e.query_id = c.query_id
    LEFT JOIN (SELECT query_id, count(*) AS n FROM questions GROUP BY 1) q ON q.query_id = c.query_id
    LEFT JOIN run_overall o ON o.query_id = c.query_id""", RUN))
def a16(spark, sf):
    """The nested summary of the whole run, told by the sizes of its lists, its first entity and whether it has clusters."""
    rows = full_run(spark, sf)["summary"].where("error IS NULL OR error NOT LIKE 'rejected%'")
    size = lambda c: F.greatest(F.size(F.coalesce(c, F.array().cast(dict(rows.dtypes)[c]))), F.lit(0)).cast("bigint")
    entities = F.array_sort(F.map_entries("overall_entities"))
    first = F.get(F.get(entities, F.lit(0))["value"], F.lit(0))
    return rows.select(
        "query_id", "success", size("overall_top_terms_with_scores").alias("terms"), size("missing_terms").alias("missing"),
        F.coalesce(F.size(F.map_keys("overall_entities")), F.lit(0)).cast("bigint").alias("labels"), F.coalesce(F.concat(first["entity"], F.lit(" "), first["count"].cast("string")), F.lit("")).alias("first_entity"),
        size("related_questions").alias("questions"), F.round("overall_sentiment", 6).alias("sentiment"), (F.coalesce(F.size(F.map_keys("clusters")), F.lit(0)) > 0).alias("clustered"),
    )


@query("w2_summary", with_("""
    SELECT query_id, 'top_terms_by_url' AS part, doc_ord AS ord, '["' || string_agg(term, '","' ORDER BY rank) || '"]' AS payload
    FROM page_top GROUP BY query_id, doc_ord
    UNION ALL SELECT query_id, 'sentiment_by_url', doc_ord, CAST(round(sentiment, 6) AS VARCHAR) FROM tone
    UNION ALL SELECT query_id, 'failed_urls', rank, reason FROM failed"""))
def w2(spark, sf):
    parts = page_parts(spark, sf)
    rows = report.page_summary_rows(parts["page_terms"], parts["sentiment"], inputs.w5(spark, sf))
    shown = F.when(F.col("part") == "sentiment_by_url", F.round(F.col("payload").try_cast("double"), 6).cast("string")).otherwise(F.col("payload"))
    return rows.select("query_id", "part", "ord", shown.alias("payload"))


@functools.cache
def written_run(spark, sf, output_format):
    """The whole run written in a format; its folder."""
    return writers.write_run(full_run(spark, sf), Staging(spark).root, now(), "whole run", output_format)


@query("w2_keyword_records", with_(COUNTED, RUN))
def w2_records(spark, sf):
    """The keyword records of the written summary, read back."""
    schema = "query_id STRING, query STRING, language STRING, num_results INT, success BOOLEAN, error STRING, n_results BIGINT, n_processed BIGINT, n_pages BIGINT, n_features BIGINT, reference_used BOOLEAN"
    return _counted(spark.read.schema(schema).json(f"{written_run(spark, sf, 'json')}/summary/keywords"))


ROWS_WRITTEN = {"tfidf": "scores", "failed": "failed", "runs": "raw_keywords"}


@query("w7_selected_format", with_(" UNION ALL ".join(
    f"SELECT '{kind}' AS format, '{name}' AS output, count(*) AS n FROM {source}"
    for kind in writers.FORMATS for name, source in ROWS_WRITTEN.items() if name != "tfidf" or kind in ("csv", "all")), RUN))
def w7(spark, sf):
    """Rows of the outputs that each format writes, read back from runs whose manifest names them."""
    counted = []
    for kind in writers.FORMATS:
        folder = written_run(spark, sf, kind)
        for name in set(writers.read_manifest(spark, folder).first().outputs) & set(ROWS_WRITTEN):
            rows = spark.read.option("header", True).csv(f"{folder}/{name}") if name == "tfidf" else spark.read.parquet(f"{folder}/{name}")
            counted.append(rows.groupBy().agg(F.lit(kind).alias("format"), F.lit(name).alias("output"), F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, counted)


@query("w8_run_table", with_(f"SELECT *, true AS timed, 'summary context failed' AS outputs FROM ({COUNTED})", RUN))
def w8(spark, sf):
    """The run table of a run written as JSON."""
    runs = spark.read.parquet(f"{written_run(spark, sf, 'json')}/runs")
    extra = runs.select("query_id", (F.col("duration_seconds") > 0).alias("timed"), F.array_join("output_files", " ").alias("outputs"))
    return _counted(runs).join(extra, "query_id")


@query("c16_status", with_("SELECT query_id, error FROM run_state", RUN))
def c16(spark, sf):
    """The status of every keyword of the whole run, from its own searches, pages and terms."""
    return full_run(spark, sf)["runs"].select("query_id", "error")
