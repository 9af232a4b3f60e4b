"""Relations shared by the oracle statements, written for DuckDB and independent of the Spark plans.

``with_(names, body)`` puts the named relations and all they need in front of a statement.
"""

from __future__ import annotations

import re
from html.entities import html5

from termgap.functions.naming import LONG_NAME_CUT, NOT_ALLOWED, SEPARATOR_RUN
from termgap.functions.text import DIGITS, SPACES, URL, WORD
from termgap.queries import tables as t
from termgap.queries.fixtures import GAZETTEER_SQL, LEXICON_SQL, MODIFIERS_SQL, POLARITY_SQL
from termgap.sources.resources import KEPT_POS, STOP_WORDS_SQL


#: What stands between words.
NO_WORD = r"[^\p{L}\p{N}_]+"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(text: str, pattern: str, replacement: str = "") -> str:
    return f"regexp_replace({text}, {lit(pattern)}, {replacement or lit('')}, 'g')"


def normalise(text: str) -> str:
    clean = sub(sub(text, URL, "' '"), DIGITS, "' '")
    return f"trim({sub(f'''translate({clean}, '\"''-', '   ')''', SPACES, lit(' '))}, ' ')"


# Patterns and word lists of the main text, written for this side alone.
LOST = ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp")
SKIPPED = "'head', 'nav', 'header', 'footer', 'aside', 'form', 'noscript', 'table'"
SKIPPED_IN_LINE = "'select', 'datalist', 'option', 'button', 'svg'"
CUT_AT = (
    "(?i)</?(?:html|body|main|article|section|div|head|nav|header|footer|aside|form|noscript|table|select|datalist|option|button|svg)"
    r"(?:[\s/][^>]*)?>"
)
ADS = r"""\sclass\s*=\s*("[^"]*\b(ad|ads|comments)\b|'[^']*\b(ad|ads|comments)\b|(ad|ads|comments)[\s>])"""


def _resolved(tok: str) -> str:
    """What stands behind an ampersand, the reference in front of it resolved."""
    pattern = "^(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,8}|[a-zA-Z][a-zA-Z0-9]{1,31})(;?)"
    name, end = (f"regexp_extract({tok}, {lit(pattern)}, {group})" for group in (1, 2))
    code = f"""CASE WHEN lower(left({tok}, 2)) = '#x' THEN TRY_CAST('0x' || substr({name}, 3) AS BIGINT)
               WHEN left({tok}, 1) = '#' THEN TRY_CAST(substr({name}, 2) AS BIGINT) END"""
    chars = lit("".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)))
    number = f"""CASE WHEN {code} = 0 OR {code} BETWEEN 55296 AND 57343 OR {code} > 1114111 THEN chr(65533)
                 WHEN {code} BETWEEN 128 AND 159 THEN substr({chars}, CAST({code} - 127 AS BIGINT), 1) ELSE chr(CAST({code} AS INTEGER)) END"""
    known, meant = "[" + ", ".join(map(lit, html5)) + "]", "[" + ", ".join(map(lit, html5.values())) + "]"
    word = f"({meant})[list_position({known}, {name} || {end})]"
    value = f"CASE WHEN left({tok}, 1) = '#' THEN {number} ELSE {word} END"
    return f"coalesce({value} || substr({tok}, 1 + length({name} || {end})), '&' || {tok})"


def with_main_text(source: str, html: str) -> str:
    """The rows of a statement with a column main_text for their column `html`."""
    lost = "|".join(rf"<{e}(?:[\s/][^>]*)?>.*?(?:</{e}\s*>|\z)" for e in LOST)
    clean = sub(html, rf"(?is)<!--.*?(?:-->|\z)|{lost}", "' '")
    cuts = "STRUCT(a BIGINT, b BIGINT, l BOOLEAN)[]"
    blank = f"'open': []::VARCHAR[], 'lvl': 0::BIGINT, 'beg': 0::BIGINT, 'lin': false, 'cuts': []::{cuts}"
    tag = f"""{{'nm': regexp_extract(g[i], '^</?([a-z0-9]+)', 1), 'shut': starts_with(g[i], '</'), 'i': i,
              'opens': NOT starts_with(g[i], '</') AND NOT ends_with(g[i], '/>'), 'ad': regexp_matches(g[i], {lit(ADS)}), {blank}}}"""
    first = f"{{'nm': '', 'shut': false, 'i': 0::BIGINT, 'opens': false, 'ad': false, {blank}}}"
    at, table = "coalesce(list_position(s.open, x.nm), 0)", "coalesce(list_position(s.open, 'table'), 0)"
    rest = f"""CASE WHEN x.opens AND x.nm = 'body' THEN []::VARCHAR[]
               ELSE s.open[1 + CASE WHEN x.shut AND ({table} = 0 OR {at} <= {table} OR x.nm IN ('table', 'body', 'html')) THEN {at} ELSE 0 END:] END"""
    ended = "(s.lvl > 0 AND len(r) < s.lvl)"
    begins = f"(x.opens AND (s.lvl = 0 OR {ended}) AND (x.ad OR x.nm IN ({SKIPPED}, {SKIPPED_IN_LINE})))"
    fold = f"""list_transform([{rest}], lambda r: {{'nm': '', 'shut': false, 'i': 0::BIGINT, 'opens': false, 'ad': false,
        'open': CASE WHEN x.opens THEN list_prepend(x.nm, r) ELSE r END,
        'lvl': CASE WHEN {begins} THEN len(r) + 1 WHEN {ended} THEN 0 ELSE s.lvl END, 'beg': CASE WHEN {begins} THEN x.i ELSE s.beg END,
        'lin': CASE WHEN {begins} THEN x.nm IN ({SKIPPED_IN_LINE}) ELSE s.lin END,
        'cuts': CASE WHEN {ended} THEN list_append(s.cuts, {{'a': s.beg, 'b': x.i, 'l': s.lin}}) ELSE s.cuts END}})[1]"""
    piece = f"""CASE WHEN k = 0 THEN '' WHEN c[k].l THEN ' ' ELSE chr(10) END || coalesce(array_to_string(
        parts[CASE WHEN k = 0 THEN 1 ELSE c[k].b + 1 END:CASE WHEN k = len(c) THEN len(parts) ELSE c[k + 1].a END], chr(10)), '')"""
    joined = f"array_to_string(list_transform(range(len(c) + 1), lambda k: {piece}), '')"
    no_tags = sub(sub(joined, r"(?i)</?(p|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|blockquote|pre|figure|figcaption)(?:[\s/][^>]*)?>", "chr(10)"), "<[a-zA-Z/!?][^>]*>")
    tokens = f"list_transform(string_split({no_tags}, '&'), lambda tok, n: CASE WHEN n = 1 THEN tok ELSE {_resolved('tok')} END)"
    text = sub(sub(f"array_to_string({tokens}, '')", r"[ \t\r\x{00A0}]+", "' '"), r" ?\n[ \n]*", "chr(10)")
    return f"""SELECT * EXCLUDE (_page, g, parts, c), trim({text}, ' ' || chr(10)) AS main_text FROM (
        SELECT * EXCLUDE (st), CASE WHEN st.lvl > 0 THEN list_append(st.cuts, {{'a': st.beg, 'b': len(g) + 1, 'l': st.lin}}) ELSE st.cuts END AS c FROM (
        SELECT *, list_reduce(list_prepend({first}, list_transform(range(1, len(g) + 1), lambda i: {tag})), lambda s, x: {fold}) AS st FROM (
        SELECT *, list_transform(regexp_extract_all(_page, {lit(CUT_AT)}), lambda z: lower(z)) AS g, regexp_split_to_array(_page, {lit(CUT_AT)}) AS parts FROM (
        SELECT *, {clean} AS _page FROM ({source})))))"""


def safe_name(name: str) -> str:
    tidy = f"trim({sub(sub(sub(f'coalesce({name}, {lit(str())})', SEPARATOR_RUN, lit('_')), NOT_ALLOWED), '_+', lit('_'))}, '._')"
    cut = f"regexp_extract(left({tidy}, 100), {lit(LONG_NAME_CUT)}, 1)"
    short = f"trim(CASE WHEN {cut} <> '' THEN {cut} ELSE left({tidy}, 100) END, '._')"
    out = f"CASE WHEN length({tidy}) > 100 THEN {short} ELSE {tidy} END"
    return f"coalesce(nullif({out}, ''), 'leerer_dateiname')"


def lang_of(column: str = "lang") -> str:
    return f"CASE WHEN {column} IN ('de', 'en', 'es', 'fr') THEN {column} ELSE 'de' END"


def clusters_for(n: str) -> str:
    return f"CASE WHEN {n} > 3 THEN least(5, greatest(2, {n} // 2)) ELSE greatest(1, {n}) END"


TITLE = f"regexp_extract(html, {lit(t.TITLE)}, 1)"
PAGE_LANG = f"regexp_extract(html, {lit(t.LANG)}, 1)"

RELATIONS = {
    "stop_words": STOP_WORDS_SQL,
    "lexicon": LEXICON_SQL,
    "gazetteer": GAZETTEER_SQL,
    "polarity": POLARITY_SQL,
    "modifiers": MODIFIERS_SQL,
    "docs": "SELECT source AS query_id, doc_id AS doc_ord, 'doc://' || doc_id AS url, lang, text FROM documents",
    "refs": "SELECT 'src' || item_id AS query_id, 'en' AS lang, text AS ref_text FROM benchmark",
    "requests": """
        SELECT query_id, 'topic ' || query_id AS query,
               CASE n % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'es' ELSE 'fr' END AS language,
               CAST(n % 20 + 1 AS INTEGER) AS num_results, n % 2 = 0 AS ner, n % 3 = 0 AS cluster, n % 5 <> 0 AS sentiment
        FROM (SELECT DISTINCT source AS query_id, CAST(substr(source, 4) AS INTEGER) AS n FROM documents)""",
    "raw_requests": """
        SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '   ' ELSE text END AS query,
               CASE WHEN doc_id % 9 = 0 THEN 'xx' WHEN doc_id % 9 <> 1 THEN lang END AS language,
               CASE doc_id % 7 WHEN 0 THEN '0' WHEN 1 THEN '101' WHEN 2 THEN 'x' WHEN 3 THEN NULL
                    ELSE CAST(doc_id % 100 + 1 AS VARCHAR) END AS num_results_raw,
               CASE doc_id % 8 WHEN 0 THEN 'notes.pdf' WHEN 1 THEN 'own.TXT' WHEN 2 THEN NULL ELSE 'own.txt' END AS reference_name
        FROM documents""",
    "crawl": """
        SELECT page_id, url,
               CASE WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 19 = 0 THEN 503 ELSE 200 END AS status,
               CASE WHEN page_id % 17 = 0 THEN 'Not Found' WHEN page_id % 19 = 0 THEN 'Service Unavailable' ELSE 'OK' END AS reason,
               CASE WHEN page_id % 23 = 0 THEN 'application/pdf' ELSE 'text/HTML; charset=utf-8' END AS content_type,
               CASE WHEN page_id % 29 = 0 THEN 'ConnectionError' WHEN page_id % 31 = 0 THEN 'InvalidURL' END AS error_class,
               CASE WHEN page_id % 37 = 0 THEN '' WHEN page_id % 41 = 0 THEN '<html><body><p>Only a few words.</p></body></html>' ELSE html END AS body
        FROM pages""",
    "extracted": with_main_text("SELECT * FROM crawl", "body"),
    "classified": """
        SELECT url, status, error_class, page_id, error_code,
               CASE WHEN error_code IS NULL THEN main_text END AS text,
               CASE WHEN error_code IN ('network_retries', 'network') THEN coalesce(error_class, 'N/A')
                    WHEN error_code IN ('http_client', 'http_server') THEN status || ' (' || reason || ')'
                    WHEN error_code = 'not_html' THEN lower(content_type)
                    WHEN error_code = 'too_short' THEN length(main_text) || '/150' END AS error_detail
        FROM (SELECT *, CASE WHEN error_class = 'ConnectionError' THEN 'network_retries'
                             WHEN status BETWEEN 400 AND 499 THEN 'http_client' WHEN status >= 500 THEN 'http_server'
                             WHEN error_class IS NOT NULL THEN 'network'
                             WHEN NOT contains(lower(content_type), 'html') THEN 'not_html'
                             WHEN body = '' THEN 'empty_body' WHEN main_text = '' THEN 'no_main_text'
                             WHEN length(main_text) < 150 THEN 'too_short' END AS error_code FROM extracted)""",
    "results": f"""
        SELECT {PAGE_LANG} AS query_id, page_id AS pos, CASE WHEN page_id % 13 <> 0 THEN {TITLE} END AS title,
               CASE WHEN page_id % 43 = 0 THEN 'ftp://host/' || page_id ELSE url END AS url FROM pages""",
    "attached": """
        SELECT r.query_id, r.pos AS rank, r.url, c.text, c.error_detail,
               CASE WHEN c.url IS NULL THEN 'not_crawled' ELSE c.error_code END AS error_code
        FROM results r LEFT JOIN classified c ON r.url = c.url""",
    "failed": """
        SELECT query_id, rank, url, error_code || coalesce(': ' || error_detail, '') AS reason
        FROM attached WHERE error_code IS NOT NULL""",
    "accepted": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM results
                       WHERE title <> '' AND (url LIKE 'http://%' OR url LIKE 'https://%')) WHERE rank <= 100""",
    "searches": f"""
        SELECT page_id, 'q' || page_id AS query_id, {TITLE} AS query, {PAGE_LANG} AS language,
               CAST(page_id % 8 + 1 AS INTEGER) AS num_results,
               CASE WHEN page_id % 41 = 0 THEN 'network: Timeout' WHEN page_id % 31 = 0 THEN 'http: 503'
                    WHEN page_id % 37 = 0 THEN 'invalid_json' END AS error,
               url, html FROM pages""",
    "search_items": f"""
        SELECT query_id, 1 AS p, query AS title, url AS link, num_results FROM searches WHERE error IS NULL
        UNION ALL
        SELECT query_id, p, CASE WHEN p % 4 = 0 THEN '' ELSE names[p - 1] END,
               CASE WHEN p % 5 = 0 THEN 'ftp://host' ELSE site END || hrefs[p - 1], num_results
        FROM (SELECT *, unnest(range(2, len(hrefs) + 2)) AS p FROM (
            SELECT *, regexp_extract_all(html, {lit(t.ANCHOR)}, 1) AS hrefs, regexp_extract_all(html, {lit(t.ANCHOR)}, 2) AS names,
                   regexp_extract(url, {lit(t.SITE)}, 1) AS site FROM searches WHERE error IS NULL))""",
    "organic": """
        SELECT query_id, CAST(rank AS INTEGER) AS rank, title, link AS url FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p) AS rank FROM search_items
            WHERE title <> '' AND (link LIKE 'http://%' OR link LIKE 'https://%')) WHERE rank <= num_results""",
    "questions": """
        SELECT query_id, 1 AS pos, query || '?' AS question FROM searches WHERE error IS NULL AND page_id % 3 <> 2
        UNION ALL
        SELECT query_id, 4, 'Why ' || page_id || '?' FROM searches WHERE error IS NULL AND page_id % 3 <> 2""",
    "words": f"""
        SELECT query_id, doc_ord, {lang_of()} AS lang, unnest(w) AS word, unnest(range(len(w))) AS pos
        FROM (SELECT *, regexp_extract_all(lower({normalise('text')}), {lit(WORD)}) AS w FROM docs)""",
    "tokens": f"""
        SELECT query_id, doc_ord, row_number() OVER (PARTITION BY query_id, doc_ord ORDER BY pos) AS ix, token FROM (
            SELECT w.query_id, w.doc_ord, w.pos, lower(coalesce(l.lemma, w.word)) AS token
            FROM words w LEFT JOIN lexicon l ON l.lang = w.lang AND l.form = w.word
            WHERE NOT EXISTS (SELECT 1 FROM stop_words s WHERE s.lang = w.lang AND s.word = w.word)
              AND coalesce(l.pos, 'NOUN') IN {KEPT_POS}) WHERE length(token) >= 3""",
    "page_sizes": """
        SELECT d.query_id, d.doc_ord, d.url, count(t.token) AS n_tokens FROM docs d
        LEFT JOIN tokens t ON t.query_id = d.query_id AND t.doc_ord = d.doc_ord GROUP BY ALL""",
    "usable": "SELECT query_id, count(*) FILTER (WHERE n_tokens >= 2) AS n_pages FROM page_sizes GROUP BY query_id",
    "terms": """
        SELECT t.query_id, t.doc_ord, t.term FROM (
            SELECT query_id, doc_ord, token AS term FROM tokens
            UNION ALL
            SELECT query_id, doc_ord, token || ' ' || nxt FROM (
                SELECT *, lead(token) OVER (PARTITION BY query_id, doc_ord ORDER BY ix) AS nxt FROM tokens)
            WHERE nxt IS NOT NULL) t
        JOIN page_sizes p ON p.query_id = t.query_id AND p.doc_ord = t.doc_ord AND p.n_tokens >= 2""",
    "counts": "SELECT query_id, doc_ord, term, count(*) AS tf FROM terms GROUP BY ALL",
    "frequency": """
        SELECT query_id, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ctf FROM counts
        GROUP BY query_id, term HAVING count(*) >= 2""",
    "vocab": """
        SELECT f.*, ln((1 + u.n_pages) / (1 + f.df)) + 1 AS idf
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ctf DESC, term) AS vocab_rank FROM frequency) f
        JOIN usable u ON u.query_id = f.query_id WHERE vocab_rank <= 200""",
    "scores": """
        SELECT query_id, doc_ord, term, tf, weight / sqrt(sum(weight * weight) OVER (PARTITION BY query_id, doc_ord)) AS score
        FROM (SELECT c.*, c.tf * v.idf AS weight FROM counts c JOIN vocab v ON v.query_id = c.query_id AND v.term = c.term)""",
    "page_top": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_ord ORDER BY round(score, 9) DESC, term) AS rank
                       FROM scores) WHERE rank <= 15 AND score > 0.01""",
    "means": "SELECT query_id, term, avg(score) AS score, count(*) AS pages FROM page_top GROUP BY query_id, term",
    "top": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, term) AS rank
                       FROM means) WHERE rank <= 50""",
    "ref_words": f"""
        SELECT query_id, list(token ORDER BY pos) AS ref_tokens, string_agg(token, ' ' ORDER BY pos) AS ref_norm FROM (
            SELECT w.query_id, w.pos, lower(coalesce(l.lemma, w.word)) AS token
            FROM (SELECT query_id, lang, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (
                    SELECT query_id, lang, regexp_extract_all(lower({normalise('ref_text')}), {lit(WORD)}) AS ws FROM refs)) w
            LEFT JOIN lexicon l ON l.lang = w.lang AND l.form = w.word
            WHERE NOT EXISTS (SELECT 1 FROM stop_words s WHERE s.lang = w.lang AND s.word = w.word)
              AND coalesce(l.pos, 'NOUN') IN {KEPT_POS}) WHERE length(token) >= 3 GROUP BY query_id""",
    "missing": """
        SELECT t.query_id, t.rank, t.term, t.score FROM top t JOIN ref_words r ON r.query_id = t.query_id
        WHERE NOT contains(r.ref_norm, t.term) AND NOT list_has_all(r.ref_tokens, string_split(t.term, ' '))""",
    "cloud": """
        SELECT query_id, word, n, n / max(n) OVER (PARTITION BY query_id) AS weight FROM (
            SELECT query_id, word, count(*) AS n FROM (SELECT query_id, unnest(string_split(term, ' ')) AS word FROM top)
            GROUP BY ALL)""",
    "gaz": f"""
        SELECT lang, surface, regexp_replace(surface, '^' || {lit(NO_WORD)} || '|' || {lit(NO_WORD)} || '$', '', 'g') AS core,
               min(CASE WHEN label = 'PER' THEN 'PERSON' ELSE label END) AS label FROM gazetteer
        WHERE label IN ('PER', 'PERSON', 'ORG', 'GPE', 'LOC') AND length(surface) > 2 GROUP BY ALL""",
    "spans": f"""
        SELECT query_id, doc_ord, lang, pos, n, w[pos + 1] || coalesce(list_aggregate(list_transform(
                   range(pos + 2, pos + n + 1), lambda j: regexp_replace(gap[j], {lit(SPACES)}, ' ', 'g') || w[j]), 'string_agg', ''), '') AS span FROM (
            SELECT *, unnest(range(len(w))) AS pos FROM (
                SELECT query_id, doc_ord, {lang_of()} AS lang, regexp_extract_all(text, {lit(WORD)}) AS w,
                       regexp_split_to_array(text, {lit(WORD)}) AS gap FROM docs))
        CROSS JOIN (SELECT DISTINCT len(regexp_extract_all(core, {lit(WORD)})) AS n FROM gaz WHERE core <> '') WHERE pos + n <= len(w)""",
    "hits": """
        SELECT s.query_id, s.doc_ord, s.pos, s.n, max(g.surface) AS surface, arg_max(g.label, g.surface) AS label
        FROM spans s JOIN gaz g ON g.lang = s.lang AND g.core = s.span GROUP BY ALL""",
    "matches": """
        SELECT query_id, doc_ord, unnest(kept, recursive := true) FROM (
            SELECT query_id, doc_ord, list_reduce(list([{'pos': pos, 'n': n, 'surface': surface, 'label': label}] ORDER BY n DESC, pos),
                lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.pos < x[1].pos + x[1].n AND x[1].pos < k.pos + k.n)) > 0
                                    THEN acc ELSE list_concat(acc, x) END) AS kept
            FROM hits GROUP BY ALL)""",
    "page_entities": """
        SELECT query_id, doc_ord, surface, count(*) AS n, arg_min(label, pos) AS label, min(pos) AS first_pos
        FROM matches GROUP BY query_id, doc_ord, surface""",
    "entity_totals": """
        SELECT query_id, lower(surface) AS folded, CASE WHEN label IN ('GPE', 'LOC') THEN 'GPE/LOC' ELSE label END AS label,
               CAST(sum(n) AS BIGINT) AS n FROM page_entities GROUP BY ALL""",
    "spellings": """
        SELECT query_id, lower(surface) AS folded, surface FROM page_entities
        QUALIFY row_number() OVER (PARTITION BY query_id, lower(surface) ORDER BY doc_ord, n DESC, first_pos) = 1""",
    "named_totals": """
        SELECT t.query_id, t.label, s.surface, CAST(sum(t.n) AS BIGINT) AS n FROM entity_totals t
        JOIN spellings s ON s.query_id = t.query_id AND s.folded = t.folded GROUP BY ALL""",
    "entities": """
        SELECT query_id, label, CAST(rank AS INTEGER) AS rank, surface, n FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY n DESC, surface) AS rank FROM named_totals)
        WHERE rank <= 15""",
    "tone": """
        SELECT d.query_id, d.doc_ord, d.url, length(d.text) > 10 AS counted,
               CASE WHEN length(d.text) > 10 THEN coalesce(s.mean, 0.0) ELSE 0.0 END AS sentiment
        FROM docs d LEFT JOIN (SELECT w.query_id, w.doc_ord, avg(p.polarity) AS mean FROM words w
                               JOIN polarity p ON p.lang = w.lang AND p.word = w.word GROUP BY ALL) s
        ON s.query_id = d.query_id AND s.doc_ord = d.doc_ord""",
    "turned": """
        SELECT query_id, doc_ord, lang, word, coalesce(lag(factor, 1) OVER o, 1.0) * coalesce(lag(factor, 2) OVER o, 1.0) * coalesce(lag(factor, 3) OVER o, 1.0) AS factor
        FROM (SELECT w.*, coalesce(m.factor, 1.0) AS factor FROM words w LEFT JOIN modifiers m ON m.lang = w.lang AND m.word = w.word)
        WINDOW o AS (PARTITION BY query_id, doc_ord ORDER BY pos)""",
    "turned_tone": """
        SELECT d.query_id, d.doc_ord, length(d.text) > 10 AS counted,
               CASE WHEN length(d.text) > 10 THEN coalesce(s.mean, 0.0) ELSE 0.0 END AS sentiment
        FROM docs d LEFT JOIN (SELECT w.query_id, w.doc_ord, avg(greatest(-1.0, least(1.0, p.polarity * w.factor))) AS mean FROM turned w
                               JOIN polarity p ON p.lang = w.lang AND p.word = w.word GROUP BY ALL) s
        ON s.query_id = d.query_id AND s.doc_ord = d.doc_ord""",
    "overall_tone": """
        SELECT query_id, coalesce(avg(sentiment) FILTER (WHERE counted), 0.0) AS sentiment FROM tone GROUP BY query_id""",
    "cache": f"""
        SELECT page_id, 'text_v2' AS cache_type, md5(lower('text_v2_' || url)) AS cache_key,
               CASE WHEN page_id % 7 = 0 THEN '"text"' ELSE '["' || url || '","second"]' END AS payload,
               {t.NOW} - to_hours(page_id) AS cached_at FROM pages
        UNION ALL
        SELECT page_id, 'text_v2', md5(lower('text_v2_' || url)), '["old",null]', {t.NOW} - to_hours(page_id + 500)
        FROM pages WHERE page_id % 2 = 0
        UNION ALL
        SELECT page_id, 'serp_v2', md5(lower('serp_v2_' || {TITLE} || '_' || (page_id % 8 + 1) || '_' || {PAGE_LANG})),
               CASE WHEN page_id % 11 = 0 THEN '[{{"url":"' || url || '"}}]'
                    ELSE '{{"organic_results":[],"related_questions":[]}}' END, {t.NOW} - to_hours(page_id) FROM pages""",
    "stored": """
        SELECT * FROM cache QUALIFY row_number() OVER (PARTITION BY cache_type, cache_key, payload = '["old",null]' ORDER BY cached_at DESC) = 1""",
    "latest": """
        SELECT cache_type, cache_key, arg_max(payload, cached_at) AS payload, max(cached_at) AS cached_at
        FROM cache GROUP BY ALL""",
    "live": f"""
        SELECT * FROM latest WHERE epoch({t.NOW}) - epoch(cached_at) < 604800
          AND CASE cache_type WHEN 'serp_v2' THEN payload LIKE '{{%' ELSE payload LIKE '[%' END""",
}


# The whole run: a keyword for each dozen of pages. These relations stand in for those of the same name above.
RUN = {
    "raw_keywords": f"""
        SELECT k, 'k' || k AS query_id, CASE WHEN k % 10 = 9 THEN ' ' ELSE 'topic ' || k END AS query,
               CASE k % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'es' ELSE 'fr' END AS language,
               CASE WHEN k % 7 = 5 THEN 1 WHEN k % 7 <> 6 THEN 9 ELSE 10 END AS num_results, k % 2 = 0 AS ner, k % 5 <> 0 AS sentiment
        FROM (SELECT DISTINCT page_id // {t.GROUP} AS k FROM pages)""",
    "requests": "SELECT * FROM raw_keywords WHERE k % 10 <> 9",
    "refs": "SELECT 'k' || item_id AS query_id, 'en' AS lang, text AS ref_text FROM benchmark",
    "run_results": f"""
        SELECT r.query_id, r.language, p.rank, CASE WHEN r.k % 8 = 3 THEN 'https://nowhere.example/' || p.page_id ELSE p.url END AS url
        FROM requests r JOIN (SELECT *, page_id // {t.GROUP} AS k, row_number() OVER (PARTITION BY page_id // {t.GROUP} ORDER BY page_id) AS rank
                              FROM pages WHERE {TITLE} <> '') p ON p.k = r.k
        WHERE p.rank <= r.num_results AND r.k % 11 <> 10 AND r.k % 9 <> 4""",
    "run_attached": """
        SELECT r.*, c.text, coalesce(c.error_code, CASE WHEN c.url IS NULL THEN 'not_crawled' END) AS error_code, c.error_detail
        FROM run_results r LEFT JOIN classified c ON c.url = r.url""",
    "docs": "SELECT query_id, rank AS doc_ord, url, language AS lang, text FROM run_attached WHERE error_code IS NULL",
    "failed": "SELECT query_id, rank, url, error_code || coalesce(': ' || error_detail, '') AS reason FROM run_attached WHERE error_code IS NOT NULL",
    "questions": "SELECT query_id, 1 AS pos, 'What of ' || k || '?' AS question FROM requests WHERE k % 11 <> 10",
    "run_entities": "SELECT e.* FROM entities e JOIN requests r ON r.query_id = e.query_id WHERE r.ner",
    "run_tone": "SELECT t.* FROM tone t JOIN requests r ON r.query_id = t.query_id JOIN page_sizes p ON p.query_id = t.query_id AND p.doc_ord = t.doc_ord WHERE r.sentiment AND p.n_tokens >= 2",
    "run_overall": "SELECT query_id, coalesce(avg(sentiment) FILTER (WHERE counted), 0.0) AS sentiment FROM run_tone GROUP BY query_id",
    "run_state": """
        SELECT w.query_id, CASE WHEN w.k % 10 = 9 THEN 'rejected: empty_keyword' WHEN w.k % 11 = 10 THEN 'search_failed' WHEN a.n IS NULL THEN 'no_results'
                                WHEN a.ok = 0 THEN 'no_texts' WHEN coalesce(u.n_pages, 0) = 0 THEN 'no_usable_texts' WHEN v.n IS NULL THEN 'no_features' END AS error
        FROM raw_keywords w LEFT JOIN (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE error_code IS NULL) AS ok FROM run_attached GROUP BY 1) a ON a.query_id = w.query_id
        LEFT JOIN usable u ON u.query_id = w.query_id LEFT JOIN (SELECT query_id, count(*) AS n FROM vocab GROUP BY 1) v ON v.query_id = w.query_id""",
}


def with_(body: str, instead: dict[str, str] | None = None) -> str:
    """A statement with the relations it needs in front; `instead` has relations that replace those of their name."""
    relations = RELATIONS | (instead or {})
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in relations:
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql) and name not in order:
                visit(relations[name])
                if name not in order:
                    order.append(name)

    visit(body)
    parts = [f"{name} AS MATERIALIZED ({relations[name].strip()})" for name in order]
    return f"WITH {', '.join(parts)} {body.strip()}" if parts else body.strip()
