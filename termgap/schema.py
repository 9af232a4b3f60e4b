"""Explicit schemas of the inputs; nothing is inferred."""

REQUESTS = "query_id STRING, query STRING, language STRING, num_results INT, ner BOOLEAN, cluster BOOLEAN, sentiment BOOLEAN"
PAYLOADS = "query_id STRING, query STRING, language STRING, status INT, error_class STRING, payload STRING"
CRAWL = "url STRING, status INT, reason STRING, content_type STRING, error_class STRING, body STRING"
DOCS = "query_id STRING, doc_ord BIGINT, url STRING, lang STRING, text STRING"
REFERENCES = "query_id STRING, lang STRING, ref_text STRING"
CACHE = "cache_type STRING, cache_key STRING, payload STRING, cached_at TIMESTAMP"

# Items stay strings: typed as structs, a single scalar item would null the whole array.
SEARCH_PAYLOAD = (
    "organic_results ARRAY<STRING>, "
    "related_questions ARRAY<STRING>, people_also_ask ARRAY<STRING>"
)
