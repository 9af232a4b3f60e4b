"""Registered queries of this subpackage over the provided tables, with oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termgap.llm import classifier, decontaminate, hard_negatives, line_dedup, lm_scoring, packing, quality_rules, simhash, spelling, substring_dedup, token_counts, token_files, warc
from termgap.llm.common import fresh_path

TOKENIZER = "byte_bpe_50k.json"
MAX_TOKENS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_scoring.scores(docs, *lm_scoring.train(docs))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), fresh_path(spark, "token-cache"), tokenizer_path())
    return counts.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.scores(docs, classifier.learn(docs, table(spark, sf_dir, "labels")))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path, "2024-01-01T00:00:00Z", min_bytes=0)
    header, revisit = F.col("headers"), F.col("headers")["warc-type"] == "revisit"
    return warc.read_warc(spark, path).select(
        warc.page_of(header["warc-record-id"]).alias("page_id"),
        F.when(revisit, F.regexp_extract("http", r"\r\nContent-Length: (\d+)$", 1).try_cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.substring_index(header["warc-payload-digest"], ":", -1)).otherwise(warc.base32_sha1(F.col("payload"))).alias("payload_digest"),
        header["warc-type"].alias("record_type"),
        warc.page_of(header["warc-refers-to"]).alias("refers_to"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_lm_scoring, op3_decontamination, op4_token_counts, op5_quality_rules,
        op6_best_fit_packing, op7_simhash, op8_quality_classifier, op9_token_files, op10_line_dedup,
        op11_warc, op12_hard_negatives, op13_spelling_variants,
    )
}

#: Words as in common.WORD, written on its own for DuckDB.
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LINES = "string_split(coalesce(text, ''), chr(10))"

ORACLE: dict[str, str] = {
    "op1_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
        p AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
        k AS (SELECT doc_id, i, word, count(*) OVER f AS n, string_agg(word, ' ') OVER f AS seq FROM p
              WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
        e AS (SELECT doc_id, i, word, n = 20 AND row_number() OVER (PARTITION BY seq, n ORDER BY doc_id, i) > 1 AS again FROM k),
        c AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM e),
        g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(g.n_removed, 0) AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
        FROM d LEFT JOIN g ON g.doc_id = d.doc_id""",
    "op5_quality_rules": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
        l AS (SELECT doc_id, host, line, len({WORDS.format("line")}) AS n FROM (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d)),
        n AS (SELECT *, trim(regexp_replace(lower(line), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS folded FROM l WHERE n > 0),
        common AS (SELECT host, folded FROM n GROUP BY ALL HAVING count(DISTINCT doc_id) > {quality_rules.MAX_DOCS_PER_HOST}),
        lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
                         CAST(coalesce(sum(n.n) FILTER (c.host IS NOT NULL), 0) AS BIGINT) AS n_shared_words
                  FROM n LEFT JOIN common c ON c.host = n.host AND c.folded = n.folded GROUP BY doc_id),
        p AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
        g AS (SELECT doc_id, i, count(*) OVER f = 3 AS whole, string_agg(word, ' ') OVER f AS seq FROM p
              WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
        twice AS (SELECT doc_id, i, whole AND count(*) OVER (PARTITION BY doc_id, seq, whole) > 1 AS again FROM g),
        met AS (SELECT doc_id, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS again FROM twice),
        r AS (SELECT doc_id, count(*) FILTER (again) AS n_repeat_words FROM met GROUP BY doc_id),
        b AS (SELECT d.doc_id, len(w) AS n_words, length(list_aggregate(w, 'string_agg', '')) AS word_chars,
                     len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                     coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_shared_words, 0) AS n_shared_words
              FROM d LEFT JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id)
        SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_shared_words,
               NOT (n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words)
               AND n_words - n_shared_words >= {quality_rules.MIN_WORDS} AND n_words - n_shared_words >= {quality_rules.MIN_KEPT_SHARE} * n_words AS kept
        FROM b""",
    "op10_line_dedup": f"""
        WITH l AS (SELECT doc_id, unnest({LINES}) AS line, unnest(range(len({LINES}))) AS i FROM documents),
        t AS (SELECT doc_id, i, line, list_sort(list_distinct({WORDS.format("lower(line)")})) AS s FROM l),
        o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth, row_number() OVER (ORDER BY doc_id, i) AS id FROM t),
        f AS (SELECT id, s, len(s) AS n FROM o WHERE nth = 1 AND len(s) > 0),
        tok AS (SELECT id, n, unnest(s) AS x FROM f),
        rare AS (SELECT id, n, tok.x, row_number() OVER (PARTITION BY id ORDER BY df, tok.x) AS k
                 FROM tok JOIN (SELECT x, count(*) AS df FROM tok GROUP BY x) c ON c.x = tok.x),
        prefix AS (SELECT id, n, x FROM rare WHERE k <= n - (4 * n + 4) // 5 + 1),
        pairs AS (SELECT DISTINCT a.id, b.id AS other FROM prefix a JOIN prefix b
                  ON b.x = a.x AND b.id < a.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
        alike AS (SELECT DISTINCT id FROM (SELECT p.id, a.n + b.n AS n, len(list_intersect(a.s, b.s)) AS m
                  FROM pairs p JOIN f a ON a.id = p.id JOIN f b ON b.id = p.other) WHERE 5 * m >= 4 * (n - m)),
        v AS (SELECT doc_id, i, line, len(s) > 0 AS real, len(s) > 0 AND (nth > 1 OR id IN (SELECT id FROM alike)) AS gone FROM o)
        SELECT doc_id, count(*) FILTER (real) AS n_lines, count(*) FILTER (gone) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM v GROUP BY doc_id""",
    "op11_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
        b AS (SELECT *, list_transform(range(8), lambda k: ('0x' || substr(d, 1 + 5 * k, 5))::BIGINT) AS g FROM p),
        f AS (SELECT page_id, strlen(html) AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS least,
                     list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((g[1 + i // 4] >> (5 * (3 - i % 4))) & 31 AS BIGINT), 1)), 'string_agg', '') AS payload_digest FROM b)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> least THEN least END AS refers_to FROM f""",
    "op12_hard_negatives": """
        WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
              FROM r a JOIN r b ON b.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
        n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                     CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
              FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
}
