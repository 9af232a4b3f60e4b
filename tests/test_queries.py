import os

import pytest

from termgap.queries import QUERIES
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
CHEAP = (
    "s1_search_results", "s4_cached_results", "s5_legacy_snapshots", "c1_request_validation", "c5_organic_results",
    "c6_related_questions", "c8_fetch_outcome", "c10_main_text", "c12_valid_failed_split", "f5_words", "f13_safe_names",
    "j1_pages_by_url", "k4_hits_and_misses", "k6_stored_outcomes", "m1_tfidf", "m2_term_gap", "m4_entities", "m5_sentiment", "a10_modified_sentiment", "s6_language_resources",
    "m3_cluster_step", "s2_page_charsets", "w1_term_table", "k5_latest_entry", "m2_full_run", "w8_run_table",
)


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return duck(SF)


@pytest.mark.parametrize("name", CHEAP)
def test_query_against_oracle(spark, con, name):
    assert compare(spark, con, name, SF) == []


def test_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {n for n in QUERIES if n not in entry.oracle_sql()} == {"m3_cluster_fit", "m2_full_run_clusters"}


def test_question_lines_of_every_conversation(spark, tmp_path):
    from termgap.queries import QUERIES

    rows = [(c, k, role, f"{role} {c} {k}") for c in (1, 21, 41) for k, role in ((0, "user"), (1, "assistant"), (2, "user"))]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.query_id: r.questions for r in QUERIES["c15_question_lines"](spark, str(tmp_path)).collect()}
    assert got == {f"conv{c}": f"  - user {c} 0\n  - user {c} 2" for c in (1, 21, 41)}


def test_freshness_of_every_entry(spark, tmp_path):
    from termgap.queries import QUERIES

    html = '<html lang="de"><title>same</title></html>'
    rows = [(i, f"https://e.com/{i % 2}", html) for i in (1, 2, 9, 200)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, r.cache_type, r.fresh) for r in QUERIES["k3_fresh_entries"](spark, str(tmp_path)).collect())
    text = [(1, True), (2, True), (2, False), (9, True), (200, False), (200, False)]
    assert got == sorted([(i, "text_v2", f) for i, f in text] + [(i, "serp_v2", i < 168) for i, *_ in rows])


def test_bigrams_spread_over_more_tasks_as_the_texts_grow(spark, tmp_path, monkeypatch):
    from termgap.queries import QUERIES, scalars

    rows = [(i // 2, "aa bb aa bb " + "".join(chr(97 + (i * k) % 26) for k in range(200)), "en", "src0", 1) for i in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows, tasks = [], []
    for size in (1 << 30, 256):
        monkeypatch.setattr(scalars, "PAIRS_BYTES", size)
        found = QUERIES["f9_bigrams"](spark, str(tmp_path))
        tasks.append(int(found._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(doc_ord")[1].split(", ")[1].split(")")[0]))
        rows.append(sorted(map(tuple, found.collect())))
    assert rows[0] == rows[1] and (0, "aa bb", 4) in rows[0] and tasks[1] > tasks[0]


def test_report_does_each_step_once(spark, tmp_path, monkeypatch):
    from collections import Counter

    from termgap.queries import mining, outputs, terms

    docs = [(i, f"word{i % 3} apple pear apple {'plum' * (i % 4)} cherry", "en", f"src{i % 2}", 30) for i in range(12)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "apple and pear")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, "user", "why")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    page = '<html lang="de"><title>t</title><body><p>short</p></body></html>'
    spark.createDataFrame([(5, "https://e.com/5", page)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    done = Counter()

    def counted(module, name):
        step = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **k: (done.update([name]), step(*a, **k))[1])

    for module, name in ((terms, "tokens"), (mining, "tone"), (mining, "per_page"), (mining, "first_step")):
        counted(module, name)
    sections = {r.section for r in outputs.w3(spark, str(tmp_path)).select("section").distinct().collect()}
    assert done == {"tokens": 1, "tone": 1, "per_page": 1, "first_step": 1}
    assert {"top_terms", "page_terms", "clusters", "context", "sentiment", "questions", "failed"} <= sections
    done.clear()
    assert {r.part for r in outputs.w2(spark, str(tmp_path)).collect()} == {"top_terms_by_url", "sentiment_by_url", "failed_urls"}
    assert done == {"tokens": 1, "tone": 1}
