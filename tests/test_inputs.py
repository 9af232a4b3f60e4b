import json

import pytest
from pyspark.sql import functions as F

from termgap.operators import reuse
from termgap.params import Params
from termgap.schema import CRAWL, PAYLOADS
from termgap.sources import pages, references, requests, search

ORGANIC = [
    {"position": 1, "title": "Baum pflanzen", "link": "https://garten.example/baum", "snippet": "s"},
    {"position": 2, "title": "Hecke schneiden", "link": "https://garten.example/hecke", "snippet": "s"},
    "just text", 7, {"position": 3, "title": "Ohne Verweis"},
    {"position": 4, "title": "Rasen", "link": "https://garten.example/rasen"},
]


def payloads(spark, *rows):
    full = [(r[0], "q", "en", r[1], r[2], r[3] if isinstance(r[3], str) else json.dumps(r[3])) for r in rows]
    return spark.createDataFrame(full, PAYLOADS)


def test_search_payload(spark):
    body = {"organic_results": ORGANIC, "related_questions": [{"question": "Wann wird gepflanzt?"}, "text", {"question": ""}, {"question": "Why?"}]}
    found = search.parse_payloads(payloads(spark, ("a", 200, None, body)))
    two = search.organic_results(found, params=Params(num_results=2)).orderBy("rank").collect()
    assert [(r["rank"], r.title, r.url) for r in two] == [(1, "Baum pflanzen", "https://garten.example/baum"), (2, "Hecke schneiden", "https://garten.example/hecke")]
    three = search.organic_results(found, params=Params(num_results=3)).orderBy("rank").collect()
    assert three[2].url == "https://garten.example/rasen"
    asked = search.related_questions(found).orderBy("pos").collect()
    assert [r.question for r in asked] == ["Wann wird gepflanzt?", "Why?"]


def test_questions_are_chosen_by_presence(spark):
    other = [{"question": "Other?"}]
    rows = payloads(
        spark,
        ("empty", 200, None, {"organic_results": [], "related_questions": [], "people_also_ask": other}),
        ("second", 200, None, {"organic_results": [], "people_also_ask": other}),
        ("not_list", 200, None, {"organic_results": [], "related_questions": "x", "people_also_ask": other}),
    )
    got = {r.query_id for r in search.related_questions(search.parse_payloads(rows)).collect()}
    assert got == {"second", "not_list"}


def test_failed_searches(spark):
    body = {"organic_results": ORGANIC}
    found = search.parse_payloads(
        payloads(spark, ("http", 403, None, body), ("timeout", None, "Timeout", body), ("json", 200, None, "{"), ("ok", 200, None, {"organic_results": [], "related_questions": []}))
    )
    errors = {r.query_id: r.error for r in found.collect()}
    assert errors == {"http": "http: 403", "timeout": "network: Timeout", "json": "invalid_json", "ok": None}
    assert search.organic_results(found).count() == 0


def test_list_shaped_snapshot_is_rejected(spark):
    rows = spark.createDataFrame([('[{"title":"a","url":"b"}]',), ('{"organic_results":[],"related_questions":[]}',)], "p STRING")
    assert [r[0] for r in rows.select(search.has_search_shape(F.col("p"))).collect()] == [False, True]


def test_fetch_outcomes(spark):
    long = "<html><body><p>" + "wort " * 60 + "</p></body></html>"
    rows = [
        ("ok", 200, "OK", "text/html", None, long),
        ("short", 200, "OK", "Text/HTML", None, "<p>Zu kurz!!!</p>"),
        ("pdf", 200, "OK", "application/pdf", None, long),
        ("none", 200, "OK", "text/html", None, "<html><script>x</script></html>"),
        ("empty", 200, "OK", "text/html", None, ""),
        ("404", 404, "Not Found", "text/html", None, long),
        ("503", 503, "Busy", "text/html", None, long),
        ("conn", None, None, None, "ConnectionError", None),
        ("url", None, None, None, "InvalidURL", None),
        ("bare", None, None, None, None, None),
    ]
    got = {r.url: (r.error_code, r.error_detail) for r in pages.classify(spark.createDataFrame(rows, CRAWL)).collect()}
    assert got == {
        "ok": (None, None),
        "short": ("too_short", "10/150"),
        "pdf": ("not_html", "application/pdf"),
        "none": ("no_main_text", None),
        "empty": ("empty_body", None),
        "404": ("http_client", "404 (Not Found)"),
        "503": ("http_server", "503 (Busy)"),
        "conn": ("network_retries", "ConnectionError"),
        "url": ("network", "InvalidURL"),
        "bare": ("network", "N/A"),
    }


def test_every_result_is_valid_or_failed(spark):
    crawl = spark.createDataFrame([("u1", 200, "OK", "text/html", None, "<p>" + "x " * 100 + "</p>"), ("u2", 404, "No", "", None, "")], CRAWL)
    results = spark.createDataFrame([("q", 1, "u1"), ("q", 2, "u2"), ("q", 3, "u3")], "query_id STRING, rank INT, url STRING")
    rows = pages.attach_pages(results, pages.classify(crawl))
    assert [r.url for r in pages.valid_pages(rows).collect()] == ["u1"]
    failed = {r.url: r.reason for r in pages.failed_pages(rows).collect()}
    assert failed == {"u2": "http_client: 404 (No)", "u3": "not_crawled"}


def test_request_rules(spark):
    raw = spark.createDataFrame(
        [("  ", "de", "5", None), ("k", "de", "0", None), ("k", "de", "101", None), ("k", "de", "x", None),
         ("k", "xx", "5", None), ("k", "de", "5", "a.pdf"), ("k", None, None, "A.TXT")],
        "query STRING, language STRING, num_results_raw STRING, reference_name STRING",
    ).coalesce(1)
    got = [r.reject_reason for r in requests.validate_requests(raw).collect()]
    assert got == ["empty_keyword"] + ["bad_num_results"] * 3 + ["unknown_language", "reference_not_txt", None]


def test_reference_files(spark, tmp_path):
    (tmp_path / "own.txt").write_text("Größe\nzwei", encoding="utf-8")
    (tmp_path / "empty.txt").write_text("")
    got = {r.reference_name: r.ref_text for r in references.read_reference_files(spark, str(tmp_path)).collect()}
    assert got["own.txt"] == "Größe\nzwei" and not got.get("empty.txt")


NOW = "TIMESTAMP '2024-01-08 00:00:00'"


def entries(spark, values):
    return spark.sql(f"SELECT 'text_v2' AS cache_type, k AS cache_key, p AS payload, at AS cached_at FROM VALUES {values} AS t(k, p, at)")


def test_freshness_latest_and_shape(spark, tmp_path):
    store = reuse.Store(spark, str(tmp_path / "store"))
    assert store.view().entries().count() == 0
    first = store.save(entries(spark, """('new', '["older",null]', TIMESTAMP '2024-01-07 22:00:00'), ('new', '["older",null]', TIMESTAMP '2024-01-07 22:00:00')"""))
    store.save(entries(spark, """
        ('new', '["a",null]', TIMESTAMP '2024-01-07 23:00:00'), ('edge', '["a",null]', TIMESTAMP '2024-01-01 00:00:00'),
        ('just', '[null,"bad"]', TIMESTAMP '2024-01-01 00:00:01'), ('shape', '["a"]', TIMESTAMP '2024-01-07 23:00:00')"""))
    wanted = spark.createDataFrame([(k,) for k in ("new", "new", "edge", "just", "shape", "unknown")], "cache_key STRING")
    looked = store.view().lookup(wanted, "text_v2", F.expr(NOW))
    assert sorted((r.cache_key, r.payload or "") for r in looked.collect()) == [
        ("edge", ""), ("just", '[null,"bad"]'), ("new", '["a",null]'), ("new", '["a",null]'), ("shape", ""), ("unknown", ""),
    ]
    assert store.view().lookup(wanted, "serp_v2", F.expr(NOW)).where("payload IS NOT NULL").count() == 0
    assert store.view().lookup(wanted, "text_v2", F.expr(NOW), use_cache=False).where("payload IS NOT NULL").count() == 0
    assert [r.payload for r in store.view(first).latest().collect()] == ['["older",null]']
    store.clear()
    assert store.view().latest().count() == 0 and store.view(first).latest().count() == 1


def test_a_half_written_commit_is_not_read(spark, tmp_path):
    store = reuse.Store(spark, str(tmp_path / "store"))
    store.save(entries(spark, """('a', '["a",null]', TIMESTAMP '2024-01-07 22:00:00')"""))
    seen = store.view()
    entries(spark, """('b', '["b",null]', TIMESTAMP '2024-01-07 22:00:00')""").write.partitionBy("cache_type").parquet(f"{store.path}/entries/version=99")
    assert [r.cache_key for r in store.view().latest().collect()] == ["a"]
    store.save(entries(spark, """('a', '["newer",null]', TIMESTAMP '2024-01-07 23:00:00')"""))
    assert [r.payload for r in seen.latest().collect()] == ['["a",null]']  # a view keeps its state
    with pytest.raises(Exception):
        store._commit(store.commits()[0][0], reuse.SAVE)


def test_lookup_reads_keys_before_payloads(spark, tmp_path):
    store = reuse.Store(spark, str(tmp_path / "store"))
    store.save(entries(spark, """('a', '["a",null]', TIMESTAMP '2024-01-07 22:00:00')"""))
    wanted = spark.createDataFrame([("a",)], "cache_key STRING")
    plan = store.view().lookup(wanted, "text_v2", F.expr(NOW))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "GreaterThan(cached_at" in plan
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]  # the keys' scan also prunes the commits of the payloads'
    assert ["payload" in line.split("Batched")[0] for line in scans].count(True) == 1 and scans
    assert all("cache_type#" in line.split("PartitionFilters")[1] for line in scans)


def test_invalidation_drops_the_search_only(spark, tmp_path):
    searches = spark.createDataFrame([("k", 10, "de", "{}", None), ("k", 10, "de", "{}", None), ("other", 10, "de", "{}", None), ("bad", 1, "de", "{}", "http: 500")],
                                     "query STRING, num_results INT, language STRING, payload STRING, error STRING")
    store = reuse.Store(spark, str(tmp_path / "store"))
    store.save(reuse.search_entries(searches, F.expr(NOW)))
    store.save(entries(spark, """('a', '["a",null]', TIMESTAMP '2024-01-07 22:00:00')"""))
    assert store.view().latest().count() == 3
    store.invalidate(searches.where("query = 'k'"))
    assert store.view().latest().groupBy("cache_type").count().count() == 2 and store.view().latest().count() == 2
    store.save(reuse.search_entries(searches, F.expr(NOW)))
    assert store.view().latest().count() == 3
