import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from termgap.functions import text
from termgap.operators import clusters as cl
from termgap.operators import entities, report, sentiment, tfidf
from termgap.operators.tokens import page_tokens
from termgap.params import DEFAULT, Params
from termgap.plans.analysis import analyze, run
from termgap.schema import CRAWL, DOCS, PAYLOADS, REFERENCES, REQUESTS
from termgap.session import Staging
from termgap.sinks.writers import complete_runs, read_manifest, write_outputs, write_run
from termgap.sources.resources import Resources, default_resources, read_resources

STOP = {"de": "das der die ein eine in ist mit und von war im dies wir wie auch".split(), "en": ["the"]}
LEXICON = [
    ("de", "einfacher", "einfach", "ADJ"), ("de", "jagt", "jagen", "VERB"), ("de", "mäuse", "maus", "NOUN"),
    ("de", "sätze", "satz", "NOUN"), ("de", "sehr", "sehr", "ADV"), ("de", "groß", "groß", "ADV"),
]


def docs(spark, texts, query_id="q", lang="de"):
    return spark.createDataFrame([(query_id, i, f"url{i}", lang, t) for i, t in enumerate(texts)], DOCS)


def resources(spark, lexicon=None):
    gazetteer = spark.createDataFrame(
        [("de", "Berlin", "LOC"), ("de", "Angela Merkel", "PER"), ("de", "Deutschen Bahn", "ORG"), ("de", "Paris", "LOC"),
         ("de", "London", "GPE"), ("de", "Bahn", "ORG"), ("de", "BERLIN", "GPE"), ("de", "Montag", "DATE")],
        "lang STRING, surface STRING, label STRING",
    )
    polarity = spark.createDataFrame([("de", "tolle", 1.0), ("de", "schlechte", -0.5), ("de", "super", 0.5)],
                                     "lang STRING, word STRING, polarity DOUBLE")
    return Resources(STOP, LEXICON if lexicon is None else lexicon, gazetteer, polarity)


SENTENCES = [
    ("Ein einfacher Kuchen war im Ofen.", "einfach kuchen ofen"),
    ("Der Fuchs jagt Mäuse und Vögel.", "fuchs jagen maus vögel"),
    ("Unter https://wald.example/7 stehen 40 Sätze!", "unter stehen satz"),
    ("Groß und die Nord-Süd Strecke.", "nord süd strecke"),
    ("", ""),
]


def test_preprocessing_listed_and_joined_lexicon_agree(spark):
    df = docs(spark, [a for a, _ in SENTENCES])
    table = spark.createDataFrame(LEXICON, "lang STRING, form STRING, lemma STRING, pos STRING")
    for lexicon in (LEXICON, table):
        got = {r.doc_ord: " ".join(r.tokens) for r in page_tokens(df, Resources(STOP, lexicon)).collect()}
        assert [got[i] for i in range(len(SENTENCES))] == [b for _, b in SENTENCES]


def brute_scores(token_lists, params):
    pages = [t for t in token_lists if len(t) >= 2]
    grams = [t + [f"{a} {b}" for a, b in zip(t, t[1:])] for t in pages]
    df, ctf = {}, {}
    for g in grams:
        for term in set(g):
            df[term] = df.get(term, 0) + 1
            ctf[term] = ctf.get(term, 0) + g.count(term)
    kept = sorted((t for t in df if df[t] >= params.min_df), key=lambda t: (-ctf[t], t))[: params.max_features]
    out = []
    for g in grams:
        w = {t: g.count(t) * (math.log((1 + len(pages)) / (1 + df[t])) + 1) for t in kept if t in g}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.append({t: x / norm for t, x in w.items()})
    return out


@pytest.mark.parametrize("features", [200, 5])
def test_tfidf_against_brute_force(spark, features):
    rng = np.random.default_rng(7)
    texts = [" ".join(f"wort{chr(97 + int(i))}" for i in rng.integers(0, 9, size=n)) for n in (12, 1, 30, 7, 18)]
    params = Params(max_features=features)
    pages = tfidf.page_terms(page_tokens(docs(spark, texts), Resources(STOP), params), params)
    got = {}
    for r in tfidf.tfidf(pages, tfidf.vocabulary(pages, params)).collect():
        got.setdefault(r.doc_ord, {})[r.term] = r.score
    want = brute_scores([t.split() for t in texts], params)
    assert [set(got[d]) for d in (0, 2, 3, 4)] == [set(w) for w in want]
    for d, w in zip((0, 2, 3, 4), want):
        assert all(abs(got[d][t] - w[t]) < 1e-12 for t in w)


def test_pages_without_kept_terms_still_count(spark):
    pages = tfidf.page_terms(page_tokens(docs(spark, ["aaa bbb", "aaa bbb", "ccc ddd"]), Resources(STOP)))
    row = tfidf.vocabulary(pages).where("term = 'aaa'").first()
    assert abs(row.idf - (math.log(4 / 3) + 1)) < 1e-12


def test_mean_counts_only_pages_with_the_term_on_top(spark):
    top = spark.createDataFrame([("q", 0, "a", 0.4), ("q", 1, "a", 0.6), ("q", 1, "b", 0.9)], "query_id STRING, doc_ord INT, term STRING, score DOUBLE")
    got = {r.term: (r.score, r.pages) for r in tfidf.term_means(top).collect()}
    assert got == {"a": (0.5, 2), "b": (0.9, 1)}


def test_entities(spark):
    df = docs(spark, ["Die Deutschen Bahn fährt nach Berlin. Angela Merkel kam am Montag.", "berlin BERLIN Berlin Berlin", "nichts"])
    got = entities.overall_entities(entities.page_entities(entities.entity_matches(df, resources(spark).gazetteer))).collect()
    assert {(r.label, r.surface, r.n) for r in got} == {
        ("ORG", "Deutschen Bahn", 1), ("PERSON", "Angela Merkel", 1), ("GPE/LOC", "Berlin", 4),
    }


def test_overlapping_entities_keep_the_longer_or_earlier(spark):
    gaz = spark.createDataFrame([("de", s, "ORG") for s in ("Aaa Bbb", "Bbb Ccc", "Bbb Ccc Ddd", "Ccc", "Eee Fff", "Fff Ggg")],
                                "lang STRING, surface STRING, label STRING")
    got = entities.entity_matches(docs(spark, ["Aaa Bbb Ccc Ddd Eee Fff Ggg Ccc"]), gaz).orderBy("pos").collect()
    assert [r.surface for r in got] == ["Bbb Ccc Ddd", "Eee Fff", "Ccc"]


def test_entities_of_any_length_and_with_punctuation(spark):
    gaz = spark.createDataFrame(
        [("de", x, "ORG") for x in ("Markt Neustadt an der Ilm", "Rot-Weiß", "St. Anna", "Nord Süd", "Alfa!", "...",
                                    "Aaa Bbb Ccc", "Ccc Ddd Eee", "Eee Fff")], "lang STRING, surface STRING, label STRING")
    texts = ["In Markt  Neustadt an der Ilm spielt Rot-Weiß, nicht Rot Weiß.", "St. Anna\nliegt nah. Nord. Süd", "", "Aaa Bbb Ccc Ddd Eee Fff", "Alfa", None]
    got = entities.entity_matches(docs(spark, texts), gaz).orderBy("doc_ord", "pos").collect()
    assert [(r.doc_ord, r.pos, r.surface) for r in got] == [
        (0, 1, "Markt Neustadt an der Ilm"), (0, 7, "Rot-Weiß"), (1, 0, "St. Anna"), (3, 0, "Aaa Bbb Ccc"), (3, 4, "Eee Fff"), (4, 0, "Alfa!"),
    ]


def _plain_matches(texts, surfaces):
    """Longest first, then earliest, by comparing every span of every text."""
    import re

    out = []
    core = {re.sub(r"^\W+|\W+$", "", s): s for s in sorted(surfaces)}
    for k, text in enumerate(texts):
        found = [(m.start(), m.end()) for m in re.finditer(r"\w+", text or "")]
        hits = []
        for i, (a, _) in enumerate(found):
            for j in range(i, len(found)):
                span = re.sub(r"\s+", " ", text[a : found[j][1]])
                if span in core:
                    hits.append((-(j - i + 1), i, core[span]))
        kept = []
        for n, i, s in sorted(hits):
            if all(i - n <= b or b - m <= i for m, b, _ in kept):
                kept.append((n, i, s))
        out += [(k, i, -n, s) for n, i, s in kept]
    return sorted(out)


@pytest.mark.parametrize("listed", [200_000, 0])
def test_entities_as_a_plain_search_finds_them(spark, listed):
    import random


    rng = random.Random(8)
    words = ["Aba", "Bab", "Caca", "Dada", "Eee"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = some(30)
    surfaces = {some(rng.choice((1, 2, 2, 3, 4, 5, 7))) for _ in range(40)} | {long, long + " Eee", "(Caca-Dada)", "Bab, Bab"}
    surfaces = {s for s in surfaces if s not in ("Eee",)}
    texts = [some(rng.randrange(60)) for _ in range(30)] + [f"Aba {long} Eee Bab", long.replace(" ", " \n\t"), "Caca-Dada Bab,  Bab", None, "", long[:-1]]
    gaz = spark.createDataFrame([("de", s, "ORG") for s in surfaces], "lang STRING, surface STRING, label STRING")
    got = entities.entity_matches(docs(spark, texts), gaz, replace(DEFAULT, max_listed_surfaces=listed)).collect()
    assert sorted((r.doc_ord, r.pos, r.words, r.surface) for r in got) == _plain_matches(texts, surfaces)


def test_sentiment(spark):
    got = sentiment.page_sentiment(docs(spark, ["Das ist super!", "Das ist okay, wirklich.", "", "super", "   "]), resources(spark).polarity)
    rows = {r.doc_ord: (r.counted, r.sentiment) for r in got.collect()}
    assert rows == {0: (True, 0.5), 1: (True, 0.0), 2: (False, 0.0), 3: (False, 0.0), 4: (False, 0.0)}
    assert sentiment.overall_sentiment(got).first().sentiment == 0.25


def test_modifiers_turn_and_scale_polarity(spark):
    listed = [("de", "nicht", -1.0), ("de", "sehr", 1.5), ("de", "kaum", 0.5), ("de", "extrem", 4.0), ("en", "super", -1.0)]
    texts = [
        "Das ist super heute.", "Das ist nicht super heute.", "Das ist nicht sehr super.", "Das ist extrem tolle Ware.",
        "nicht eins zwei drei super", "nicht eins zwei super", "super nicht gewesen", "nicht nicht super hier", "kaum schlechte Ware", None,
        "super super super", "nichts davon gelistet",
    ]
    pages, polarity = docs(spark, texts), resources(spark).polarity
    got = {r.doc_ord: r.sentiment for r in sentiment.page_sentiment(pages, polarity, modifiers=listed).collect()}
    want = [0.5, -0.5, -0.75, 1.0, 0.5, -0.5, 0.5, 0.5, -0.25, 0.0, 0.5, 0.0]
    assert [got[i] for i in range(len(texts))] == want
    plain = sentiment.page_sentiment(pages, polarity).collect()
    assert sorted(plain) == sorted(sentiment.page_sentiment(pages, polarity, modifiers=[]).collect())
    narrow = replace(DEFAULT, modifier_words=1)
    assert {r.doc_ord: r.sentiment for r in sentiment.page_sentiment(pages, polarity, narrow, listed).collect()}[5] == 0.5
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges(sentiment.page_sentiment(pages, polarity, modifiers=listed)) == exchanges(sentiment.page_sentiment(pages, polarity))


def test_resources_of_a_folder(spark, tmp_path):
    assert read_resources(spark, str(tmp_path)).lexicon == []
    (tmp_path / "stop_words.csv").write_text("lang,word\nde,und\nde,und\nde,\nnl,een\n")
    (tmp_path / "modifiers.csv").write_text("lang,word,factor\nde,nicht,-1\nde,nicht,0.5\nde,sehr,viel\n")
    (tmp_path / "polarity.csv").write_text('lang,word,polarity\nde,"gut, sehr",1\nde,schlecht,-0.5\n')
    spark.createDataFrame([("de", "Häuser", "Haus", "NOUN"), ("de", "x", None, "NOUN")], "lang STRING, form STRING, lemma STRING, pos STRING").write.parquet(str(tmp_path / "lexicon.parquet"))
    got = read_resources(spark, str(tmp_path))
    assert got.stop_words == {"de": ["und"], "nl": ["een"]} and got.modifiers == [("de", "nicht", -1.0)]
    assert got.lexicon == [("de", "Häuser", "Haus", "NOUN")] and got.gazetteer.count() == 0
    assert sorted(tuple(r) for r in got.polarity.collect()) == [("de", "gut, sehr", 1.0), ("de", "schlecht", -0.5)]


def test_analysis_without_tables_of_ones_own(spark):
    listed = default_resources(spark)
    assert len({m[:2] for m in listed.modifiers}) == len(listed.modifiers) and {m[0] for m in listed.modifiers} == set(listed.stop_words)
    pages = docs(spark, SENTENCES)
    assert entities.entity_matches(pages, listed.gazetteer).count() == 0
    assert {r.sentiment for r in sentiment.page_sentiment(pages, listed.polarity, modifiers=listed.modifiers).collect()} == {0.0}


@pytest.mark.parametrize("local_pages", [2000, 0])
def test_clusters_against_brute_force(spark, local_pages):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{chr(97 + g)}{chr(97 + int(i))}x" for i in rng.integers(0, 5, size=14)) for g in (0, 1, 2) for _ in range(5)]
    params = Params()
    with Staging(spark) as staging:
        pages = staging.keep(tfidf.page_terms(page_tokens(docs(spark, texts), Resources(STOP))), "p")
        vocab = staging.keep(tfidf.vocabulary(pages), "v")
        indexed = staging.keep(cl.indexed_vocabulary(vocab), "i")
        vectors = staging.keep(cl.page_vectors(tfidf.page_scores(pages, vocab)), "x")
        assigned, centres = cl.fit(vectors, indexed, staging, replace(params, local_pages=local_pages))
        assert all(r.converged and 0 < r.rounds < 300 for r in centres.collect())
        got = {r.doc_ord: r.cluster for r in assigned.collect()}
        width = indexed.count()
        x = np.zeros((15, width))
        for r in vectors.collect():
            for c in r.cells:
                x[r.doc_ord, c.ix] = c.score
        listed = cl.cluster_terms(centres, indexed).groupBy("cluster").count().collect()
    k = 5
    picked = [0]
    while len(picked) < k:
        d = np.min([np.round(((x - x[p]) ** 2).sum(1), 9) for p in picked], axis=0)
        picked.append(int(np.flatnonzero(d == d.max())[0]))
    centre = x[picked].copy()
    for _ in range(params.cluster_rounds):
        near = np.argmin(np.round([((x - c) ** 2).sum(1) for c in centre], 9), axis=0)
        centre = np.array([x[near == j].mean(0) if (near == j).any() else centre[j] for j in range(k)])
    near = np.argmin(np.round([((x - c) ** 2).sum(1) for c in centre], 9), axis=0)
    assert got == {i: int(c) for i, c in enumerate(near)}
    assert {r["count"] for r in listed} == {10}


def test_term_tables_as_files(spark, tmp_path):
    from termgap.sinks import writers

    df = docs(spark, ["aaa bbb", "aaa bbb bbb", "ccc ddd"]).withColumn("url", F.concat(F.lit('http://x/"a",'), "doc_ord"))
    df = df.unionByName(df.withColumn("query_id", F.lit("other")).withColumn("text", F.lit("zzz zzz")))
    pages = tfidf.page_terms(page_tokens(df, Resources(STOP), carry=("url",)))
    vocab = tfidf.vocabulary(pages)
    table = report.term_tables(tfidf.page_scores(pages, vocab), vocab)
    rows = {(r.query_id, r.doc_ord): (r.names, r.weights) for r in table.collect()}
    assert rows["q", 2] == (["aaa", "aaa bbb", "bbb"], [0.0, 0.0, 0.0]) and rows["other", 0][0] == ["zzz", "zzz zzz"]
    assert len(rows) == 6
    path = str(tmp_path / "tables")
    writers.write_term_tables(table, path, rows_per_file=2)
    files = sorted((tmp_path / "tables").glob("query_id=q/part=*/part-*"))
    assert len(files) == 2 and all(f.read_text("utf-8").startswith("\ufeffpage,aaa,aaa bbb,bbb\n") for f in files)
    got = {(r.query_id, r.page, r.term): r.score for r in writers.read_term_tables(spark, path).collect()}
    want = {(q, f'http://x/"a",{d}', t): w for (q, d), (names, weights) in rows.items() for t, w in zip(names, weights)}
    assert got == want


def test_a_large_lexicon_in_the_row_equals_the_joined_one(spark):
    entries = [("de", f"form{i}", f"lemma{i % 7}x" if i % 3 else f"Form{i}", ("NOUN", "ADV", "VERB", "ADP")[i % 4]) for i in range(100_000)]
    entries += [("de", "zwei", "zwei", "ADV"), ("de", "zwei", "zweig", "NOUN"), ("de", "kurz", "ab", "NOUN"), ("en", "form5", "other", "NOUN")]
    df = docs(spark, ["form0 Form1 form2 form3 form99998 form100000 zwei kurz und der form5 ab", "", None, "der die das"])
    table = spark.createDataFrame(entries, "lang STRING, form STRING, lemma STRING, pos STRING")
    listed = page_tokens(df, Resources(STOP, entries))
    joined = page_tokens(df, Resources(STOP, table))
    rows = lambda d: sorted((r.doc_ord, r.tokens or [], r.n_tokens) for r in d.collect() if r.tokens)
    assert rows(listed) == rows(joined) and rows(listed)
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_terms_are_not_shuffled(spark):
    """Without broadcasts the pages meet their vocabulary by keyword; no exchange holds a term of a page."""
    pages = tfidf.page_terms(page_tokens(docs(spark, ["aaa bbb", "aaa bbb"]), Resources(STOP)))
    vocab = spark.createDataFrame([("q", "aaa", 2, 1.0)], "query_id STRING, term STRING, df BIGINT, idf DOUBLE")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        top = tfidf.page_top_terms(tfidf.page_scores(pages, vocab))
        plan = top._jdf.queryExecution().executedPlan().toString()
        assert top.count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" not in plan and "Window" not in plan
    # one exchange for the pages and two for the vocabulary's row, which share its partitioning
    assert 2 <= plan.count("Exchange hashpartitioning(query_id") <= 3 and "Exchange hashpartitioning(query_id#" in plan and "term#" not in "".join(
        line for line in plan.splitlines() if "Exchange" in line
    )


def test_all_options(spark):
    df = docs(spark, ["Der tolle Zoo von Berlin hat Pinguine, sagte Angela Merkel.", "In Berlin fiel die schlechte Heizung der Deutschen Bahn aus.",
                      "London liegt weiter westlich als Paris."])
    asked = spark.createDataFrame([("q", "k", "de", 10, True, True, True)], REQUESTS)
    own = spark.createDataFrame([("q", "de", "Ein Text ohne das Wort.")], REFERENCES)
    with Staging(spark) as staging:
        out = analyze(asked, df, own, resources(spark), staging)
        assert [r.term for r in out["top_terms"].collect()] == ["berlin"]
        assert [r.term for r in out["missing"].collect()] == ["berlin"]
        assert ("GPE/LOC", "Berlin", 2) in {(r.label, r.surface, r.n) for r in out["entities"].collect()}
        assert {r.cluster for r in out["clusters"].collect()} <= {0, 1, 2}
        assert out["assigned"].count() == 3
        tone = {r.url: r.sentiment for r in out["sentiment"].collect()}
        assert tone == {"url0": 1.0, "url1": -0.5, "url2": 0.0}


def test_run_from_payloads_to_files(spark, tmp_path):
    def page(words):
        return "<html><body><p>" + " ".join(words * 12) + "</p></body></html>"

    crawl = spark.createDataFrame(
        [("https://a/1", 200, "OK", "text/html", None, page(["Berlin", "tolle", "Stadt"])),
         ("https://a/2", 200, "OK", "text/html", None, page(["Berlin", "Bahn", "Stadt"])),
         ("https://a/3", 404, "Not Found", "text/html", None, "x")], CRAWL)
    organic = ",".join(f'{{"title":"t{i}","link":"https://a/{i}"}}' for i in (1, 2, 3))
    body = f'{{"organic_results":[{organic}],"related_questions":[{{"question":"Wo?"}}]}}'
    asked = spark.createDataFrame(
        [("ok", "Stadt", "de", 10, True, True, True), ("off", "Stadt", "de", 2, False, False, False),
         ("down", "Stadt", "de", 5, True, True, True), ("one", "Stadt", "de", 1, True, True, True), ("never", "x", "de", 5, True, True, True)], REQUESTS)
    found = spark.createDataFrame(
        [("ok", "Stadt", "de", 200, None, body), ("off", "Stadt", "de", 200, None, body), ("down", "Stadt", "de", 500, None, body),
         ("one", "Stadt", "de", 200, None, body)], PAYLOADS)
    own = spark.createDataFrame([("ok", "de", "Eine Stadt.")], REFERENCES)
    at = F.expr("TIMESTAMP '2024-01-08 12:00:00'")
    with Staging(spark) as staging:
        out = run(asked, found, crawl, own, resources(spark), staging, at)
        status = {r.query_id: (r.success, r.error) for r in out["runs"].collect()}
        assert status == {"ok": (True, None), "off": (True, None), "down": (False, "search_failed"), "one": (False, "no_features"),
                          "never": (False, "no_results")}
        assert [(r.query_id, r.url) for r in out["failed"].collect()] == [("ok", "https://a/3")]
        assert {r.query_id for r in out["entities"].collect()} == {"ok", "one"}
        missing = {r.term for r in out["missing"].collect()}
        assert "berlin" in missing and "stadt" not in missing
        context = {r.query_id: r for r in out["context"].collect()}
        assert context["never"].top_terms == "Keine gefunden." and context["never"].reference == "Keiner vorhanden."
        assert context["ok"].questions == "  - Wo?" and context["ok"].reference == "'Eine Stadt.'"
        folder = write_run(out, str(tmp_path / "out"), at, "my run")
        assert folder.endswith("/my_run_20240108-120000") and [f.rsplit("/", 1)[1] for f in complete_runs(spark, str(tmp_path / "out"))] == ["my_run_20240108-120000"]
        manifest = read_manifest(spark, folder).first()
        assert manifest.outputs == ["tfidf", "term_table", "summary", "context", "report", "failed", "runs"] and manifest.format == "all"
        runs = {r.query_id: r for r in spark.read.parquet(f"{folder}/runs").collect()}
        assert runs["ok"].output_files == manifest.outputs[:-1] and runs["ok"].duration_seconds > 0 and runs["ok"].reference_used and not runs["off"].reference_used
        table = spark.read.option("header", True).csv(f"{folder}/tfidf")
        assert {c.lstrip("\ufeff") for c in table.columns} == {"query_id", "url", "term", "score"}
        summary = spark.read.json(f"{folder}/summary/keywords").where("query_id = 'ok'").first()
        assert summary.success and summary.related_questions[0].question == "Wo?"
        sections = {r.section for r in spark.read.parquet(f"{folder}/report").collect()}
        assert {"cloud", "top_terms", "missing", "entities", "clusters", "sentiment", "questions", "page_terms", "context", "failed"} <= sections
        only = write_outputs(out, str(tmp_path / "json"), at, "json")
        assert {w.rsplit("/", 1)[1] for w in only} == {"summary", "context", "failed", "runs"}
        (tmp_path / "out" / "half").mkdir()
        assert len(complete_runs(spark, str(tmp_path / "out"))) == 1


def test_a_second_run_works_on_misses_only(spark, tmp_path, monkeypatch):
    from termgap.operators.reuse import Store
    from termgap.plans import analysis

    text = "<p>" + "Berlin tolle Stadt " * 12 + "</p>"
    crawl = spark.createDataFrame([(f"https://a/{i}", 404 if i == 3 else 200, "x", "text/html", None, text) for i in range(1, 6)] + [("https://a/9", 200, "x", "text/html", None, text)], CRAWL)
    body = lambda ids: '{"organic_results":[' + ",".join(f'{{"title":"t","link":"https://a/{i}"}}' for i in ids) + '],"related_questions":[]}'
    raw = lambda *ids: spark.createDataFrame([(q, f"Stadt {q}", "de", n, None, False, False, False) for q, n in ids], "query_id STRING, query STRING, language STRING, num_results_raw STRING, reference_name STRING, ner BOOLEAN, cluster BOOLEAN, sentiment BOOLEAN")
    found = spark.createDataFrame([("a", "x", "de", 200, None, body((1, 2, 3))), ("b", "x", "de", 200, None, body((2, 4))), ("c", "x", "de", 500, None, "")], PAYLOADS)
    own = spark.createDataFrame([], REFERENCES)
    store = Store(spark, str(tmp_path / "store"))
    extracted = []
    real = analysis.classify
    monkeypatch.setattr(analysis, "classify", lambda df, params: extracted.append(sorted(r.url for r in df.select("url").collect())) or real(df, params))

    def go(asked, at, **more):
        with Staging(spark) as staging:
            out = analysis.run(asked, found, crawl, own, resources(spark), staging, F.expr(f"TIMESTAMP '{at}'"), store=store, **more)
            counts = {r.kind: (r.hits, r.misses) for r in out["reuse"].collect()} if "reuse" in out else None
            state = {r.query_id: r.error for r in out["runs"].collect()}
            return counts, state, sorted((r.query_id, r.url, r.reason) for r in out["failed"].collect()), sorted((r.query_id, r.term) for r in out["top_terms"].collect())

    first = go(raw(("a", "10"), ("c", None), ("bad", "0")), "2024-01-01 00:00:00")
    assert first[0] == {"search": (0, 2), "page": (0, 3)} and first[1] == {"a": None, "c": "search_failed", "bad": "rejected: bad_num_results"}
    again = go(raw(("a", "10"), ("b", "10"), ("c", None)), "2024-01-02 00:00:00")
    assert again[0] == {"search": (1, 2), "page": (3, 1)} and again[2] == first[2] == [("a", "https://a/3", "http_client: 404 (x)")]
    assert [x for x in again[3] if x[0] == "a"] == first[3] and first[3]
    assert extracted == [["https://a/1", "https://a/2", "https://a/3"], ["https://a/4"]]
    assert go(raw(("a", "10")), "2024-03-02 00:00:00", use_cache=False)[0] is None and len(extracted[-1]) == 3


def test_frequent_terms_give_the_same_vocabulary(spark, tmp_path):
    """Only terms that can be in the capped vocabulary are counted; ties, null and repeated keys, and tokens of two words included."""
    words = ["aaa", "bbb", "ccc", "ddd", "eee", "fff", "ggg", "hhh"]
    rows = [("k", i % 30, [words[(i * i + j * j * (i % 5)) % 8] for j in range(i % 9)] + [f"rare{i}"]) for i in range(60)]
    rows += [(None, None, ["aaa", "bbb", "aaa"]), (None, 1, ["aaa", "bbb"]), ("few", 1, ["xxx", "yyy"]), ("few", 2, ["xxx", "yyy", "zzz"]), ("one", 1, ["solo"])]
    rows += [("s", i, ["new york", "new", "york", "new", "york", "qqq"][i % 3 :]) for i in range(6)]
    tokens = spark.createDataFrame(rows, "query_id string, doc_ord bigint, tokens array<string>").withColumn("n_tokens", F.size("tokens"))
    for params in (Params(max_features=4), Params(max_features=200), Params(max_features=3, min_df=1), Params(max_features=5, min_df=3)):
        with Staging(spark) as staging:
            every, frequent = tfidf.page_terms(tokens, params), tfidf.frequent_terms(tokens, staging, params)
            want = sorted(map(repr, tfidf.vocabulary(every, params).collect()))
            assert sorted(map(repr, tfidf.vocabulary(frequent, params).collect())) == want and want
            left = lambda pages: pages.select("query_id", F.explode("terms.term").alias("t"))
            assert left(frequent).where("query_id = 'k' AND t LIKE '%rare%'").isEmpty() == (params.min_df > 1 or params.max_features < 4)
            assert frequent.where("n_tokens >= 2 AND terms IS NULL OR n_tokens < 2 AND terms IS NOT NULL").isEmpty()


def test_every_term_counted_from_tokens(spark):
    """The same counts as from page terms, without a function over an array of terms; null and repeated keys included."""
    rows = [("k", i % 7, [["aaa", "bbb", "aaa", "ccc"], ["bbb", "aaa"], ["solo"], [], None, ["ccc"] * 4][i % 6]) for i in range(20)]
    rows += [(None, None, ["aaa", "aaa", "aaa"]), (None, 1, ["aaa", "aaa"]), ("s", 1, ["new york", "new", "york"]), ("s", 2, ["new", "york"])]
    tokens = spark.createDataFrame(rows, "query_id string, doc_ord bigint, tokens array<string>").withColumn("n_tokens", F.size("tokens"))
    for params in (Params(), Params(min_df=1), Params(min_df=3), Params(min_page_tokens=3)):
        every = tfidf.every_frequency(tokens, params)
        want = tfidf.term_frequency(tfidf.page_terms(tokens, params), params).where(F.col("term") != tfidf.PAGE_MARK)
        assert sorted(map(repr, every.collect())) == sorted(map(repr, want.collect())) and every.count()
        assert "filter(" not in every._jdf.queryExecution().optimizedPlan().toString()


def test_frequent_terms_tokenise_once(spark):
    tokens = page_tokens(docs(spark, ["aaa bbb", "aaa bbb ccc"]), Resources(STOP))
    with Staging(spark) as staging:
        frequent = tfidf.frequent_terms(tokens, staging)
        assert "regexp" not in frequent._jdf.queryExecution().optimizedPlan().toString()
        assert frequent.selectExpr("query_id", "inline(terms)").where("term = 'aaa bbb'").count() == 2


def test_listed_lemmas_with_a_set_and_with_a_table_alone(spark, monkeypatch):
    words = spark.createDataFrame([(["ab", "abc", "it's", "going", "the", "xx", "was", "other"],)], "w array<string>")
    found = []
    for most in (0, 5000):
        monkeypatch.setattr(text, "MAX_SET_WORDS", most)
        found.append(words.select(text.keep_lemmas("w", ["the", "it's"], {"going": "go", "xx": "be", "was": None}, 3)).first()[0])
    assert found[0] == found[1] == ["abc", "go", "be", "other"]
