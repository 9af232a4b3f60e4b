"""Each dealt operator against a brute-force version, on provided documents and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from termgap.llm import classifier, decontaminate, line_dedup, lm_scoring, packing, quality_rules, simhash, substring_dedup, token_counts, token_files
from termgap.llm.common import fresh_path
from termgap.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


def awkward():
    rng = random.Random(3)
    vocab = [f"w{i}x{i * i % 89}" for i in range(400)]
    prose = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (70, 90, 120)]
    shared = " ".join(rng.choice(vocab) for _ in range(30))
    rows = [
        (None, prose[0], "a"), (1, None, "a"), (2, "", None), (3, " \t\n ", "a"), (4, prose[0], "a"), (5, prose[0], "b"),
        (6, prose[1] + "\n" + shared, "a"), (7, shared + "\n" + prose[2], "a"), (8, shared, "a"), (9, shared.upper(), "b"),
        (10, prose[1].replace("w1", "q1", 1), "a"), (11, "one two", "a"), (12, "A b A b A b A b " * 20, "a"), (13, prose[0][:200] + " " + prose[2], "c"),
        (14, "ué  naïve\x0bcafé ² ½ <|endoftext|> x y 𝒳 don't  I'll\n\n  end ", "a"), (15, "### $$$ |\n### $$$ |\nword", "a"), (16, prose[2] * 40, "d"),
        (17, "x" * 5000, "d"), (18, shared + " " + shared, "a"), (18, shared + " " + shared, "a"), (19, " ".join(sorted(shared.split())), "e"),
    ]
    rows += [(100 + i, f"Common footer line of the site here\n{' '.join(rng.choice(vocab) for _ in range(60))}", "hot") for i in range(30)]
    base = [rng.choice(vocab) for _ in range(80)]
    for i in range(70):  # near copies
        w = list(base)
        w[rng.randrange(80)] = rng.choice(vocab)
        rows.append((200 + i, " ".join(w), "hot"))
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    rows = awkward()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return rows, df.withColumn("score", F.lit("x")).withColumn("n_tokens", F.lit(None).cast("int")).withColumn("lang", F.lit("en")).withColumn("n_chars", F.lit(1)).repartition(5)


@pytest.fixture(scope="module")
def given(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return [(r.doc_id, r.text, r.source) for r in df.collect()], df


@pytest.fixture(params=["odd", "given"])
def both(request):
    return request.getfixturevalue(request.param)


@pytest.fixture(scope="module")
def empty(odd):
    return odd[1].limit(0)


def same(got, want):
    got, want = Counter(map(tuple, got)), Counter(map(tuple, want))
    assert got == want, (list((got - want).items())[:4], list((want - got).items())[:4])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_substring_dedup(both, monkeypatch):
    rows, df = both
    got = substring_dedup.substring_dedup(df).select("doc_id", "n_words", "n_removed", F.sha2("text", 256))
    want = brute.substring([r[:2] for r in rows])
    same(got.collect(), want)
    assert sum(w[2] for w in want) > 100


def test_substring_dedup_with_hot_anchors(odd, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_PLACES", 2)
    rows, df = odd
    assert len(substring_dedup.hot_anchors(df)) > 10
    same(substring_dedup.substring_dedup(df).select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect(), brute.substring([r[:2] for r in rows]))


def test_factors_join_pieces_of_one_source():
    p = [dict(start=s, n_words=n, ref_doc_id=d, ref_start=r) for s, n, d, r in ((0, 20, 1, 5), (1, 25, 1, 6), (10, 20, 2, 0), (20, 25, 2, 10))]
    assert substring_dedup.parse(p) == [[0, 26, 1, 5], [10, 45, 2, 0]]


def test_token_counts(spark, both):
    rows, df = both
    cache = fresh_path(spark, "cache")
    want = [(d, len((t or "").encode()), len(i)) for (d, t, _), i in zip(rows, brute.token_ids([r[1] for r in rows], tokenizer_path()))]
    same(token_counts.token_counts(df, cache, tokenizer_path()).collect(), want)
    stored = spark.read.parquet(cache).count()
    assert stored == len({r[1] or "" for r in rows})
    same(token_counts.token_counts(df, cache, tokenizer_path()).collect(), want)
    assert spark.read.parquet(cache).count() == stored  # nothing was encoded again


def test_token_files(spark, both):
    rows, df = both
    path = fresh_path(spark, "files")
    token_files.write_token_files(df.repartition(3), path, tokenizer_path())
    got = token_files.read_token_files(spark, path)
    want = brute.files(sorted((r[:2] for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), tokenizer_path())
    same(got.select("doc_id", "start", "n_tokens", F.crc32("ids")).collect(), want)
    one = token_files.read_token_files(spark, path, [4, 11]).collect()
    assert {r.doc_id for r in one} == {4, 11} & {r[0] for r in rows}
    assert all(zlib.crc32(bytes(r.ids)) in {w[3] for w in want if w[0] == r.doc_id} for r in one)


def test_quality_rules(both):
    rows, df = both
    got = quality_rules.quality_rules(df).drop("n_shared_words").collect()
    same(got, brute.quality(rows))


def test_simhash(both):
    rows, df = both
    got = simhash.near_duplicates(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    same(got.collect(), brute.groups([r[:2] for r in rows]))


def test_simhash_links_of_large_buckets(spark, monkeypatch):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(26), rng.randrange(1, 9))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4)

    def parts(links):
        parent = {x: x for x in signed}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            assert ((a ^ b) & (2**64 - 1)).bit_count() <= 2
            parent[root(a)] = root(b)
        return Counter(frozenset(y for y in signed if root(y) == root(x)) for x in signed)

    every = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    want = parts(every)
    assert len(every) > 50
    assert parts([tuple(r) for r in simhash.links(df).collect()]) == want
    monkeypatch.setattr(simhash, "PAIRED", 3)
    assert parts([tuple(r) for r in simhash.links(df).collect()]) == want


def test_one_of_each(odd):
    rows, df = odd
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    want = {c for _, _, c in brute.groups([r[:2] for r in rows])}
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(-1 if c is None else c for c in want)


def test_line_dedup(both):
    rows, df = both
    got = line_dedup.line_dedup(df).collect()
    unique = [r[:2] for i, r in enumerate(rows) if r not in rows[:i]]
    want = brute.similar_lines(unique)
    same(set(map(tuple, got)), set(want))
    assert len(got) == len(rows)


def test_line_dedup_beyond_the_window(spark):
    rng = random.Random(9)
    vocab = [f"t{i}" for i in range(60)]
    docs = []
    for i in range(150):  # many lines share the rare token, few are alike
        line = ["rare"] + rng.sample(vocab, 12)
        docs.append((i, " ".join(line) + "\n" + " ".join([*line[:-1], "other", "more"][: rng.choice((13, 14))])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    same(line_dedup.line_dedup(df).collect(), brute.similar_lines(docs))


def test_line_stage_keeps_columns(odd):
    rows, df = odd
    left = line_dedup.deduplicated(df)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} >= {None, 1, 2, 3, 11, 17}


def test_packing(odd):
    rows, df = odd
    got = packing.best_fit(df, capacity=128, source_limit=2, shard_docs=40).collect()
    length, bins = {}, {}
    for d, t, s in rows:
        length.setdefault(d, []).append(len(brute.words(t)))
    by_doc = Counter()
    cluster = {d: brute.fold(t or "") for d, t, s in rows}
    source = {d: s for d, _, s in rows}
    for r in got:
        by_doc[r.doc_id] += r.n_words
        if r.bin_id is None:
            assert r.n_words == 0
        else:
            bins.setdefault(r.bin_id, []).append(r)
    assert by_doc == Counter({d: sum(n) for d, n in length.items()})
    for held in bins.values():
        held.sort(key=lambda r: r.bin_offset)
        assert sum(r.n_words for r in held) <= 128
        assert [r.bin_offset for r in held] == [sum(x.n_words for x in held[:i]) for i in range(len(held))]
        assert len({cluster[r.doc_id] for r in held}) == len(held)
        assert max(Counter(source[r.doc_id] for r in held).values()) <= 2


def test_best_fit_takes_the_tightest_compatible_bin():
    def plain(rows, capacity, limit):
        bins, out = [], []
        for doc, n, source, cluster in sorted(rows, key=lambda r: (-r[1], r[0])):
            fits = [b for b in bins if b["left"] >= n and cluster not in b["clusters"] and b["sources"][source] < limit]
            if fits:
                b = min(fits, key=lambda b: b["left"])
            else:
                bins.append(b := {"left": capacity, "clusters": set(), "sources": Counter()})
            out.append((doc, b["left"] - n))
            b["left"] -= n
            b["clusters"].add(cluster)
            b["sources"][source] += 1
        return len(bins), sorted(x for _, x in out)

    rng = random.Random(1)
    rows = [(i, rng.randrange(1, 50), rng.randrange(3), i) for i in range(60)]
    got = packing.pack_shard(rows, 50, 60)
    n_bins, left = plain(rows, 50, 60)
    assert len({r[4] for r in got}) == n_bins
    assert sorted(50 - r[5] - r[3] for r in got) == left


def test_classifier(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.learn(docs, labels)
    assert 3 <= len(model.rules) <= 400
    got = {r.doc_id: r for r in classifier.scores(docs, model).collect()}
    assert len(got) == docs.count()
    truth = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    ones, zeros = [s for s, q in truth if q], [s for s, q in truth if not q]
    auc = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    right = sum((s >= 0.3) == bool(q) for s, q in truth) / len(truth)
    print("held out", len(truth), "auc", auc, "accuracy", right, "rules", len(model.rules))
    assert auc > 0.9 and right > 0.9


def test_classifier_edges(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (None, 0, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    model = classifier.learn(odd[1], labels)
    got = classifier.scores(odd[1], model).collect()
    assert len(got) == len(odd[0]) and all(0 <= r.score <= 1 for r in got)
    assert classifier.accepted(odd[1], model).columns == odd[1].columns
    assert classifier.scores(empty, classifier.learn(empty, labels)).count() == 0


def test_rules_as_columns_equal_rules_in_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, len(classifier.STATISTICS)))
    y = ((x[:, 0] > 0.2) & (x[:, 3] < 0.5)).astype(float)
    model = classifier.fit(x, y)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], list(classifier.STATISTICS)).select(model.score().alias("s"))
    total = np.full(len(x), model.bias)
    for r in model.rules:
        ok = np.logical_and.reduce([(x[:, classifier.STATISTICS.index(s)] <= c) if up else (x[:, classifier.STATISTICS.index(s)] > c) for s, up, c in r.terms])
        total += r.weight * ok
    got = np.array([r.s for r in df.collect()])
    assert np.allclose(np.sort(got), np.sort(1 / (1 + np.exp(-total))))
    assert ((got >= 0.5) == y).mean() > 0.97


def test_decontamination(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    norm = lambda t: " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split())
    exact = {(d, i) for d, t in texts.items() for i, q in items.items() if f" {norm(q)} " in f" {norm(t)} "}
    assert exact and exact <= got
    assert got == brute_leaks(texts, items)


def brute_leaks(texts, items):
    """Every document against every item without index or bounds."""
    import numpy as np

    words = {i: decontaminate.normal_words(t)[0] for i, t in items.items()}
    df = Counter(int(t) for w in words.values() for t in np.unique(w))
    mean = sum(map(len, words.values())) / len(words)
    found = set()
    for i, w in words.items():
        one = decontaminate.Index([(i, items[i])], df, len(items), mean)
        for d, t in texts.items():
            h = decontaminate.normal_words(t)[0]
            if len(h) and decontaminate.search_document(one, h, one.term_ids(h), decontaminate.THRESHOLD, decontaminate.OVERLAP):
                found.add((d, i))
    return found


def test_block_max_search_is_exact():
    import numpy as np

    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(120)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 40)))) for i in range(90)]
    words = [decontaminate.normal_words(t)[0] for _, t in items]
    df = Counter(int(t) for w in words for t in np.unique(w))
    index = decontaminate.Index(items, df, len(items), 20.0)
    for _ in range(60):
        terms = np.unique(index.term_ids(decontaminate.normal_words(" ".join(rng.choice(vocab) for _ in range(50)))[0]))
        terms = terms[terms >= 0]
        scores = np.zeros(len(items))
        for t in terms:
            for p in range(index.starts[t], index.starts[t + 1]):
                scores[index.item[p]] += index.impact[p]
        assert dict(index.search(terms, 0.4)) == pytest.approx({i: s for i, s in enumerate(scores) if s >= 0.4})


def test_decontamination_edges(spark, odd, empty):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "w1x1"), (None, "a"), (4, awkward()[8][1]), (4, awkward()[8][1])], "item_id long, text string")
    got = decontaminate.contaminated(odd[1], bench).collect()
    assert {r.doc_id for r in got if r.item_id == 4} == {6, 7, 8, 9, 18}
    assert decontaminate.contaminated(odd[1], bench.limit(0)).count() == 0
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert None not in {r.doc_id for r in got}
    left = decontaminate.decontaminated(odd[1], bench.filter("item_id = 4"))
    assert left.columns == odd[1].columns and left.filter("doc_id IN (6, 7, 8, 9, 18)").count() == 0 and left.filter("doc_id IS NULL").count() == 1


def test_lm_scoring(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(docs.limit(3).selectExpr("cast(null as long)", "case when doc_id = 0 then null else '' end", "lang", "source", "n_chars"))
    vocab, weights = lm_scoring.train(docs)
    got = {r.doc_id: r for r in lm_scoring.scores(docs, vocab, weights).collect()}
    assert got[None].n_words == 0 and got[None].log_likelihood == 0 and got[None].mean_log_likelihood is None
    plain = lm_scoring.scores(docs, vocab, lm_scoring.initial(lm_scoring.cell_counts(docs))).agg(F.sum("log_likelihood")).first()[0]
    assert sum(r.log_likelihood for r in got.values()) > plain  # better than word frequencies alone
    assert all(r.n_words == len(brute.words(r2.text)) for r2 in docs.filter("doc_id IS NOT NULL").collect() for r in [got[r2.doc_id]])


def test_lm_probabilities():
    import numpy as np

    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, lm_scoring.CELLS)
    vocab, w = lm_scoring.vocabulary(counts), lm_scoring.initial(counts)
    w["classes"] = rng.normal(size=w["classes"].shape).astype(np.float32)
    w["inside"] = rng.normal(size=w["inside"].shape).astype(np.float32)
    around = np.tile(rng.integers(0, lm_scoring.SYMBOLS, (1, 4)), (lm_scoring.SYMBOLS, 1))
    p = np.exp(lm_scoring.log_probabilities(w, around, np.arange(lm_scoring.SYMBOLS)))
    assert abs(p.sum() - 1) < 1e-4
    assert abs(np.exp(vocab.log_share).sum() - len(np.unique(vocab.symbol))) < 1e-6
    row = np.array([0, 0, 0, 1])
    assert lm_scoring.contexts(np.array([1, 2, 3, 4]), row)[1].tolist() == [lm_scoring.EDGE, 1, 3, lm_scoring.EDGE]


@pytest.mark.parametrize("name", ["op1", "op4", "op5", "op6", "op7", "op10"])
def test_empty_tables(spark, empty, name):
    run = {
        "op1": lambda: substring_dedup.substring_dedup(empty), "op4": lambda: token_counts.token_counts(empty, fresh_path(spark, "c"), tokenizer_path()),
        "op5": lambda: quality_rules.quality_rules(empty), "op6": lambda: packing.best_fit(empty), "op7": lambda: simhash.near_duplicates(empty),
        "op10": lambda: line_dedup.line_dedup(empty),
    }
    assert run[name]().count() == 0


def test_empty_token_files_and_models(spark, empty):
    path = fresh_path(spark, "none")
    token_files.write_token_files(empty, path, tokenizer_path())
    assert token_files.read_token_files(spark, path).count() == 0
    assert lm_scoring.scores(empty, *lm_scoring.train(empty)).count() == 0


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]
