"""The pipeline against brute force, stage by stage in plain Python, on a small corpus."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import awkward, brute_leaks
from termgap.llm import classifier
from termgap.llm.common import fresh_path


@pytest.fixture(scope="module")
def corpus(spark):
    path = fresh_path(spark, "corpus")
    rows = [r for i, r in enumerate(awkward()) if r not in awkward()[:i]]
    docs = spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(d, int(d % 3 > 0), 0) for d, _, _ in rows if d is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, rows[8][1])], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {d: (t, s) for d, t, s in rows}, rows[8][1]


def test_stages(spark, corpus):
    path, rows, item = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = classifier.learn(docs, spark.read.parquet(f"{path}/labels.parquet"))
    good = [(r.doc_id, rows[r.doc_id][0]) for r in classifier.scores(docs, model).collect() if r.score >= 0.3]
    assert good
    lined = [(d, t) for d, n, gone, t in brute.similar_lines(good) if n == 0 or gone < n]
    firsts = {c for _, _, c in brute.groups(lined)}
    left = {d: t for d, t in lined if d in firsts}
    leaks = {d for d, _ in brute_leaks({d: t or "" for d, t in left.items()}, {1: item})}
    want = Counter({d: len(brute.words(t)) for d, t in left.items() if d not in leaks})
    got = Counter()
    for r in corpus_pipeline.run(spark, path).collect():
        got[r.doc_id] += r.n_words
    assert got == want and set(got) == set(want)


def test_stages_keep_the_columns(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, corpus[0]).columns == docs.columns
    assert [f for _, f in corpus_pipeline.STAGES][-1](spark, docs.limit(0), corpus[0]).count() == 0
