"""Different texts without id, or under one id, stay documents of their own in every stage."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from termgap.llm import decontaminate, line_dedup, packing, simhash, substring_dedup


def corpus():
    rng = random.Random(21)
    vocab = [f"k{i}" for i in range(2000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    alone = [text(80) for _ in range(8)]
    shared, leak = text(40), text(25)
    rows = [(None, alone[0]), (None, alone[1]), (None, alone[2]), (7, alone[3]), (7, alone[4]), (None, alone[5]), (None, alone[5])]
    rows += [(20, alone[6]), (21, alone[7])]
    # neighbours of two unrelated texts without id; a repeated line and a leak in two of the others
    rows += [(30, alone[0]), (31, alone[1])]
    rows += [(None, f"{text(60)}\n{shared}"), (40, f"{text(60)}\n{shared}"), (None, f"{text(50)} {leak} {text(50)}"), (7, f"{text(50)} {leak} {text(50)}")]
    return rows, shared, leak


@pytest.fixture(scope="module")
def rows(spark):
    rows, shared, leak = corpus()
    return rows, spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string").repartition(3), shared, leak


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.mark.parametrize("stage", [corpus_pipeline.near_duplicates, lambda s, d, p: simhash.one_of_each(d)])
def test_near_dedup(spark, rows, stage):
    want = Counter({(d, t): 1 for d, t in rows[0] if d not in (30, 31)})
    assert kept(stage(spark, rows[1], "")) == want


def test_components_of_rows_without_id(rows):
    got = Counter((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(rows[1]).collect())
    assert {c for d, _, c in got if d in (20, 21, 40)} == {20, 21, 40}
    assert {c for d, _, c in got if d in (30, 31)} == {None}


def test_line_dedup(rows):
    data, df, shared, _ = rows
    got = Counter((r.doc_id, r.text) for r in line_dedup.line_dedup(df).collect())
    want = Counter((d, "" if d in (30, 31) else t.replace("\n" + shared, "") if d == 40 else t) for d, t in data)
    assert got == want
    assert kept(line_dedup.deduplicated(df)) == Counter({k: n for k, n in want.items() if k[1]})


def test_decontamination(spark, rows):
    data, df, _, leak = rows
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    assert kept(decontaminate.decontaminated(df, bench)) == Counter((d, t) for d, t in data if leak not in t)


def test_packing(rows):
    got = Counter()
    for r in packing.best_fit(rows[1]).collect():
        got[r.doc_id] += r.n_words
    want = Counter()
    for d, t in rows[0]:
        want[d] += len(t.split())
    assert got == want


def test_substring_dedup(rows):
    data, df, shared, leak = rows
    got = Counter((r.doc_id, r.n_removed) for r in substring_dedup.substring_dedup(df).collect())
    by_id = lambda d: sorted(n for (x, n), k in got.items() for _ in range(k) if x == d)
    assert by_id(30) == [80] and by_id(31) == [80] and by_id(40) == [40]
    assert by_id(7) == [0, 0, 25] and by_id(None) == [0] * 7
