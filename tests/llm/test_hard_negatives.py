"""Hard negatives against brute force, on random, clustered, copied and awkward vectors."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from termgap.llm import hard_negatives as hn
from termgap.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, scale=256, share=80):
    """rows: (vec_id, vector of floats, label) as a task sees them."""
    kept = [
        (i, [math.floor(scale * x) for x in v], label) for i, v, label in rows
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) and abs(scale * x) < 2**27 for x in v)
    ]
    out = []
    for a, q, own in kept:
        if a % every:
            continue
        score = [(-sum(x * y for x, y in zip(q, v)), i, label) for i, v, label in kept]
        good = sorted((s, i) for s, i, label in score if label == own and i != a)[:5]
        for s, i in good:
            hard = sorted((t, j) for t, j, label in score if label != own and share * -s <= 100 * -t <= 100 * -s)[:5]
            out += [(a, i, rank, j, -s, -t) for rank, (t, j) in enumerate(hard, 1)]
    return Counter(out)


def mined(df, every, **more):
    rows = hn.hard_negatives(df, F.col("vec_id") % every == 0, **more)
    return Counter(tuple(r) for r in rows.collect())


def narrow(rows):
    """Floats as the table holds them."""
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


@pytest.fixture(params=["random", "clustered", "copies", "awkward"])
def rows(request):
    rng = random.Random(5)
    point = lambda n: [rng.gauss(0, 0.2) for _ in range(n)]
    if request.param == "random":
        return [(i, point(12), rng.randrange(4)) for i in range(900)]
    if request.param == "clustered":
        centres = [point(8) for _ in range(9)]
        return [(i, [x + rng.gauss(0, 0.01) for x in rng.choice(centres)], rng.randrange(3)) for i in range(1500)]
    if request.param == "copies":
        same = point(6)
        return [(i, same if i % 3 else point(6), rng.randrange(3)) for i in range(800)]
    odd = [(i, point(5), rng.randrange(3)) for i in range(60)]
    return odd + [
        (None, point(5), 1), (100, None, 1), (101, point(5), None), (102, [0.1, None, 0.2], 1), (103, [math.nan, 1.0], 1), (104, [math.inf], 1), (110, [], 2), (111, [], 1),
        (112, [0.0] * 5, 1), (113, [0.3], 0), (114, point(9), 0), (115, [1e5, -1e5, 3.0], 0), (116, [1e5, -1e5, 2.0], 1), (120, [1e5, -9e4, 1.0], 0), (121, [1e30], 0), (7, point(5), 1), (-10, point(5), 0),
    ]


def test_equals_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(hn, "LEAF_ROWS", 16)
    monkeypatch.setattr(hn, "TREE_ROWS", 128)
    monkeypatch.setattr(hn, "CHUNK_ROWS", 7)
    df = spark.createDataFrame(narrow(rows), SCHEMA).withColumn("slot", F.lit("x")).withColumn("v", F.lit(0)).repartition(3)
    assert mined(df, 10) == brute(narrow(rows), 10)


def test_given_vectors(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = Counter(tuple(r) for r in QUERIES["op12_hard_negatives"](spark, sf).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == brute(rows, 100) and got


def test_empty_table(spark):
    assert not mined(spark.createDataFrame([], SCHEMA), 10)


@pytest.mark.parametrize("rows", [[[0, 0]] * 500, [[3, -4]] * 500, [[3, -4]] * 300 + [[3, -5]] * 300, [[0, 0]] * 300 + [[1, 0]], [[1, 1, 1]] * 200 + [[0, 0, 0]]])
def test_copies_make_large_leaves(rows):
    x = np.array(rows, float)
    tree = hn.cover_tree(x, float(np.sqrt((x * x).sum(axis=1).max())))
    assert sorted(tree["order"]) == list(range(len(x))) and tree["last"].max() == len(x)


def test_nodes_cover_their_rows_and_bounds_hold():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 60, (700, 10)))
    top = float(np.sqrt((x * x).sum(axis=1).max()))
    tree = hn.cover_tree(x, top)
    order, parent = tree["order"], tree["parent"]
    assert sorted(order) == list(range(700))
    leaves = [n for n in range(len(parent)) if n not in set(parent.tolist())]
    assert sorted(i for n in leaves for i in range(tree["first"][n], tree["last"][n])) == list(range(700))
    lift = np.concatenate([x, np.sqrt(np.maximum(top**2 - (x * x).sum(axis=1), 0))[:, None]], axis=1) / top
    for n in range(len(parent)):
        inside = order[tree["first"][n] : tree["last"][n]]
        cos = lift[inside] @ lift[tree["centre"][n]]
        assert np.arccos(np.clip(cos, -1, 1)).max() <= tree["radius"][n] + 1e-6
        if parent[n] >= 0:
            assert tree["first"][parent[n]] <= tree["first"][n] and tree["last"][n] <= tree["last"][parent[n]]
