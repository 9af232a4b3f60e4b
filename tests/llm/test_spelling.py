"""Spelling variants against brute force, on documents and on words made to be close."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from termgap.llm import spelling
from termgap.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"


def words_of(rows) -> Counter:
    n: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda x: x[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return Counter({w: k for w, k in n.items() if len(w) >= 7 and k >= 2})


def close(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def shortened(w: str):
    return {w[:i] + "\0" + w[i + 1 :] for i in range(len(w))} | {w[:i] + w[i + 1 :] for i in range(len(w))} | {w}


def brute(rows):
    n = words_of(rows)
    by: dict[str, set] = {}
    for w in n:
        for key in shortened(w):
            by.setdefault(key, set()).add(w)
    out, form = [], {}
    near = {w: {o for key in shortened(w) for o in by[key] if o != w and close(w, o)} for w in n}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return Counter(out)


def grouped(df):
    return Counter(tuple(r) for r in spelling.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect())


def variants(seed: int, alphabet: str, words: int):
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.choice((7, 8, 9, 12, 30)))) for _ in range(words)]
    out = []
    for w in base:
        out += [w] * rng.choice((2, 3, 30, 400))
        for _ in range(4):
            i = rng.randrange(len(w))
            x = rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice(alphabet) + w[i + 1 :], w[:i] + rng.choice(alphabet) + w[i:]))
            out += [x] * rng.choice((1, 2, 3, 25))
    rng.shuffle(out)
    return [(i, " ".join(out[i * 50 : i * 50 + 50])) for i in range(-(-len(out) // 50))]


@pytest.mark.parametrize("limit", [512, 6])
def test_close_words(spark, monkeypatch, limit):
    monkeypatch.setattr(spelling, "FILE_WORDS", limit)
    monkeypatch.setattr(spelling, "BUCKET_WORDS", 300)
    rows = variants(1, "abÀé", 60) + variants(2, "abcdefghijklmnoprstuÿz", 60)
    assert grouped(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_awkward_rows(spark):
    long = "Verylongword" * 3000
    rows = [
        (None, "Überraschung überraschung ÜBERRASCHUNG"), (1, None), (2, ""), (3, "×÷ ÷notaletter× ſharp kelvinK İstanbul"), (4, f"{long} {long} {long}x"), (5, f"{long}x"),
        (6, "repeated repeated"), (6, "repeated repeated"), (7, "a b c short word"), (8, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa " * 30), (9, "don't_underscored1underscored"), (10, "underscored " * 25),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).withColumn("key", F.lit(0))
    assert grouped(df) == brute(rows)
    assert not grouped(spark.createDataFrame([], SCHEMA))


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in QUERIES["op13_spelling_variants"](spark, sf).select("word", "form", "root", "n", "n_near", "form_n").collect()) == brute(rows)


def test_one_edit_against_all_pairs():
    rng = random.Random(4)
    words = list({"".join(rng.choice("abc") for _ in range(n)) for n in (6, 7) for _ in range(150)})
    i, j = spelling.one_edit(words, 7)
    assert sorted(zip(i.tolist(), j.tolist())) == sorted((a, b) for a, w in enumerate(words) for b, o in enumerate(words) if len(w) == 7 and close(w, o))
