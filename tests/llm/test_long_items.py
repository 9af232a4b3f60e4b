"""Decontamination with items longer than a passage, without id, and with an id that several texts share."""

from __future__ import annotations

import random

from termgap.llm import decontaminate


def test_long_items_and_every_text_are_found(spark):
    rng = random.Random(8)
    vocab = [f"b{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(n * 100 + k, text(n)) for n in (64, 65, 96, 100, 130, 160, 200, 300, 1000) for k in range(4)]
    items += [(None, text(20)), (None, text(30)), (7, text(25)), (7, text(35)), (7, text(200))]
    docs, want = [], set()
    for i, (item, t) in enumerate(items):
        docs.append((i, f"{text(rng.randrange(200))} {t} {text(rng.randrange(200))}"))
        want.add((i, item))
    docs.append((len(items), text(2000)))
    for n in (200, 300):  # a copy with words changed here and there
        i, w = len(docs), dict(items)[n * 100].split()
        docs.append((i, " ".join("changed" if k % 60 == 31 else x for k, x in enumerate(w))))
        want.add((i, n * 100))
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items + items[:3], "item_id long, text string")
    got = decontaminate.contaminated(documents, bench).collect()
    assert sorted((r.doc_id, r.item_id or -1) for r in got) == sorted((d, i or -1) for d, i in want)
    assert all(r.question_overlap >= 0.8 and r.answer_overlap >= 0.8 for r in got)


def test_segments_cover_the_item_and_fit_a_passage():
    import numpy as np

    for n in (1, 64, 65, 80, 81, 200, 333):
        got = decontaminate.segments(np.arange(n))
        assert set(np.concatenate(got).tolist()) == set(range(n))
        assert all(len(s) <= decontaminate.PASSAGE for s in got)
