"""Long lines: bitmaps that shared tokens do not fill, so unlike lines make no pairs and alike ones are still found."""

from __future__ import annotations

import random
import re

import pytest

from tests.llm import brute
from termgap.llm import line_dedup
from termgap.llm.common import identified

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("n", [200, 300, 900])
def test_unlike_long_lines_make_no_pairs(spark, n):
    """Each two share 40 words; bitmaps of 128 bits, filled by more words than bits, told none of them apart."""
    shared = [f"s{k}" for k in range(40)]
    lines = [" ".join(shared + [f"w{i}x{k}" for k in range(n - 40)]) for i in range(12)]
    docs = identified(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], SCHEMA))
    first = line_dedup.first_lines(line_dedup.line_sets(docs, b"\x01" * line_dedup.CELLS))
    assert line_dedup._candidates(line_dedup._filed(first)).count() == 0


def test_alike_lines_of_every_size(spark):
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(6000)]
    lines = []
    for n in (12, 100, 155, 165, 260, 390, 410, 1500):
        line = rng.sample(vocab, n)
        for share in (0.0, 0.06, 0.1, 0.13, 0.3):
            changed = [rng.choice(vocab) if rng.random() < share else w for w in line]
            lines.append(changed + rng.sample(vocab, rng.randrange(1 + n // 20)))
    rng.shuffle(lines)
    docs = [(i, "\n".join(" ".join(x) for x in lines[i::10])) for i in range(10)]
    got = line_dedup.line_dedup(spark.createDataFrame(docs, SCHEMA)).collect()
    assert 0 < sum(r.n_removed for r in got) < sum(r.n_lines for r in got)
    assert sorted(map(tuple, got)) == sorted(brute.similar_lines(docs))


def test_joins_stay_compiled(spark, capsys):
    """Methods over 8,000 bytes are left to the JVM's interpreter; the join of candidates had one of 10,408."""
    first = spark.createDataFrame([], "doc_id long, h long, line_no int, n int, pos int, bits0 long, bits1 long, wide array<bigint>, token int")
    probes = first.select(*line_dedup.LINE)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (line_dedup._meeting(first), line_dedup._candidates(first), line_dedup._all_candidates(probes, first)):
            df.explain("codegen")
            sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
