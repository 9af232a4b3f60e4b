"""The registered queries that have oracle SQL, against DuckDB on the provided tables."""

from __future__ import annotations

from collections import Counter

import pytest

from termgap.llm.queries import ORACLE, QUERIES
from tests.oracle import duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_oracle(spark, name):
    found = duck(SF).execute(ORACLE[name])
    names = [x[0] for x in found.description]
    theirs = [dict(zip(names, row)) for row in found.fetchall()]
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert cols == sorted(names)
    assert Counter(tuple(r) for r in df.select(*cols).collect()) == Counter(tuple(r[c] for c in cols) for r in theirs)
