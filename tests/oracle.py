"""Run registered queries in Spark and their oracle statements in DuckDB, and compare the rows.

Usage: python tests/oracle.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, name: str, sf_dir: str) -> list[str]:
    """Problems found, empty when both sides agree."""
    from termgap.queries import ORACLE, QUERIES

    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    mine = [tuple(r) for r in df.select(*cols).collect()]
    if name not in ORACLE:
        return [] if mine else ["no rows"]
    res = con.execute(ORACLE[name])
    duck_types = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in res.description}
    order = [[d[0] for d in res.description].index(c) for c in cols] if set(duck_types) == set(cols) else None
    problems = []
    if order is None:
        return [f"columns differ: spark {cols}, oracle {sorted(duck_types)}"]
    theirs = [tuple(row[i] for i in order) for row in res.fetchall()]
    spark_types = dict(df.dtypes)
    for c in cols:
        if spark_types[c] != duck_types[c]:
            problems.append(f"type of {c}: spark {spark_types[c]}, oracle {duck_types[c]}")
    if not mine:
        problems.append("no rows")
    a, b = Counter(mine), Counter(theirs)
    if a != b:
        problems.append(f"rows {len(mine)} / {len(theirs)}; only spark {list((a - b).items())[:3]}; only oracle {list((b - a).items())[:3]}")
    return problems


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    from termgap.queries import QUERIES

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in QUERIES:
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            problems = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {name} {time.time() - start:.1f}s", *problems, flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
