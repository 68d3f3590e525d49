"""Every query with SQL against DuckDB, as multisets of rows."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("events", "conversations", "documents", "pages", "benchmark", "labels")


#: Whose least counts the smallest tables don't reach.
MAY_BE_EMPTY = {"display_motifs", "inside_jokes", "night_owl_month", "most_balanced_month", "differentiate_titles"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert sum(want.values()) > 0 or name in MAY_BE_EMPTY
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
