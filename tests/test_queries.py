"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from weftnet.plans import queries as plans

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    return con


@pytest.mark.parametrize("name", ["seg_sentences", "gazetteer_mentions", "edges_exponential", "load_weights", "rank_documents", "contexts", "graph_export_edges", "rel_edges", "conversation_edges", "gazetteer_longest", "token_ranges", "unfinished_batch", "tagged_terms"])
def test_sql_gives_the_same(spark, sql, name):
    df = plans.queries()[name](spark, str(DATA))
    cursor = sql.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = [tuple(r[columns.index(c)] for c in df.columns) for r in cursor.fetchall()]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_join_and_pattern_agree(spark):
    rows = plans.queries()["gazetteer_longest"](spark, str(DATA)).collect()
    assert rows and all(r.by_join == r.by_pattern == 1 for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
