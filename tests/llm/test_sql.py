"""Every query of the training-data operators that has SQL equals it."""

import duckdb
import pytest

from linkforge.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=str)
    out = duck.execute(queries.ORACLES[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == columns and got
    assert got == sorted([tuple(plain(r[names.index(c)]) for c in columns) for r in out.fetchall()], key=str)


def test_messages_quote_in_the_view(spark):
    rows = queries.quoted_conversations(spark, SF).collect()
    assert sum(r["reply_to"] is not None for r in rows) > 0.2 * len(rows) and max(r["depth"] for r in rows) > 1
