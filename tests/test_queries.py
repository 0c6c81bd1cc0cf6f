"""Every registered query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from scorefold import queries

SF = os.environ.get("SCOREFOLD_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(rows):
    return sorted(repr([round(float(x), 6) if isinstance(x, float) else x for x in r]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.queries()))
def test_query_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    rel = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(r) for r in rel.fetchall()]
    got = [tuple(r) for r in df.select(*names).collect()]
    assert shown(got) == shown(want)
