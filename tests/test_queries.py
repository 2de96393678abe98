"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from cloudloom.plans import all_queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sample):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sample}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_its_sql(spark, sample, sql, name):
    df = plans.QUERIES[name](spark, sample)
    columns = sorted(df.columns)
    result = sql.execute(plans.ORACLE_SQL[name])
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == columns
    plain = lambda v: tuple(v) if isinstance(v, list) else v
    want = sorted(repr([plain(r[theirs.index(c)]) for c in columns]) for r in result.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want
