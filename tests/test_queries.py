"""Every query of the core runs over the smallest tables; where it has SQL, both give the same rows."""

import datetime
from pathlib import Path

import duckdb
import pytest

from lawstrata.plans import documents, documents_sql, law, law_sql

DATA = Path("/root/testdata/sf0.001")
QUERIES, SQL = law.QUERIES | documents.QUERIES, law_sql.SQL | documents_sql.SQL


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if isinstance(v, datetime.datetime) else v


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    df = QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in SQL:
        con = duckdb.connect()
        for f in DATA.iterdir():
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        cur = con.execute(SQL[name])
        at = [[d[0] for d in cur.description].index(c) for c in cols]
        assert got == sorted((tuple(plain(r[k]) for k in at) for r in cur.fetchall()), key=repr)
