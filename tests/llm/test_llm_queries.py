"""Every query of the package runs over the smallest tables; where it has SQL, both give the same rows."""

from pathlib import Path

import duckdb
import pytest

from lawstrata.llm.queries import QUERIES, SQL
from lawstrata.llm.sql import _POINTS

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    df = QUERIES[name](spark, str(DATA))
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name in SQL:
        con = duckdb.connect()
        for f in DATA.iterdir():
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        cur = con.execute(SQL[name])
        at = [[d[0] for d in cur.description].index(c) for c in sorted(df.columns)]
        assert got == sorted((tuple(r[k] for k in at) for r in cur.fetchall()), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_every_point_has_its_neighbours(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW vector_point AS SELECT * FROM '{DATA}/vector_point.parquet'")
    pairs = con.execute(f"WITH {_POINTS}, c AS (SELECT a.point_id AS id, array_cosine_similarity(a.v, b.v) AS c FROM pts a JOIN pts b ON a.point_id <> b.point_id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC) AS r FROM c) SELECT id, r, c FROM r WHERE r <= 5").fetchall()
    got = {(r.point_id, r.neighbour_rank): r.cosine for r in QUERIES["p5_neighbours"](spark, str(DATA)).collect()}
    assert set(got) == {(i, r) for i, r, _ in pairs}
    assert all(abs(got[i, r] - c) < 0.0011 for i, r, c in pairs)
