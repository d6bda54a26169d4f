import glob
import os

import duckdb
import pytest

from veilstream.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.queries()[name](spark, SF)
    cur = con.execute(queries.oracle_sql()[name])
    names = sorted(df.columns)
    at = [[c[0] for c in cur.description].index(n) for n in names]
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(tuple(r[i] for i in at) for r in cur.fetchall())
