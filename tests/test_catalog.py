"""Every registered query of the engine against its SQL in DuckDB, on whole tables."""

import datetime as dt
import glob
import math
import os
import random

import duckdb
import pytest

from veilstream.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(([clean(r[i]) for i in order] for r in data), key=repr)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = rows(names, cur.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", ["adjacent_persons", "carried_state", "new_suggestions", "offsets_in_source", "overlap_resolution", "removal_suggestions", "reviewed_spans", "user_spans"])
def test_lines_of_one_number(spark, tmp_path, name):
    """Of lines of one order and number the first of the table counts, however its files are read; Spark reads large files first."""
    draw = random.Random(9)
    line = lambda: (draw.randrange(200), draw.randrange(1000), draw.randrange(1000), draw.randrange(1, 8), 1.0)
    for k, n in enumerate((300, 900, 2700)):
        spark.createDataFrame([line() for _ in range(n)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        os.makedirs(tmp_path / "lineitem.parquet", exist_ok=True)
        os.rename(glob.glob(str(tmp_path / f"part{k}" / "*.parquet"))[0], tmp_path / "lineitem.parquet" / f"part-{k}.parquet")
    con = duckdb.connect(config={"threads": 1})  # the SQL leaves open which line it keeps; read in order it is the first
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    cur = con.execute(catalog.oracle_sql()[name])
    df = catalog.queries()[name](spark, str(tmp_path))
    assert rows(df.columns, df.collect()) == rows([c[0] for c in cur.description], cur.fetchall())


def test_attempts_of_one_second(spark, tmp_path):
    """Seconds are rounded as in SQL, and attempts of one second and one id do not count each other."""
    draw, kinds = random.Random(3), ("view", "click", "error", "purchase")
    at = [(k % 900, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=draw.randrange(300) * 8640, microseconds=draw.randrange(10**6)), k % 3, kinds[0 if draw.random() < 0.9 else 3]) for k in range(900)]
    at += at[:300]
    spark.createDataFrame(at, "event_id long, ts timestamp, user_id long, event_type string").selectExpr("*", "1.0D AS value", "'{}' AS props").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM '{tmp_path}/events.parquet/*.parquet'")
    cur = con.execute("SET TimeZone = 'UTC'").execute(catalog.oracle_sql()["login_limits"])
    df = catalog.queries()["login_limits"](spark, str(tmp_path))
    assert rows(df.columns, df.collect()) == rows([c[0] for c in cur.description], cur.fetchall())
