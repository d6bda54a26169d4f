import os
import random

import pytest
from pyspark.sql import functions as F

from veilstream.operators import stores
from veilstream.sources import tables


def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    table = spark.range(5000).select(F.col("id").alias("k"), F.lit("u").alias("user_id"), F.col("id").alias("v"))
    tables.write_bucketed(table, path, ["k"], 32)
    before = files(path)
    changes = spark.createDataFrame([(3, "x", -1), (3, "x", -2), (4999, "y", -3), (7000, "z", -4)], "k long, user_id string, v long")
    which = stores.upsert_bucketed(path, changes, ["k"], 32, order="v")
    after = files(path)
    same = {f for f in before if after.get(f) == before[f]}
    assert 1 <= len(which) <= 3
    assert all((int(f.split("_bucket=")[1].split("/")[0]) in which) != (f in same) for f in before)
    size = sum(os.path.getsize(f) for f in after if f not in before)
    assert size * 5 < sum(os.path.getsize(f) for f in after)
    want = {k: ("u", k) for k in range(5000)} | {3: ("u", -1), 4999: ("u", -3), 7000: ("z", -4)}
    assert {r.k: (r.user_id, r.v) for r in tables.read_bucketed(spark, path).collect()} == want
    assert stores.upsert_bucketed(path, changes.limit(0), ["k"], 32) == []


def test_many_rounds_equal_a_plain_table(spark, tmp_path):
    draw, path = random.Random(5), str(tmp_path / "t")
    shape = "k string, user_id string, v long"
    want = {f"k{i}": ("a", i) for i in range(50)}
    tables.write_bucketed(spark.createDataFrame([(k, *v) for k, v in want.items()], shape), path, ["k"], 8)
    for n in range(4):
        keys = draw.sample(range(80), 6)
        stores.upsert_bucketed(path, spark.createDataFrame([(f"k{i}", "b", 100 * n + i) for i in keys], shape), ["k"], 8)
        want |= {f"k{i}": (want.get(f"k{i}", ("b",))[0], 100 * n + i) for i in keys}
    assert {r.k: (r.user_id, r.v) for r in tables.read_bucketed(spark, path).collect()} == want


def test_rows_must_stay_in_their_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_bucketed(spark.range(100).withColumnRenamed("id", "k"), path, ["k"], 8)
    with pytest.raises(Exception, match="left its buckets"):
        tables.rewrite_buckets(spark, path, ["k"], 8, [1], lambda rows: rows.select((F.col("k") + 1000).alias("k")))
    assert tables.read_bucketed(spark, path).count() == 100
    with pytest.raises(ValueError, match="_bucket"):
        tables.write_bucketed(spark.range(3).withColumn("_bucket", F.lit(1)), path, ["id"])
