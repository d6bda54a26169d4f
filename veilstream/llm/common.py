"""What several operators share: reading tables, cutting lineage, numbering rows."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Regular expression for the white space that separates words: ASCII only.
SPACE = r"[\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the one named by spark.checkpoint.dir; a temporary one only where that is unset."""
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="cuts-")
        _own_dir[app] = f"{base.rstrip('/')}/cuts-{app}"
        atexit.register(_remove, spark, _own_dir[app])
    return _own_dir[app]


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone at exit
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """names, each with as many underscores behind it as make it differ from all of columns (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a cut that nothing will read again."""
    for f in df.inputFiles()[:1]:
        _remove(df.sparkSession, f.rsplit("/", 1)[0])


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor takes nothing along."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str, buckets: int, size: Column | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds `name`: the gapless rank from 0 of each row among those of equal `keys`, or with `size` the sum of the sizes before it.

    Rows go by a hash of `order` into `buckets` per key, ranks inside a bucket are counted there, and the
    buckets' totals are summed in a table of keys x buckets rows. So a key that holds most of the rows is
    spread over all of its buckets. `order` must tell rows apart for the ranks to be the same in reruns;
    `ties` are columns that order rows of equal `order`.
    """
    one = F.lit(1).cast("long") if size is None else size.cast("long")
    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")).withColumn("_one", one)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys, "_b").agg(F.sum("_one").alias("_n")).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_kb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    same = F.col("_b") == F.col("_kb")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "_b").orderBy(F.xxhash64(*order), *order, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.sum("_one").over(inside) - F.col("_one")
    return df.withColumn("_in", run).join(starts, same, "left").withColumn(name, F.col("_from") + F.col("_in")).drop("_b", "_one", "_in", "_kb", "_from", *[f"_k_{k}" for k in keys])


def connecting(x: np.ndarray, y: np.ndarray, similar: np.ndarray, grp: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows x, y connect the rows' groups, the most similar pairs first: fewer than there are groups."""
    root: dict[int, int] = {}

    def find(g: int) -> int:
        while root.get(g, g) != g:
            root[g] = g = root.get(root[g], root[g])
        return g

    keep = np.zeros(len(x), bool)
    for i in np.argsort(-similar, kind="stable").tolist():
        a, b = find(int(grp[x[i]])), find(int(grp[y[i]]))
        if a != b:
            root[a] = b
            keep[i] = True
    return keep
