"""Tables that are read several times, and tables in buckets of a key, of which a change rewrites only those it touches."""

from __future__ import annotations

import tempfile

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only where none is set, as in tests, a temporary one is taken."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="settled-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that what reads it several times does not work it out anew."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df as the side of a join for which neither side is collected by the driver.

    Spark takes a text that is put together from columns for twenty bytes, and rows that compress well for few; of either
    it would send all to the driver and on to every executor. With keys, the join keeps its number of tasks, which Spark
    would bring down to one where texts compress well, however long the work on them is.
    """
    if keys:
        df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    return df.hint("merge")


def unlisted(lists: pa.ListArray) -> tuple[pa.RecordBatch, list[int]]:
    """The structs in a column of lists as rows, and the row of the column that each is from.

    A pass over groups works on a whole batch of them in this way: a batch for each group, of a row or two, costs more than
    what is done with them.
    """
    return pa.RecordBatch.from_struct_array(lists.flatten()), pc.list_parent_indices(lists).to_pylist()


def bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_bucketed(table: DataFrame, path: str, keys: list[str], buckets: int = 256) -> None:
    """table as Parquet under path, a folder for each bucket of its keys. Keys and their number must stay the same for a path."""
    if BUCKET in table.columns:
        raise ValueError(f"a column is named {BUCKET}")
    rows = table.withColumn(BUCKET, bucket(keys, buckets))
    rows.repartition(BUCKET).write.partitionBy(BUCKET).mode("overwrite").parquet(path)


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def touched(changes: DataFrame, keys: list[str], buckets: int) -> list[int]:
    """The buckets in which keys of changes lie: at most `buckets` numbers."""
    return sorted(r[0] for r in changes.select(bucket(keys, buckets)).distinct().collect())


def rewrite_buckets(spark: SparkSession, path: str, keys: list[str], buckets: int, which: list[int], change) -> None:
    """The given buckets of a table replaced by change(their rows); all other files stay as they are.

    Rows are written beside the old files and take their place when the whole job has ended, so tasks may be run again. A
    bucket of which change() keeps no row would keep its old files, so change() must keep some row of each bucket, as an
    upsert does. A row that change() moves to a bucket outside of `which` ends the job, as it would replace that bucket.
    """
    if not which:
        return
    old = spark.read.parquet(path)
    shape = [c for c in old.columns if c != BUCKET]
    rows = change(old.where(F.col(BUCKET).isin(which)).select(*shape)).select(*shape)
    place = bucket(keys, buckets)
    rows = rows.withColumn(BUCKET, F.when(place.isin(which), place).otherwise(F.raise_error(F.lit("a row left its buckets")).cast("int")))
    rows.repartition(BUCKET).write.partitionBy(BUCKET).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
