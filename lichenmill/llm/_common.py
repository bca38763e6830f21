"""Shared helpers: scratch tables, word definition, sorted-run iteration, hot-key joins."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lichenmill.ship import ship

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Largest number of rows that a hot-key side may have: a key counts as hot from 1/HOT_KEYS of the rows on.
HOT_KEYS = 10_000

_own: dict[str, str] = {}


def configure(spark: SparkSession) -> None:
    """Arrow batches small enough that long texts fit a worker's memory, and the package on the workers' path."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode, where it is unset, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="lichenmill-")
    return _own[app]


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone already
            pass

    atexit.register(clean)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver's collector run, whereupon Spark removes the shuffle files of rounds that are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def own_names(df: DataFrame, **columns: Column) -> DataFrame:
    """Only these columns, so that extra columns of the input with any name cannot clash."""
    return df.select(*[c.alias(k) for k, c in columns.items()])


def runs(batches, key: str):
    """Yield (key value, pa.Table) for each run of equal keys of a stream sorted by ``key``."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        edges = [0, *cuts.tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            k = keys[a]
            part = pa.Table.from_batches([batch.slice(a, b - a)])
            if held and k != last:
                yield last, pa.concat_tables(held)
                held = []
            held.append(part)
            last = k
    if held:
        yield last, pa.concat_tables(held)


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, n_left: int) -> DataFrame:
    """Left join on ``key`` where ``right`` has one row a key and ``count`` left rows bear it.

    Keys with over 1/HOT_KEYS of the left rows are HOT_KEYS at most, so those right rows are
    broadcast; the others meet in an ordinary shuffled join that has no hot key left.
    """
    limit = n_left / HOT_KEYS
    hot = F.broadcast(right.where(F.col(count) > limit).withColumn("__hot", F.lit(True)))
    cold = right.where(F.col(count) <= limit)
    tagged = left.join(hot, key, "left")
    found = tagged.where(F.col("__hot")).drop("__hot")
    rest = tagged.where(F.col("__hot").isNull()).select(*left.columns).join(cold, key, "left")
    return found.unionByName(rest.select(*found.columns))
