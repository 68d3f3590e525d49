"""Shared pieces: the cluster's shared folder, written tables, prefix sums and file access from tasks."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor can read and write.

    Where the setting is absent a temporary folder is used, on a local master only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-threadlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/threadlake-{uuid.uuid4().hex}"


#: With it Spark deletes a query's shuffle files when it ends, not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors. The write's shuffle files go with its end."""
    conf, path = df.sparkSession.conf, shared_dir(df.sparkSession)
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(SHUFFLE_CLEANUP) if before is None else conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, uri: str) -> None:
    """Delete a folder that shared_dir named and that nothing reads any more; other folders stay."""
    if uri.rsplit("/", 1)[-1].startswith("threadlake-"):
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    for uri in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete_folder(df.sparkSession, uri)


_HELD: dict = {}


def held(key: tuple, build: Callable):
    """A Python worker's one large object: built on first use, dropped when another key is asked for.

    A worker outlives its stage, so the models of a pipeline's earlier stages would else stay in memory.
    """
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
        _HELD[key] = build()
    return _HELD[key]


def small_batches(batches, n_bytes: int):
    """The rows of Arrow batches in slices of about n_bytes each, one row at least."""
    for batch in batches:
        n = max(1, batch.num_rows * n_bytes // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def prefix_sum(df: DataFrame, order: str, value: str, name: str, group: int = 1024) -> DataFrame:
    """Add the sum of `value` over all rows of smaller `order` (whole numbers from 0, each row its own).

    Two levels, so that no task gets more than max(group, rows / group) rows.
    """
    g = df.withColumn("_g", F.col(order) - F.col(order) % group)
    before = Window.partitionBy("_g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = g.groupBy("_g").agg(F.sum(value).alias("_t"))
    ahead = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_g", F.coalesce(F.sum("_t").over(ahead), F.lit(0)).alias("_before"))
    own = g.withColumn("_own", F.coalesce(F.sum(value).over(before), F.lit(0)))
    return own.join(totals, "_g").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_g", "_own", "_before")


def running(df: DataFrame, order: list[str], value: str, index: str, start: str, rows: int = 1 << 20) -> DataFrame:
    """df with each row's place in the order (from 0) and the sum of `value` over all rows before it.

    Rows are dealt to ranges of the order, numbered within them, and moved by the totals of the ranges
    before: no task has more than about `rows` rows, and no more than the number of ranges meet in one.
    Columns of the order should tell all rows apart; rows that agree in all of them may swap.
    """
    n = max(1, -(-df.count() // rows))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i"))
    dealt = materialize(dealt)  # numbered once, whatever is computed again
    totals = dealt.groupBy("_p").agg(F.count("*").alias("_n"), F.sum(value).alias("_v"))
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_p", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in ("_n", "_v")))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("_own", own).join(F.broadcast(totals), "_p")
    at = F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumns({index: (at + F.col("_n")).cast("long"), start: (F.col("_own") + F.col("_v")).cast("long")}).drop("_p", "_i", "_n", "_v", "_own")


def open_fs(uri: str):
    """(filesystem, path) of a URI, in a task or on the driver: file, hdfs, s3 and gs by pyarrow."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + (uri[5:] if uri.startswith("file:") else uri)
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Write under a name of this attempt, then rename: a repeated task leaves one whole file."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    try:
        fs.move(part, path)
    except OSError:  # some stores don't move on to a file: that of an earlier attempt has the same bytes
        fs.delete_file(part)
        if fs.get_file_info(path).size != len(data):
            raise


def read_file(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return f.read() if length is None else f.read(length)
