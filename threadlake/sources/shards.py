"""Month shards as JSON lines in files of a wanted size, with a manifest that is committed last."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.operators.sessions import BLOCK_ROWS, in_blocks
from threadlake.sources.tables import month_rows

SHARD = ["archive_id", "month_key"]
FILE = [*SHARD, "file_no"]
#: Folders of a file, as text.
NAMED = ["archive", "shard", "file"]
#: Bytes of a file, unless another number is asked for.
TARGET_BYTES = 128 << 20


def line_of(row: list[str]) -> Column:
    """A row as its line of JSON; null fields are left out."""
    return F.to_json(F.struct(*row))


def in_files(placed: DataFrame, target_bytes: int = TARGET_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(archive_id, month_key, seq, at, line, size, file_no from 0) of messages that have segment_no and chapter_no.

    A shard's lines in order of seq are cut where their bytes pass a multiple of target_bytes, so a file has at most
    target_bytes and a line. Sizes are summed within blocks of rows and moved by the blocks before, so a shard of any
    share of the rows is many tasks. Null months are shards like others; archives and seq are not null.
    """
    rows = month_rows(placed)
    fields = [c for c in rows.columns if c not in ("archive_id", "month_key", "seq")]
    by = [*SHARD, "_block"]
    line = line_of(fields)
    lines = in_blocks(rows.select(*SHARD, "seq", F.col("timestamp_local").alias("at"), line.alias("line")), "seq", block_rows).withColumn("size", (F.octet_length("line") + 1).cast("long"))
    ahead = Window.partitionBy(*SHARD).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = lines.groupBy(*by).agg(F.sum("size").alias("_bytes"))
    before = sums.select(F.col("archive_id").alias("_a"), F.col("month_key").alias("_m"), F.col("_block").alias("_k"), F.coalesce(F.sum("_bytes").over(ahead), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum("size").over(Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    match = F.col("archive_id").eqNullSafe(F.col("_a")) & F.col("month_key").eqNullSafe(F.col("_m")) & (F.col("_block") == F.col("_k"))
    placed_lines = lines.withColumn("_own", own).join(before, match)
    return placed_lines.select(*SHARD, "seq", "at", "line", "size", F.floor((F.col("_before") + F.col("_own")) / target_bytes).cast("long").alias("file_no"))


def files_of(lines: DataFrame) -> DataFrame:
    """The manifest of lines that have file_no: a row a file, with its shard's and its archive's totals.

    (archive_id, month_key, shard_id, file_no, path, bytes, n, checksum, first_ts, last_ts, shard_count, file_count, total_messages,
    total_bytes). The checksum is the sum of the lines' CRC-32 numbers, whatever their order.
    """
    files = lines.groupBy(*FILE).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.sum(F.crc32("line")).alias("checksum"), F.min_by("at", "seq").alias("first_ts"), F.max_by("at", "seq").alias("last_ts"))
    whole = Window.partitionBy("archive_id")
    firsts = F.col("file_no") == F.min("file_no").over(Window.partitionBy(*SHARD))
    files = files.withColumn("_first", firsts.cast("long"))
    month = F.coalesce("month_key", F.lit("none"))
    path = F.concat(F.lit("archive="), F.col("archive_id").cast("string"), F.lit("/messages_"), month, F.lit("/"), F.format_string("%06d", "file_no"))
    return files.withColumns({
        "shard_id": F.concat(F.lit("messages_"), month), "path": path, "shard_count": F.sum("_first").over(whole), "file_count": F.count("*").over(whole), "total_messages": F.sum("n").over(whole), "total_bytes": F.sum("bytes").over(whole),
    }).drop("_first")


def publish(placed: DataFrame, path: str, target_bytes: int = TARGET_BYTES, block_rows: int = BLOCK_ROWS) -> str:
    """Write the shards and then their manifest below a folder of this run; returns the run's name.

    A file is written by one task, in order of seq; a task that runs twice leaves one file, since Spark's commit takes one
    of them. Readers go by manifests: a run that broke off has none, so nothing of it is read, and earlier runs stay as they are.
    """
    run = uuid.uuid4().hex
    lines = in_files(placed, target_bytes, block_rows)
    dealt = lines.select("archive_id", F.concat(F.lit("messages_"), F.coalesce("month_key", F.lit("none"))).alias("shard"), F.format_string("%06d", "file_no").alias("file"), "seq", F.col("line").alias("value"))
    dealt = dealt.repartition("archive_id", "shard", "file").sortWithinPartitions("archive_id", "shard", "file", "seq").drop("seq")
    data = f"{path}/run={run}/data"
    dealt.withColumnRenamed("archive_id", "archive").write.partitionBy("archive", "shard", "file").text(data)
    spark = placed.sparkSession
    # sizes, rows and checksums of what lies there, not of what was meant
    found = written(spark, data)
    meant = files_of(lines).withColumns({"archive": F.col("archive_id").cast("string"), "shard": F.col("shard_id"), "file": F.format_string("%06d", "file_no")})
    manifest = meant.drop("path", "bytes", "n", "checksum", "total_messages", "total_bytes").join(found, NAMED, "full").drop(*NAMED)
    whole = Window.partitionBy("archive_id")
    manifest.withColumns({"total_messages": F.sum("n").over(whole), "total_bytes": F.sum("bytes").over(whole)}).write.parquet(f"{path}/run={run}/manifest")
    return run


def stored_lines(spark: SparkSession, data: str) -> DataFrame:
    """(value, archive, shard, file, path, bytes) of the lines below a folder; files are read in splits."""
    raw = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(data)
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    # once for the address, and once more for a folder's name
    path = F.regexp_extract(plain(F.col("_metadata.file_path")), "([^/]*/[^/]*/[^/]*/[^/]*)$", 1)
    raw = raw.select("value", path.alias("path"), F.col("_metadata.file_size").alias("bytes"))
    return raw.select("value", *(plain(F.regexp_extract("path", f"{c}=([^/]*)/", 1)).alias(c) for c in NAMED), "path", "bytes")


def written(spark: SparkSession, data: str) -> DataFrame:
    """(archive, shard, file, path, bytes, n, checksum) of the files below a folder."""
    return stored_lines(spark, data).groupBy(*NAMED, "path", "bytes").agg(F.count("*").alias("n"), F.sum(F.crc32("value")).alias("checksum"))


def read_shards(spark: SparkSession, path: str, run: str) -> DataFrame:
    """(path, value) of a run's lines. Raises FileNotFoundError where files lack, are more, or differ from the manifest."""
    want = spark.read.parquet(f"{path}/run={run}/manifest").select("path", "bytes", "n", "checksum")
    data = f"{path}/run={run}/data"
    got = written(spark, data).drop(*NAMED)
    wrong = want.exceptAll(got).unionByName(got.exceptAll(want)).select("path").limit(1).collect()
    if wrong:
        raise FileNotFoundError(f"{wrong[0]['path']} of {path}/run={run} is not as its manifest says")
    return stored_lines(spark, data).select("path", "value")
