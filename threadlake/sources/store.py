"""A table in folders by part, of which an update rewrites only the parts it touches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.operators.annotate import annotate
from threadlake.operators.chunks import KEYS, chunk_hashes, in_chunks

#: A store has at most this many parts: two hexadecimal digits of a chunk's hash.
PARTS = 256
CHUNK = ["provider", "version", "chunk_hash", "archive_id"]


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one where that is unset, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-threadlake-store-")
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """The rows, computed now and once, as a table in a new shared folder: what is read twice or more is not derived again, and a lost executor costs no more than its own tasks.

    The folder stays, since the result reads it; spark.checkpoint.dir is cleared by its owner.
    """
    path = shared_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """The newest version, and of each part the run that wrote it; (0, {}) where nothing is stored. At most PARTS rows are read."""
    try:
        versions = spark.read.schema("part int, run string, v int").parquet(f"{path}/manifests")
        newest = versions.agg(F.max("v")).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}
    return newest, {r["part"]: r["run"] for r in versions.where(F.col("v") == newest).collect()}


def read_store(spark: SparkSession, path: str, schema: str, only: set[int] | None = None) -> DataFrame:
    """The rows of a store's newest version, with `part`; of some parts where `only` names them. Empty where nothing is stored."""
    _, parts = manifest(spark, path)
    runs: dict[str, list[int]] = {}
    for part, run in parts.items():
        if only is None or part in only:
            runs.setdefault(run, []).append(part)
    out = spark.createDataFrame([], schema + ", part int")
    for run, members in runs.items():
        out = out.unionByName(spark.read.schema(schema + ", part int").parquet(f"{path}/data/run={run}").where(F.col("part").isin(members)))
    return out


def upsert(spark: SparkSession, path: str, rows: DataFrame, schema: str, keys: list[str]) -> int:
    """Put rows with `part` into the store in place of those with the same keys; returns the version.

    Rows are computed once, into a folder of this run; then the parts that they touch are written anew, and the manifest
    last. Without rows nothing is committed and the version stays. Readers of an older version keep their files; one
    writer at a time. Null keys replace nothing.
    """
    version, parts = manifest(spark, path)
    run = uuid.uuid4().hex
    staged = f"{path}/staged/run={run}"
    rows.write.partitionBy("part").parquet(staged)
    new = spark.read.schema(schema + ", part int").parquet(staged)
    touched = {r["part"] for r in new.select("part").distinct().collect()}
    if touched:
        stored = read_store(spark, path, schema, touched)
        merged = stored.join(new.select(*keys, "part").distinct(), [*keys, "part"], "left_anti").unionByName(new)
        merged.repartition("part", F.pmod(F.xxhash64(*keys), F.lit(8))).write.partitionBy("part").parquet(f"{path}/data/run={run}")
        listed = [(p, run if p in touched else r) for p, r in {**parts, **dict.fromkeys(touched, run)}.items()]
        spark.createDataFrame(listed, "part int, run string").coalesce(1).write.parquet(f"{path}/manifests/v={version + 1}")
        version += 1
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return version


def annotate_into(m: DataFrame, path: str, schema: str, provider: str = "rules", version: str = "1", annotator: Callable[[DataFrame], DataFrame] = annotate) -> int:
    """Annotate the chunks of messages that the store lacks, and store their rows; returns the store's version.

    `schema` names what is kept, among it provider, version, chunk_hash, archive_id, seq and chunk_no. Only messages of
    new chunks reach the annotator, and without such chunks nothing is written. Where chunks of one archive have one
    hash, the rows of the last count.
    """
    spark = m.sparkSession
    stored = read_store(spark, path, schema).select(*CHUNK).distinct()
    last = chunk_hashes(m).groupBy("archive_id", "chunk_hash").agg(F.max("chunk_no").alias("chunk_no")).withColumns({"provider": F.lit(provider), "version": F.lit(version)})
    new = last.join(stored, CHUNK, "left_anti")
    if new.isEmpty():
        return manifest(spark, path)[0]
    made = annotator(in_chunks(m).join(new, KEYS))
    names = spark.createDataFrame([], schema).columns
    part = F.conv(F.substring("chunk_hash", 1, 2), 16, 10).cast("int")
    return upsert(spark, path, made.select(*names, part.alias("part")), schema, CHUNK)


def stored_annotations(m: DataFrame, path: str, schema: str, provider: str = "rules", version: str = "1") -> DataFrame:
    """The stored rows of the chunks that messages have now."""
    now = chunk_hashes(m).select(*KEYS, "chunk_hash")
    rows = read_store(m.sparkSession, path, schema).where((F.col("provider") == provider) & (F.col("version") == version))
    return rows.join(now, [*KEYS, "chunk_hash"]).drop("part")
