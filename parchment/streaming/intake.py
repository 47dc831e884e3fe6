"""Incremental intake: each material file is processed once for each content."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.utils import AnalysisException

from parchment.operators.inventory import diff_manifest

MANIFEST = "path string, sha256 string, batch long"


def _manifest(spark: SparkSession, path: str, before: int) -> DataFrame:
    """The latest digest of every file that micro-batches below ``before`` recorded; empty without a manifest."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], "path string, sha256 string")
    return rows.where(F.col("batch") < before).groupBy("path").agg(F.max_by("sha256", "batch").alias("sha256"))


def intake_stream(spark: SparkSession, root: str, manifest: str, process: Callable[[DataFrame], None], glob: str = "*") -> DataStreamWriter:
    """A stream over files below root that hands new and changed ones (with state) to ``process``, then records them.

    The manifest is partitioned by micro-batch and a retried batch replaces its own partition, so a retry records nothing
    twice; files that an earlier batch recorded with the same digest are skipped.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    source = (
        spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
        .select("path", "length", "content", F.sha2("content", 256).alias("sha256"))
    )

    def batch(rows: DataFrame, number: int) -> None:
        fresh = diff_manifest(rows, _manifest(rows.sparkSession, manifest, number), "path").where("state <> 'REUSED'")
        process(fresh)
        done = fresh.select("path", "sha256")
        done.write.mode("overwrite").parquet(f"{manifest.rstrip('/')}/batch={number}")

    return source.writeStream.foreachBatch(batch)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _rename(spark: SparkSession, source: str, target: str) -> bool:
    """Move a folder by one rename of the file system; False if the target is there already."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = make(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(make(target)):
        return False
    files.mkdirs(make(target).getParent())
    return bool(files.rename(make(source), make(target)))


def intake_table(spark: SparkSession, root: str, target: str, transform: Callable[[DataFrame], DataFrame], glob: str = "*") -> DataStreamWriter:
    """A stream over files below root whose new and changed ones, transformed, become rows of a table: each content exactly once.

    A micro-batch writes its rows and its part of the manifest side by side into a staging folder, and one rename to
    target/batches/batch=N makes both visible. A batch that fails before the rename leaves nothing but its staging folder; one that
    is run again after the rename finds its folder and does nothing. Renames are atomic on file systems such as HDFS; on object
    stores without them use a table format with transactions. Read the rows with read_intake.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    source = (
        spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
        .select("path", "length", "content", F.sha2("content", 256).alias("sha256"))
    )
    home = target.rstrip("/")

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        done = f"{home}/batches/batch={number}"
        if _exists(spark, done):
            return
        fresh = diff_manifest(rows, _recorded(spark, home, number), "path").where("state <> 'REUSED'")
        staged = f"{home}/staging/{number}-{uuid.uuid4().hex}"
        transform(fresh).write.parquet(f"{staged}/rows")
        fresh.select("path", "sha256").write.parquet(f"{staged}/manifest")
        if not _rename(spark, staged, done) and not _exists(spark, done):
            raise OSError(f"{staged} could not be renamed to {done}")

    return source.writeStream.foreachBatch(batch)


def _committed(spark: SparkSession, home: str, part: str, before: int | None = None) -> list[str]:
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = make(home).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(make(f"{home}/batches/batch=*/{part}")) or []
    paths = [str(f.getPath().toString()) for f in found]
    return [p for p in paths if before is None or int(p.rsplit("/batch=", 1)[1].split("/")[0]) < before]


def _recorded(spark: SparkSession, home: str, before: int) -> DataFrame:
    """The latest digest of every file that committed micro-batches below ``before`` recorded."""
    paths = _committed(spark, home, "manifest", before)
    if not paths:
        return spark.createDataFrame([], "path string, sha256 string")
    rows = spark.read.schema("path string, sha256 string").parquet(*paths).withColumn("batch", F.regexp_extract(F.input_file_name(), "/batch=([0-9]+)/", 1).cast("long"))
    return rows.groupBy("path").agg(F.max_by("sha256", "batch").alias("sha256"))


def read_intake(spark: SparkSession, target: str, schema: str | None = None) -> DataFrame:
    """The rows that committed micro-batches of intake_table made; ``schema`` is needed while there are none."""
    paths = _committed(spark, target.rstrip("/"), "rows")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*paths) if paths else spark.createDataFrame([], schema or "path string")
