"""Session helpers: code on executors, and tables that cut lineage in the folder that all of them share."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context. Call it before a Python function enters a plan."""
    sc = spark.sparkContext
    if not getattr(sc, "_parchment_shipped", False):
        root = Path(__file__).resolve().parent
        name = Path(tempfile.mkdtemp(prefix="parchment-code-")) / "parchment"
        sc.addPyFile(shutil.make_archive(str(name), "zip", root.parent, root.name))
        # one thread of linear algebra a task, as on a cluster
        sc.environment.setdefault("OMP_NUM_THREADS", "1")
        sc._parchment_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, a new local one in local mode and an error on a cluster."""
    where = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{KEY} must name a folder that all executors and the driver share")
        where = "file://" + tempfile.mkdtemp(prefix="parchment-")
        spark.conf.set(KEY, where)
    return where.rstrip("/")


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/parchment/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_home(spark)}/{name}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession) -> bool:
    """Delete all intermediate tables of this application. Call it when the results that read them are written; True if there were any."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_home(spark))
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A mapInArrow function that gives the memory it has freed back to the system when its task ends, as workers stay for the stages after it."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            import ctypes
            import gc

            import pyarrow

            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


#: bytes of a row group of an intermediate table; a task holds one in memory while it writes
ROW_GROUP = 32 << 20


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
