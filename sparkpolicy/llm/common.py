"""Helpers shared by the pipeline operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workers import ship_package

#: Rows and bytes of one Arrow batch that goes to a Python worker: they bound a worker's memory.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20
#: What a Python worker keeps between tasks, by the module that it belongs to: how to let go of it.
_KEPT: dict[str, Callable[[], None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; only Spark opens the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and bytes, and see to the workers' imports.

    Plans read these settings when they run, which is after an operator returns, so they stay set for the session; larger bounds
    that a user had are lowered, smaller ones are kept.
    """
    ship_package(spark)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        own = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if own is None or not own.isdigit() or not 0 < int(own) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session. Where that is unset (tests, a single machine) a
    temporary folder of the driver serves, as then the executors are threads of the same process.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: it cuts the lineage and survives lost executors.

    The table stays as long as the folder, as results are read from it later; see :func:`dropped`.
    """
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the table of :func:`written` once nothing reads it any more."""
    drop_path(df.sparkSession, df._shared_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a shared path that is no longer read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def crc_mod(column: str, n: int) -> Column:
    """``crc32(column as text) mod n``: the contract's fold of a document."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def kept_between_tasks(module: str, forget: Callable[[], None]) -> None:
    """Have a worker call ``forget`` when it turns from the functions of ``module`` to those of another one."""
    _KEPT[module] = forget


def turn_to(module: str) -> None:
    """Let go of what this process keeps for other modules: Spark's workers live on from stage to stage."""
    for name, forget in _KEPT.items():
        if name != module:
            forget()
    if _KEPT.keys() - {module}:
        pa.default_memory_pool().release_unused()
        pa.system_memory_pool().release_unused()  # returns the C library's free memory, too


def map_texts(
    df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]
) -> DataFrame:
    """``fn`` over the Arrow batches of ``df``, each bounded by :func:`bound_batches`.

    A worker first lets go of what other modules' functions have left in it.
    """
    bound_batches(df.sparkSession)
    module = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(module)
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)

