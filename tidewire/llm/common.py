"""Helpers shared by the operators: shared storage, columns, batches."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch sent to a Python worker, so that a batch of very
#: long texts still fits into a worker's memory.
BATCH_ROWS = 200
WAVES = 4


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is used in local mode, which is gone
    when the process ends; on a cluster it is an error, as a local folder would
    lose data.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = spark.conf.get("tidewire.local.dir", None)
    if not own:
        own = tempfile.mkdtemp(prefix="tidewire-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.conf.set("tidewire.local.dir", own)
    return own


def work_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/tidewire-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{work_dir(spark)}/{uuid.uuid4().hex}/{name}"


def remove_intermediates(spark: SparkSession) -> None:
    """Delete what this application has written between its steps. Results that
    have not been written yet can no longer be read after it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the reading of a file, and
    values that depend on the partitioning are computed once. ``narrow`` tables
    (a few numbers a row) are written by at most ``WAVES`` tasks a core, so that
    many small steps do not make many small files.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df = df.coalesce(WAVES * spark.sparkContext.defaultParallelism) if narrow else df
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Let local Python workers find this package wherever the driver was started."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [paths, root]))


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch (see ``BATCH_ROWS``) and make the package
    importable. Both are settings of the session and stay set."""
    importable(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def unused(name: str, columns: Iterable[str]) -> str:
    """A column name that none of ``columns`` has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str | Column) -> Column:
    """The column as a string, null as the empty string."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def fold(column: str, modulus: int) -> Column:
    """``crc32`` of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def batches(it: Iterable[pa.RecordBatch], schema: pa.Schema, make) -> Iterator[pa.RecordBatch]:
    """Apply ``make(batch) -> dict of columns`` to every batch that has rows."""
    for batch in it:
        if batch.num_rows:
            columns = make(batch)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
