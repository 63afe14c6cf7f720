"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only in local mode, which is
    gone when the process ends. On a cluster an unset folder is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidewire.local.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = tempfile.mkdtemp(prefix="tidewire-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("tidewire.local.dir", root)
    return root


def work_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/tidewire-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{work_dir(spark)}/{uuid.uuid4().hex}/{name}"


def importable(spark: SparkSession) -> None:
    """Let local Python workers find this package wherever the driver was started."""
    root = str(Path(__file__).resolve().parents[1])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [paths, root]))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and reread: a short lineage, and values that depend on the
    partitioning are computed once."""
    importable(df.sparkSession)
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_intermediates(spark: SparkSession) -> None:
    """Delete what this application has stored between steps; results that have
    not been written yet can no longer be read after it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class RacingWriters(RuntimeError):
    """Another writer has taken the version number."""


class Manifest:
    """What is valid below a folder: numbered versions, each one small JSON file.

    A version is written aside and renamed into place, and never replaced, so what
    it names becomes valid at once or not at all, and of two writers of one number
    the second learns it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def fs(self, path: str):
        """The file system of a path, and the path on it."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def listed(self) -> list:
        fs, at = self.fs(self.folder)
        return list(fs.listStatus(at)) if fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(f.getPath().getName().split(".")[0]) for f in self.listed() if f.getPath().getName()[0].isdigit())

    def path(self, version: int) -> str:
        return f"{self.folder}/{version:012d}.json"

    def read(self, version: int):
        fs, at = self.fs(self.path(version))
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def latest(self):
        """The last version's number and content; (-1, None) before the first."""
        versions = self.versions()
        return (versions[-1], self.read(versions[-1])) if versions else (-1, None)

    def commit(self, version: int, content) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        fs, draft = self.fs(f"{self.folder}/.{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
        never = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            files.rename(fs.makeQualified(draft), fs.makeQualified(self.fs(self.path(version))[1]), never)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise RacingWriters(f"version {version} of {self.folder}") from e
            raise
