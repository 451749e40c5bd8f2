"""Written tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a folder of our own only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="kernelloom-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    """At the end of the process the session may be gone already."""
    try:
        if spark.sparkContext._jsc is not None:
            delete(spark, path)
    except Exception:  # noqa: BLE001
        pass


class Scratch:
    """Tables of one run of one operator, written once and reread, so that lineage ends there.

    Files stay until ``drop`` or the end of the driver's process: a lazily evaluated result may
    still read them.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        atexit.register(_delete_quietly, spark, self.path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.path}/{name}")

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))


def write_file(path: str, data: bytes) -> None:
    """Write a whole file from a task.  Its name must be the attempt's own (``attempt_name``), so that no
    attempt ever writes to another's file; a manifest that Spark commits says which attempt's counts."""
    store, at = _store(path)
    store.create_dir(os.path.dirname(at), recursive=True)
    with store.open_output_stream(at, compression=None) as out:
        out.write(data)


def read_file(path: str) -> bytes:
    store, at = _store(path)
    with store.open_input_file(at) as source:
        return source.read()


def attempt_name(kind: str, suffix: str, n: int = 0) -> str:
    """A file name that no other task and no other attempt of this one uses."""
    task = TaskContext.get()
    return f"{kind}-{task.partitionId():06d}-{n:04d}-{task.taskAttemptId():x}-{uuid.uuid4().hex[:8]}.{suffix}"


#: Bytes of an Arrow batch, about; every operator here needs the same bound, so no call undoes another's.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as by rows: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns of our own that no column of ``df`` has, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
