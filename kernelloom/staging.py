"""Cutting lineage in a folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bound Arrow batches by bytes as well as by rows: a row may hold a matrix."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


@contextlib.contextmanager
def few_partitions(spark: SparkSession, rows: int, each: int = 1024, least: int = 64) -> Iterator[None]:
    """Meanwhile shuffles have no more partitions than ``rows`` rows fill: one for each ``each`` rows, or two a core
    with ``least`` rows; never more than are configured.  What meets a kept frame is dealt as that is, and so isn't
    coalesced: hundreds of all but empty tasks a step, in jobs that make many steps.

    Plans aren't adapted meanwhile either: that makes a job of each shuffle and plans the rest anew after it, work
    and memory of the driver, while partitions and kept frames are already as they should be."""
    size, adaptive = "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"
    before = {name: spark.conf.get(name) for name in (size, adaptive)}
    wanted = max(-(-rows // each), min(2 * spark.sparkContext.defaultParallelism, -(-rows // least)), 1)
    spark.conf.set(size, str(min(int(before[size]), wanted)))
    spark.conf.set(adaptive, "false")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed and checkpointed.  The folder is that of ``spark.checkpoint.dir``; a folder of our
    own serves only where that is unset, as in tests."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not named and master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="kernelloom-"))
    return df.checkpoint(eager=True)
