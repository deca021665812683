"""Session helpers: a local session for tests and benches, table reading, checkpointing."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def share_source() -> None:
    """Put the repository on the path that Python workers of this machine inherit."""
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A session for tests and benches on one machine."""
    share_source()
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexmill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and tables between steps, which all executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a folder of this machine
    serves if all tasks run on it too (a local master); on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lexmill-"))
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors can write and read."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the cluster's shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Deletes what a query shuffled when it ends; else it stays until the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """What is shuffled by DataFrames that are made, collected and cut in here is deleted at once. Not for ``toArrow``, which still runs when Spark deletes."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)


def spread(spark: SparkSession) -> int:
    """The number of partitions for a shuffle whose number must be stated."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
