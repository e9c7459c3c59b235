"""Session helpers: a local session for tests and the shared folder for written tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def local_session(cpus: int = 8, app: str = "terrane") -> SparkSession:
    """Session for tests and the bench. A cluster run brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TERRANE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local master may fall back to a temporary folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="terrane-"))
    return spark.sparkContext.getCheckpointDir()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that no later step reads. Spark has no call for it but the file system's own."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def in_parallel(steps: Mapping[str, Callable[[], T]], threads: int = 6) -> dict[str, T]:
    """Run independent steps from several threads, so that small jobs share the executors."""
    own_thread = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=threads) as pool:
        running = {name: pool.submit(own_thread(step)) for name, step in steps.items()}
        return {name: job.result() for name, job in running.items()}


class Workspace:
    """Written tables of one run, below the shared folder.

    Writing a table and reading it back cuts the lineage, survives the loss of
    executors, and gives Catalyst the true size for its join choice.
    """

    def __init__(self, spark: SparkSession, name: str, parent: str | None = None):
        self.spark = spark
        self.root = f"{(parent or shared_folder(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def child(self, name: str) -> Workspace:
        """A folder of its own for one step, so that steps never share table names."""
        return Workspace(self.spark, name, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Remove a table of this run that no later step reads."""
        remove_folder(self.spark, self.path(name))

    def clear(self) -> None:
        """Remove all tables of this run."""
        remove_folder(self.spark, self.root)
