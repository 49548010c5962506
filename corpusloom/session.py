"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "corpusloom", **conf: str) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Only a session of one machine (``local[...]``, for tests or a laptop) that names none gets a
    temporary folder, which later calls use too. On a cluster each executor would write to a disk
    of its own, so there a missing folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` was completed (or begun, where Spark is told to leave no mark)."""
    conf = spark._jsc.hadoopConfiguration()
    marked = conf.getBoolean("mapreduce.fileoutputcommitter.marksuccessfuljobs", True)
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS" if marked else path)
    return target.getFileSystem(conf).exists(target)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/corpusloom/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where one input feeds several jobs: parquet keeps column pruning and pushdown for the
    readers, and the files outlive any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if not is_written(df.sparkSession, path):
        raise OSError(f"{path} does not hold what was written to it; is it a folder that all executors share?")
    return df.sparkSession.read.schema(df.schema).parquet(path)


SMALL_INPUT_BYTES_PER_CORE = 32 << 20


def is_small(df: DataFrame) -> bool:
    """Whether the input of a plan is too small to fill the cores with its splits."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size < df.sparkSession.sparkContext.defaultParallelism * SMALL_INPUT_BYTES_PER_CORE


def spread_small(df: DataFrame, *by: str) -> DataFrame:
    """Spread a small scan over the cores, by the given columns or round robin; large inputs are
    returned as they are.

    A small table often is one file that cannot be split, and everything up to the first shuffle
    would run in one task. Large inputs have enough splits, and moving them would cost more.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *by) if is_small(df) else df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever the driver was started.

    Needed once per application for scorers, merge-list tokenizers and stateful packing, if the
    package is not installed on the cluster.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="corpusloom-zip-")
        archive = shutil.make_archive(
            f"{folder}/corpusloom", "zip", os.path.dirname(here), os.path.basename(here)
        )
        sc.addPyFile(archive)
        _SHIPPED.add(sc.applicationId)
