"""Session defaults and the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def use_shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    and the session runs on one machine is a temporary folder used.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
    sc.setCheckpointDir(folder)
    return folder


class Scratch:
    """Tables written to the shared folder while an operator works, and removed when it has written its result."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._folder = f"{use_shared_folder(spark)}/tessera-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as written under ``name``: lineage ends there, and every use reads the same rows."""
        path = f"{self._folder}/{name}"
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        jvm = self._spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._folder)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application.

    Spark serves the archive from the driver, so workers need no copy of the
    repository on their path.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)
