"""Reading the tables that queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of ``folder``, a Parquet file or a folder of files."""
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` on at least as many partitions as there are cores.

    A table read from one small file would leave all cores but one idle in the work on
    its texts.  Tables of many files are left as they are, so large ones are not shuffled.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df._jdf.queryExecution().toRdd().getNumPartitions() < want else df
