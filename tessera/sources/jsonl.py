"""Line-wise JSON sources and sinks, and the check whether an input has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file under a declared schema; blank and broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def tail(spark: SparkSession, path: str, schema: str, time: str, n: int) -> DataFrame:
    """The last ``n`` good records by time."""
    return read_lines(spark, path, schema).orderBy(F.col(time).desc()).limit(n)


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines without null fields.  A null that means something needs a column of its own."""
    df.write.mode(mode).option("ignoreNullFields", "true").json(path)


def changed(spark: SparkSession, items: DataFrame, known: DataFrame, key: str, content: str) -> DataFrame:
    """Items whose content hash is not among ``known(key, content_hash)``: what has to be done again."""
    hashed = items.withColumn("content_hash", F.sha2(F.coalesce(F.col(content), F.lit("")), 256))
    return hashed.join(known.select(key, "content_hash"), [key, "content_hash"], "left_anti")
