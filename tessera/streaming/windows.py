"""Windows and stateful limits that run alike on tables and on streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet") -> DataFrame:
    """A file stream of Parquet files; event times come as timestamps, as watermarks need them."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def tumbling(events: DataFrame, width: str, groups: Sequence[str], value: str, late: str | None = None) -> DataFrame:
    """Counts and sums by window of ``ts``: ``day`` (the window's begin), groups, n, total.

    With ``late`` rows beyond the watermark are dropped, which bounds the state of a stream.
    """
    if late is not None:
        events = events.withWatermark("ts", late)
    by = events.groupBy(F.window("ts", width).alias("w"), *groups).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return by.select(F.col("w.start").alias("day"), *groups, "n", "total")


def sessions(events: DataFrame, gap: str, key: str, late: str | None = None) -> DataFrame:
    """Runs of events of a key without a pause of ``gap``: key, begun, n."""
    if late is not None:
        events = events.withWatermark("ts", late)
    by = events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return by.select(key, F.col("w.start").alias("begun"), "n")


def limit_stream(requests: DataFrame, key: str, limit: int, window: int) -> DataFrame:
    """Sliding-window limits on a stream ``(key, at, seq)`` with times in whole seconds: key, seq, accepted.

    The state of a key is the times of its last ``limit`` accepted requests.  Rows of a
    micro-batch are taken in order of time; a row older than what a key has already
    seen is judged as if it came at that time.
    """
    kind = dict(requests.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        out = []
        for at, seq in zip(rows["at"], rows["seq"]):
            now = max([int(at), *taken[-1:]])
            taken = [t for t in taken if t > now - window]
            ok = len(taken) < limit
            if ok:
                taken.append(now)
            out.append((k[0], int(seq), ok))
        state.update((taken[-limit:],))
        yield pd.DataFrame(out, columns=[key, "seq", "accepted"])

    return requests.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, seq long, accepted boolean", "taken array<long>", "append", GroupStateTimeout.NoTimeout)


def upsert_to(path: str, key: str, version: str):
    """A ``foreachBatch`` writer that keeps the newest row of each key in a Parquet folder."""
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = f"{path}/v{number - 1}"
        jvm = spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(old)
        # Only the first batch finds no version before it; any other failure to read must end the query.
        there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
        known = spark.read.parquet(old).unionByName(batch) if there else batch
        columns = [c for c in known.columns if c != key]
        newest = known.groupBy(key).agg(F.max_by(F.struct(*columns), version).alias("r"))
        newest.select(key, "r.*").write.mode("overwrite").parquet(f"{path}/v{number}")

    return write
