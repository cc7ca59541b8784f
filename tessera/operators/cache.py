"""Semantic result cache as tables: guards, counters, victims, upserts and policy replay."""

from __future__ import annotations

import heapq
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTER_MAX = 255


def decayed(counter: Column, last: Column, now: Column, period: int) -> Column:
    """A use counter less one for every whole period since ``last``; never below 0."""
    if period <= 0:
        return counter
    return F.greatest(counter - F.floor(F.greatest(now - last, F.lit(0)) / period), F.lit(0)).cast("int")


def increment_chance(counter: Column, start: int = 5, factor: int = 10) -> Column:
    """Chance that a hit raises the counter by one; 0 at its maximum."""
    base = F.greatest(counter - start, F.lit(0))
    return F.when(counter >= COUNTER_MAX, F.lit(0.0)).otherwise(1 / (base * factor + 1))


def live(entries: DataFrame, now: int) -> DataFrame:
    return entries.where(F.col("expires_at") > now)


def guard_join(entries: DataFrame, requests: DataFrame, keys: Sequence[str], now: int) -> DataFrame:
    """Live entries whose guard keys all equal a request's; null keys match nothing."""
    return requests.join(live(entries, now), list(keys))


def upsert(entries: DataFrame, changes: DataFrame, key: str, version: Sequence[str]) -> DataFrame:
    """Entries after changes: of each key the row with the greatest version, changes before equals."""
    both = entries.withColumn("_src", F.lit(0)).unionByName(changes.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    newest = Window.partitionBy(key).orderBy(*[F.col(v).desc_nulls_last() for v in version], F.col("_src").desc())
    return both.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "_src")


def victims(entries: DataFrame, now: int, period: int, current: str, per: str, count: int = 1) -> DataFrame:
    """Entries to evict first in each ``per``: other versions, then the least decayed counter, then the soonest expiry."""
    rows = entries.withColumn("decayed", decayed(F.col("lfu_counter"), F.col("last_hit_at"), F.lit(now), period)).withColumn("stale", F.col("corpus_version") != current)
    order = Window.partitionBy(per).orderBy(F.coalesce("stale", F.lit(True)).desc(), "decayed", F.col("expires_at").asc_nulls_first(), "entry_id")
    return rows.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= count)


# --- replay --------------------------------------------------------------------------------------------

POLICIES = ("lru", "fifo", "lfu", "ttl", "random")


class _Store:
    """One cache of a fixed capacity under one policy."""

    def __init__(self, policy: str, capacity: int, ttl: int) -> None:
        self.policy, self.capacity, self.ttl = policy, capacity, ttl
        self.rows: OrderedDict[str, list[int]] = OrderedDict()
        self.heap: list[tuple[int, int, str]] = []
        self.names: list[str] = []

    def get(self, key: str, now: int) -> str:
        row = self.rows.get(key)
        if row is None:
            return "miss"
        if row[0] <= now:
            del self.rows[key]
            return "expired"
        row[1] += 1
        if self.policy == "lru":
            self.rows.move_to_end(key)
        elif self.policy == "lfu":
            heapq.heappush(self.heap, (row[1], row[2], key))
        return "hit"

    def put(self, key: str, now: int, seq: int) -> int:
        gone = 0
        while len(self.rows) >= self.capacity:
            gone += 1
            if self.policy in ("lru", "fifo"):
                self.rows.popitem(last=False)
                continue
            if self.policy == "random":
                at = (seq * 2654435761) % len(self.names)
                self.names[at], self.names[-1] = self.names[-1], self.names[at]
                if self.rows.pop(self.names.pop(), None) is None:
                    gone -= 1  # it had expired before
                continue
            while True:
                a, s, k = heapq.heappop(self.heap)
                row = self.rows.get(k)
                if row is not None and row[2] == s and (self.policy == "ttl" or row[1] == a):
                    del self.rows[k]
                    break
        self.rows[key] = [now + self.ttl, 0, seq]
        if self.policy == "lfu":
            heapq.heappush(self.heap, (0, seq, key))
        elif self.policy == "random":
            self.names.append(key)
        elif self.policy == "ttl":
            heapq.heappush(self.heap, (now + self.ttl, seq, key))
        return gone


def in_order(rows: DataFrame, keys: Sequence[str], order: Sequence[str], begin: Callable[[tuple], Any], step: Callable[[Any, tuple], tuple | None], finish: Callable[[tuple, Any], tuple | None], schema: str, values: Sequence[str]) -> DataFrame:
    """Runs a state machine over the rows of each key in order, as one pass over sorted partitions.

    ``begin`` makes a key's state, ``step(state, values)`` may return an output row and
    ``finish(key, state)`` another.  A task holds one state and one Arrow batch at a
    time, so the length of a key's log does not count, and short logs cost no call each.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    # A stated number of partitions, as small ones must not be joined: the work is in Python, not in the bytes.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.select(*keys, *order, *[v for v in values if v not in (*keys, *order)]).repartition(parts, *keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple | None = None
        state: Any = None
        for pdf in batches:
            out = []
            columns = [pdf[k].astype(object).where(pdf[k].notna(), None).tolist() for k in (*keys, *values)]
            for row in zip(*columns):
                key, rest = row[: len(keys)], row[len(keys) :]
                if now is None or key != now:
                    if now is not None and (last := finish(now, state)) is not None:
                        out.append(last)
                    now, state = key, begin(key)
                if (made := step(state, rest)) is not None:
                    out.append(made)
            if out:
                yield pd.DataFrame(out, columns=names)
        if now is not None and (last := finish(now, state)) is not None:
            yield pd.DataFrame([last], columns=names)

    return sorted_rows.mapInPandas(run, schema)


def replay(log: DataFrame, arms: DataFrame, ttl: int) -> DataFrame:
    """Replays ``log(shard, at, seq, identity)`` under each of ``arms(policy, capacity)``.

    The state of a cache is sequential by nature.  A cache serves one shard of the key
    space, so shards and arms run side by side.  Invariants: hits + misses + expired =
    queries; writes = misses + expired.
    """
    def begin(key: tuple) -> tuple[_Store, dict[str, int]]:
        return _Store(key[0], int(key[1]), ttl), {"hit": 0, "miss": 0, "expired": 0, "gone": 0}

    def step(state: tuple[_Store, dict[str, int]], row: tuple) -> None:
        store, counts = state
        at, seq, identity = row
        what = store.get(identity, at)
        counts[what] += 1
        if what != "hit":
            counts["gone"] += store.put(identity, at, seq)

    def finish(key: tuple, state: tuple[_Store, dict[str, int]]) -> tuple:
        n = state[1]
        return (*key, n["hit"] + n["miss"] + n["expired"], n["hit"], n["miss"], n["expired"], n["gone"])

    schema = "policy string, capacity int, shard int, queries long, hits long, misses long, expired long, evictions long"
    every = log.crossJoin(F.broadcast(arms))  # a handful of arms
    return in_order(every, ["policy", "capacity", "shard"], ["at", "seq"], begin, step, finish, schema, ["at", "seq", "identity"])


def rate_limited(log: DataFrame, per: str, limit: int, window: int) -> DataFrame:
    """Which requests a sliding window lets through: refused ones do not count.

    ``log(per, at, seq)``; the state of one address is the times of its last ``limit``
    accepted requests.  Rows with a null time are refused.  A pause as long as the
    window empties the state, so an address is cut into bursts at its pauses, and the
    bursts of a busy address are spread over the tasks.
    """
    order = Window.partitionBy(per).orderBy("at", "seq")
    paused = F.when(F.col("at") - F.lag("at").over(order) < window, 0).otherwise(1)
    bursts = log.select(per, "at", "seq").withColumn("_new", paused).withColumn("_burst", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kind = dict(log.dtypes)[per]

    def begin(key: tuple) -> tuple[Any, deque]:
        return key[0], deque()

    def step(state: tuple[Any, deque], row: tuple) -> tuple:
        who, taken = state
        at, seq = row
        if at is None:
            return who, seq, False, 0
        while taken and taken[0] <= at - window:
            taken.popleft()
        if len(taken) < limit:
            taken.append(at)
            return who, seq, True, 0
        return who, seq, False, int(taken[0] + window - at)

    return in_order(bursts, [per, "_burst"], ["at", "seq"], begin, step, lambda key, state: None, f"{per} {kind}, seq long, accepted boolean, retry_after long", ["at", "seq"])


def token_bucket(log: DataFrame, per: str, rate: float, burst: float) -> DataFrame:
    """Waiting time of each request under a token bucket: ``log(per, at, seq, cost)`` with times in seconds.

    A cost over the size of the bucket counts as a full bucket; null costs are free and
    rows with a null time give no row.
    """
    kind = dict(log.dtypes)[per]

    def begin(key: tuple) -> dict[str, Any]:
        return {"who": key[0], "level": burst, "clock": None}

    def step(state: dict[str, Any], row: tuple) -> tuple:
        at, seq, cost = row
        need = min(float(cost or 0.0), burst)
        now = float(at) if state["clock"] is None else max(float(at), state["clock"])
        level = burst if state["clock"] is None else min(burst, state["level"] + (now - state["clock"]) * rate)
        pause = max(0.0, (need - level) / rate)
        state["clock"] = now + pause
        state["level"] = min(burst, level + pause * rate) - need
        return state["who"], seq, round(state["clock"] - float(at), 6)

    return in_order(log.where(F.col("at").isNotNull()), [per], ["at", "seq"], begin, step, lambda key, state: None, f"{per} {kind}, seq long, wait double", ["at", "seq", "cost"])
