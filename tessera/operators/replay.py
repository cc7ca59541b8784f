"""Replay of a query log against a two-tier semantic cache under many policies at once.

A query first meets the exact tier (its own text), then the guarded semantic tier: live
entries with the same guard keys, of which the most similar serves it if it passes the
threshold.  A semantic hit is promoted to the exact tier; a miss is written.  The state of
a cache is sequential by nature, so a cache serves one shard of the key space: shards run
side by side, and a task replays all arms in one pass over its sorted log, so vectors
travel once however many arms there are.

Counts: queries = hits + misses, hits = exact + semantic = correct + wrong, writes = misses;
stale hits occur only where a policy ignores expiry.  A hit is correct if it serves the
identity that was asked.  Random policies and counters draw from a generator seeded by arm
and shard, so a replay gives the same on every run.
"""

from __future__ import annotations

import heapq
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cache import COUNTER_MAX

COUNTS = ("queries", "hits", "exact", "semantic", "correct", "wrong", "stale", "misses", "evictions", "expired")


@dataclass(eq=False)
class _Entry:
    seq: int
    identity: str
    guard: str
    vector: np.ndarray
    expires: int
    used: int
    aged: int
    counter: int
    texts: set[str] = field(default_factory=set)
    slot: int = 0


@dataclass(frozen=True)
class Policy:
    """How a full cache picks its victim: the least ``order`` of its entries (at a time, where it depends on that)."""

    order: Callable[[_Entry, int], tuple] | None
    ages: bool = False
    expires: bool = True
    bounded: bool = True
    counts: bool = False


def _faded(e: _Entry, now: int, period: int) -> int:
    return max(e.counter - max(now - e.aged, 0) // period, 0)


#: Seconds without a hit after which a counter loses one, and the counter of a new entry.
PERIOD, START = 86_400, 5

POLICIES: dict[str, Policy] = {
    "lfu_fading": Policy(lambda e, now: (_faded(e, now, PERIOD), e.expires, e.seq), ages=True, counts=True),
    "lfu": Policy(lambda e, now: (e.counter, e.expires, e.seq), counts=True),
    "lru": Policy(lambda e, now: (e.used, e.seq)),
    "mru": Policy(lambda e, now: (-e.used, -e.seq)),
    "fifo": Policy(lambda e, now: (e.seq,)),
    "soonest_expiry": Policy(lambda e, now: (e.expires, e.seq)),
    "random": Policy(None),
    "expiry_only": Policy(None, bounded=False),
    "lru_no_expiry": Policy(lambda e, now: (e.used, e.seq), expires=False),
}


class Cache:
    """One cache of one arm and shard."""

    def __init__(self, policy: str, capacity: int, seed: str = "") -> None:
        self.policy, self.capacity = POLICIES[policy], capacity
        self.rng = random.Random(f"{policy}/{capacity}/{seed}")
        self.by_guard: dict[str, list[_Entry]] = {}
        self.by_text: dict[str, _Entry] = {}
        self.entries: list[_Entry] = []
        self.heap: list[tuple[tuple, int, _Entry]] = []
        self.ends: list[tuple[int, int, _Entry]] = []
        self.n = dict.fromkeys(COUNTS, 0)
        self.seq = 0

    def _drop(self, e: _Entry) -> None:
        last = self.entries.pop()
        if last is not e:  # the last takes its place
            self.entries[e.slot], last.slot = last, e.slot
        e.slot = -1
        bucket = self.by_guard[e.guard]
        bucket.remove(e)
        if not bucket:
            del self.by_guard[e.guard]
        for t in e.texts:
            if self.by_text.get(t) is e:
                del self.by_text[t]

    def _expire(self, now: int) -> None:
        while self.ends and self.ends[0][0] <= now:
            e = heapq.heappop(self.ends)[2]
            if e.slot >= 0:
                self._drop(e)
                self.n["expired"] += 1

    def _victim(self, now: int) -> _Entry:
        order = self.policy.order
        if order is None:
            return self.entries[self.rng.randrange(len(self.entries))]
        if self.policy.ages:
            return min(self.entries, key=lambda e: order(e, now))
        while True:  # entries whose place has changed since stand in the heap again
            rank, _, e = self.heap[0]
            if e.slot >= 0 and order(e, now) == rank:
                return e
            heapq.heappop(self.heap)

    def _rank(self, e: _Entry, now: int) -> None:
        if self.policy.order is not None and not self.policy.ages:
            heapq.heappush(self.heap, (self.policy.order(e, now), e.seq, e))

    def ask(self, now: int, text: str, identity: str, guard: str, vector: np.ndarray, least: float, ttl: int) -> str:
        """Serves one query: "exact", "semantic" or "miss"."""
        n = self.n
        n["queries"] += 1
        if self.policy.expires:
            self._expire(now)
        hit, tier = self.by_text.get(text), "exact"
        if hit is not None and hit.guard != guard:
            hit = None
        if hit is None and (near := self.by_guard.get(guard)):
            tier = "semantic"
            sims = np.stack([e.vector for e in near]) @ vector
            k = int(sims.argmax())
            if sims[k] >= least:
                hit = near[k]
                hit.texts.add(text)
                self.by_text[text] = hit
        if hit is not None:
            n["hits"] += 1
            n[tier] += 1
            n["correct" if hit.identity == identity else "wrong"] += 1
            n["stale"] += hit.expires <= now
            hit.used = now
            if self.policy.counts:
                if self.policy.ages:
                    hit.counter, hit.aged = _faded(hit, now, PERIOD), now
                if hit.counter < COUNTER_MAX and self.rng.random() < 1 / (max(hit.counter - START, 0) * 10 + 1):
                    hit.counter += 1
            self._rank(hit, now)
            return tier
        n["misses"] += 1
        e = _Entry(self.seq, identity, guard, vector, now + ttl, now, now, START, {text}, len(self.entries))
        self.seq += 1
        # Room is made first, so a new entry is never its own victim.
        while self.policy.bounded and len(self.entries) >= self.capacity:
            self._drop(self._victim(now))
            n["evictions"] += 1
        e.slot = len(self.entries)
        self.entries.append(e)
        self.by_guard.setdefault(guard, []).append(e)
        self.by_text[text] = e
        heapq.heappush(self.ends, (e.expires, e.seq, e))
        self._rank(e, now)
        return "miss"


def replay_semantic(log: DataFrame, capacities: list[int], policies: list[str] | None = None) -> DataFrame:
    """``policy, capacity, shard`` and the counts of each arm over ``log(shard, at, seq, text, identity, guard, vector, least, ttl)``.

    ``vector`` has length 1 or 0; a null text, guard or identity is an empty one; null ``vector`` matches nothing.
    """
    chosen = list(policies or POLICIES)
    names = ["policy", "capacity", "shard", *COUNTS]
    columns = ["shard", "at", "seq", "text", "identity", "guard", "vector", "least", "ttl"]
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = log.select(*columns).repartition(parts, "shard").sortWithinPartitions("shard", "at", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard: int | None = None
        caches: dict[tuple[str, int], Cache] = {}

        def counted() -> pd.DataFrame:
            return pd.DataFrame([(p, c, shard, *cache.n.values()) for (p, c), cache in caches.items()], columns=names)

        for pdf in batches:
            for here, at, _, text, identity, guard, vector, least, ttl in pdf.itertuples(index=False):
                if here != shard:
                    if caches:
                        yield counted()
                    shard = here
                    caches = {(p, c): Cache(p, c, str(here)) for p in chosen for c in capacities}
                v = np.asarray(vector, dtype=np.float32) if vector is not None else np.zeros(0, dtype=np.float32)
                key = guard or ""
                if not len(v):
                    key, v = f"{key}\x00{text}", np.zeros(1, dtype=np.float32)
                for cache in caches.values():
                    cache.ask(int(at), text or "", identity or "", key, v, least, int(ttl))
        if caches:
            yield counted()

    schema = "policy string, capacity int, shard int, " + ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInPandas(run, schema)


def policy_rates(counted: DataFrame) -> DataFrame:
    """Counts of all shards and the rates of correct, wrong and stale hits by ``policy, capacity``."""
    by = counted.groupBy("policy", "capacity").agg(*[F.sum(c).alias(c) for c in COUNTS])
    rates = {f"{name}_rate": F.coalesce(F.try_divide(F.col(c), F.col("queries")), F.lit(0.0)) for name, c in (("hit", "hits"), ("correct", "correct"), ("wrong", "wrong"), ("stale", "stale"))}
    return by.withColumns(rates)


def promotion(rates: DataFrame, chosen: str, points: float = 0.05, at_least: int = 2) -> DataFrame:
    """Policies that beat the chosen one's rate of correct hits by ``points`` at ``at_least`` capacities: ``policy, wins, best_gain, promoted``."""
    base = rates.where(F.col("policy") == chosen).select("capacity", F.col("correct_rate").alias("base"))
    gain = F.col("correct_rate") - F.col("base")
    both = rates.where(F.col("policy") != chosen).join(base.hint("merge"), "capacity")
    wins = F.sum((gain >= points - 1e-12).cast("int"))
    return both.groupBy("policy").agg(wins.alias("wins"), F.max(gain).alias("best_gain"), (wins >= at_least).alias("promoted"))
