"""Mixing sources to target weights (problem 7).

Weighted fair queueing: the documents of a source are shuffled by a seeded hash
and laid end to end, epoch after epoch up to the source's cap; the virtual
finish time of a copy is its cumulative tokens divided by the target share.
Copies are taken in order of finish time until the token budget is reached, so
at any point every source has had its share to within one document; a source that
is used up leaves the rest of the budget to the others.

The default budget is the largest that no source's cap cuts short.  Running sums
are made in two levels: sums by hash bucket, offsets from a small table of
bucket sums, and rows inside their bucket, so a source with a third of all rows
never stands in one task; the global cut works likewise over ranges of time.  The
numbers of buckets and ranges grow with the corpus (``ROWS_PER_TASK``).

Copies that finish after the horizon are left out before the global sort.  The
horizon is proven: at virtual time v a source has used at least min(share v, all it
has) less one document, so a copy whose position is within the budget has a finish
time at which these sum up to no more than the budget and one longest document a source.

Defined cases: null and unknown sources take no part; empty and null texts have
no tokens and are not drawn; ties in hash or finish time are broken by doc_id;
a source without tokens is left out and the other shares keep their proportions
(the report shows what it missed); repeated rows are documents of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Copies that one task sorts.
ROWS_PER_TASK = 100_000
#: Sources are collected to the driver, one row each.
MOST_SOURCES = 10_000


@dataclass(frozen=True)
class Plan:
    """What is known of the sources before any copy is placed; ``caps`` has (source, share, max_repeats)."""

    caps: list[tuple[str, float, int]]
    budget: int
    horizon: float
    buckets: int
    slices: int


def horizon(sources: list[tuple[float, float, float]], budget: float) -> float:
    """Virtual time after which no copy can lie within ``budget``, of sources (share, tokens with repeats, longest document)."""
    goal = budget + sum(longest for _, _, longest in sources) + 1
    used, time = 0.0, 0.0
    alive = sorted((tokens / share, share) for share, tokens, _ in sources)
    while alive:
        rate = sum(share for _, share in alive)
        end = alive[0][0]
        if used + rate * (end - time) >= goal:
            return time + (goal - used) / rate
        used += rate * (end - time)
        time = end
        alive = alive[1:]
    return time


def capacity(sizes: DataFrame, targets: DataFrame, budget: int | None = None) -> Plan:
    """Target sources that have tokens, their shares made to add up to 1, and the budget: the largest every source can fill."""
    have = sizes.where(F.col("n_tokens") > 0).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"), F.count("*").alias("docs"))
    wanted = targets.where((F.col("target_share") > 0) & (F.col("max_repeats") > 0)).groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    rows = wanted.join(have, "source").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if not rows:
        return Plan([], 0, 0.0, 1, 1)
    every = sum(sorted(r["share"] for r in rows))
    caps = sorted((r["source"], r["share"] / every, r["repeats"]) for r in rows)
    by = {r["source"]: r for r in rows}
    if budget is None:
        budget = min(int(by[s]["tokens"] * n / w) for s, w, n in caps)
    copies = sum(r["docs"] * r["repeats"] for r in rows)
    end = horizon([(w, float(by[s]["tokens"] * n), float(by[s]["longest"])) for s, w, n in caps], budget)
    return Plan(caps, budget, end * (1 + 1e-9), max(1, -(-max(r["docs"] for r in rows) // ROWS_PER_TASK)), max(1, -(-copies // ROWS_PER_TASK)))


def schedule(sizes: DataFrame, plan: Plan, seed: int = 0) -> DataFrame:
    """Every copy with its virtual finish time: doc_id, source, epoch, n_tokens, finish.

    ``sizes(doc_id, source, n_tokens)`` may hold extra columns; they are ignored.
    """
    caps = F.broadcast(sizes.sparkSession.createDataFrame(plan.caps, "source string, target_share double, max_repeats int"))  # a row a source
    docs = sizes.where((F.col("n_tokens") > 0) & F.col("source").isNotNull()).select("doc_id", "source", "n_tokens")
    copies = docs.join(caps, "source").select("doc_id", "source", "n_tokens", "target_share", F.explode(F.sequence(F.lit(1), F.col("max_repeats"))).alias("epoch"))
    key = F.xxhash64("doc_id", "epoch", F.lit(seed))
    copies = copies.withColumn("_key", key).withColumn("_b", F.pmod("_key", F.lit(plan.buckets)).cast("int"))
    lane = ["source", "epoch", "_b"]
    sums = copies.groupBy(*lane).agg(F.sum("n_tokens").alias("_sum"))
    before = Window.partitionBy("source").orderBy("epoch", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*lane, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))  # sources x epochs x buckets rows
    inside = Window.partitionBy(*lane).orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = copies.withColumn("_within", F.sum("n_tokens").over(inside)).join(offsets.hint("merge"), lane)
    return placed.select("doc_id", "source", "epoch", "n_tokens", ((F.col("_before") + F.col("_within")) / F.col("target_share")).alias("finish"))


def mix(sizes: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 0) -> DataFrame:
    """The copies drawn: schedule rows in order of finish time while their running total is within the budget."""
    plan = capacity(sizes, targets, budget)
    near = schedule(sizes, plan, seed).where(F.col("finish") <= plan.horizon)
    # Sources run at even rates, so even ranges of time hold about as many tokens each.
    near = near.withColumn("_s", F.floor(F.col("finish") / (plan.horizon + 1) * plan.slices).cast("int"))
    sums = near.groupBy("_s").agg(F.sum("n_tokens").alias("_sum"))
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    offsets = sums.select("_s", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")).where(F.col("_before") <= plan.budget)
    inside = Window.partitionBy("_s").orderBy("finish", "source", "epoch", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = near.withColumn("_within", F.sum("n_tokens").over(inside)).join(offsets.hint("merge"), "_s").withColumn("position", F.col("_before") + F.col("_within"))
    return placed.where(F.col("position") <= plan.budget).select("doc_id", "source", "epoch", "n_tokens", "finish", "position")


def draws(mixed: DataFrame) -> DataFrame:
    """One row per document drawn: doc_id, source, n_tokens, repeats."""
    return mixed.groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n_tokens"), F.count("*").cast("int").alias("repeats"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Shares reached: source, target_share, actual_share, tokens, draws, documents, max_used, max_repeats."""
    by = mixed.groupBy("source").agg(
        F.sum("n_tokens").alias("tokens"), F.count("*").alias("draws"), F.countDistinct("doc_id").alias("documents"), F.max("epoch").cast("int").alias("max_used")
    )
    total = by.agg(F.sum("tokens").alias("_total"))
    full = targets.join(by, "source", "left").crossJoin(F.broadcast(total))
    none = F.lit(0).cast("long")
    return full.select(
        "source", "target_share", F.coalesce(F.try_divide(F.col("tokens"), F.col("_total")), F.lit(0.0)).alias("actual_share"),
        F.coalesce("tokens", none).alias("tokens"), F.coalesce("draws", none).alias("draws"), F.coalesce("documents", none).alias("documents"),
        F.coalesce("max_used", F.lit(0)).alias("max_used"), "max_repeats",
    )
