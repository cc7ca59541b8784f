"""Passages from runs of layout elements."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_small(sizes: Sequence[int], least: int, most: int) -> list[tuple[int, int]]:
    """Groups of neighbours as (first, beyond): pieces under ``least`` join their smaller neighbour if both stay within ``most``.

    The smallest piece goes first, the left one of equals.  A piece that finds no room
    never will, as neighbours only grow, so each is looked at once: n log n in all.
    """
    n = len(sizes)
    size, end = list(sizes), [i + 1 for i in range(n)]
    before, after, alive = [i - 1 for i in range(n)], [i + 1 for i in range(n)], [True] * n
    heap = [(s, i) for i, s in enumerate(sizes) if s < least]
    heapq.heapify(heap)
    while heap:
        s, i = heapq.heappop(heap)
        if not alive[i] or size[i] != s:
            continue
        near = [j for j in (before[i], after[i]) if 0 <= j < n and size[j] + s <= most]
        if not near:
            continue
        j = min(near, key=lambda x: (size[x], x))
        a, b = min(i, j), max(i, j)
        size[a] += size[b]
        end[a], after[a], alive[b] = end[b], after[b], False
        if after[b] < n:
            before[after[b]] = a
        if size[a] < least:
            heapq.heappush(heap, (size[a], a))
    return [(i, end[i]) for i in range(n) if alive[i]]


def merge_blocks(rows: DataFrame, groups: Sequence[str], order: Sequence[str], key: str, size: str, least: int = 120, most: int = 450) -> DataFrame:
    """Elements of each block merged into passages: groups, chunk_no, first_id, tokens.

    A block's sizes travel as one array of numbers, so a batch of Arrow holds many
    blocks and no function is called once a block from the JVM.
    """
    kinds = dict(rows.dtypes)
    packed = rows.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct(*order, key, size))).alias("_x"))
    packed = packed.select(*groups, F.col(f"_x.{key}").alias("_ids"), F.transform(f"_x.{size}", lambda s: F.coalesce(s, F.lit(0))).alias("_sizes"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                *g, ids, sizes = row
                sizes = [int(s) for s in sizes]
                for number, (a, b) in enumerate(merge_small(sizes, least, most)):
                    out.append((*g, number, ids[a], sum(sizes[a:b])))
            if out:
                yield pd.DataFrame(out, columns=[*groups, "chunk_no", "first_id", "tokens"])

    schema = ", ".join(f"{g} {kinds[g]}" for g in groups)
    return packed.mapInPandas(work, f"{schema}, chunk_no int, first_id {kinds[key]}, tokens long")


#: Items of one group that one product of matrices compares with as many others, and words it takes at once.
BLOCK = 1024
WORDS = 4096


def _shared(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """How many words each item of ``b`` has in common with each of ``a``; words end to end, with their numbers an item."""
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    ra, rb = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    pa, pb = place[: len(a)], place[len(a) :]
    out = np.zeros((len(nb), len(na)), dtype=np.float32)
    for low in range(0, len(names), WORDS):
        width = min(WORDS, len(names) - low)
        ma, mb = np.zeros((len(na), width), dtype=np.float32), np.zeros((len(nb), width), dtype=np.float32)
        ina, inb = (pa >= low) & (pa < low + width), (pb >= low) & (pb < low + width)
        ma[ra[ina], pa[ina] - low] = 1
        mb[rb[inb], pb[inb] - low] = 1
        out += mb @ ma.T
    return out


def most_similar_before(items: DataFrame, group: str, key: str, rank: str, words: str) -> DataFrame:
    """``key, dup_of, sim``: of all items of the group with a smaller rank the one with the greatest Jaccard similarity.

    Every pair of a group is compared; the smaller rank wins among equals, a pair
    without any word has no similarity, and items without a group are left out.
    ``words`` are distinct.  Runs of ``BLOCK`` ranks are compared as products of
    matrices, and a pair of runs is one row, so a hot group is spread over the tasks.
    """
    kinds = dict(items.dtypes)
    rows = items.where(F.col(group).isNotNull()).select(
        F.col(group).alias("_g"), F.floor((F.col(rank) - 1) / BLOCK).cast("int").alias("_block"), F.col(rank).cast("long").alias("_rank"), F.col(key).alias("_key"), F.transform(words, lambda w: F.xxhash64(w)).alias("_w")
    )
    packed = rows.groupBy("_g", "_block").agg(F.array_sort(F.collect_list(F.struct("_rank", "_key", "_w"))).alias("_x"))
    runs = packed.select("_g", "_block", F.col("_x._rank").alias("ranks"), F.col("_x._key").alias("ids"), F.flatten("_x._w").alias("words"), F.transform("_x._w", lambda w: F.size(w)).alias("sizes"))
    last = rows.groupBy("_g").agg(F.max("_block").alias("_last"))
    runs = runs.join(last, "_g")
    # Each run meets itself and every run after it.
    left = runs.select("_g", F.col("_block").alias("_i"), F.explode(F.sequence("_block", "_last")).alias("_j"), *[F.col(c).alias(f"a_{c}") for c in ("ranks", "ids", "words", "sizes")])
    right = runs.select("_g", F.col("_block").alias("_j"), F.explode(F.sequence(F.lit(0), F.col("_block"))).alias("_i"), *[F.col(c).alias(f"b_{c}") for c in ("ranks", "ids", "words", "sizes")])
    both = left.join(right, ["_g", "_i", "_j"]).drop("_g", "_i", "_j")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ra, ka, wa, na, rb, kb, wb, nb in pdf.itertuples(index=False):
                na, nb = np.asarray(na), np.asarray(nb)
                common = _shared(np.asarray(wa, dtype=np.int64), na, np.asarray(wb, dtype=np.int64), nb).astype(np.float64)
                union = nb[:, None] + na[None, :] - common
                seen = (np.asarray(ra)[None, :] < np.asarray(rb)[:, None]) & (union > 0)
                sim = np.where(seen, common / np.where(union > 0, union, 1), -1.0)
                top = sim.argmax(axis=1)  # the first of equals, as ranks rise
                out += [(kb[n], ka[t], int(ra[t]), float(sim[n, t])) for n, t in enumerate(top) if sim[n, t] >= 0]
            yield pd.DataFrame(out, columns=["_key", "dup_of", "_rank", "sim"])

    found = both.mapInPandas(work, f"_key {kinds[key]}, dup_of {kinds[key]}, _rank long, sim double")
    best = found.groupBy("_key").agg(F.max(F.struct("sim", (-F.col("_rank")).alias("_r"), "dup_of")).alias("_b"))
    return best.select(F.col("_key").alias(key), F.col("_b.dup_of").alias("dup_of"), F.col("_b.sim").alias("sim"))
