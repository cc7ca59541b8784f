"""MinHash candidates with exact verification, and connected classes, as DataFrame joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
SIMILARITY = 0.8


def word_shingles(tokens: F.Column, width: int = SHINGLE_WORDS) -> F.Column:
    """Hashes of all runs of ``width`` tokens, or of the whole where there are fewer; distinct, sorted."""
    n = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - (width - 1))), lambda i: F.xxhash64(F.array_join(F.slice(tokens, i, width), " ")))
    return F.when(n > 0, F.array_sort(F.array_distinct(runs))).otherwise(F.array().cast("array<bigint>"))


def signature(shingles: Column, size: int, seed: int = 0) -> Column:
    """MinHash values of a set of hashes: two sets agree in each with a chance of their Jaccard similarity; null if empty."""
    return F.when(F.size(shingles) > 0, F.array(*[F.array_min(F.transform(shingles, _reseeded(seed + k))) for k in range(size)]))


def _reseeded(seed: int) -> Callable[[Column], Column]:
    return lambda s: F.xxhash64(s, F.lit(seed))


#: Members of one bucket that are compared with as many others in one join key.
BLOCK = 256


def similar_pairs(items: DataFrame, key: str, shingles: str, bands: int = 16, rows: int = 3, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs ``a < b`` of ``items`` whose shingle sets have a verified Jaccard similarity.

    ``items`` must be distinct: copies are to be grouped before.  A pair of similarity s
    is missed with a chance of (1 - s^rows)^bands: 1 in 100,000 at 0.8 with 16 bands of
    3 rows, and at 0.5 with 40 bands of 2 rows.  A bucket of many members is split into
    blocks of about ``BLOCK``, and pairs of blocks are separate keys, so a hot bucket is
    spread over the tasks; only keys travel, and sets are fetched for the candidates.
    """
    sets = items.select(key, shingles).where(F.size(shingles) > 0)
    least = signature(F.col(shingles), bands * rows)
    banded = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice("_m", b * rows + 1, rows)))
    long = sets.select(key, least.alias("_m")).select(key, F.explode(banded).alias("_bucket"))
    sizes = long.groupBy("_bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"), F.count("*").alias("_n")).where("_n > 1")
    placed = long.join(sizes.select("_bucket", "_blocks").hint("merge"), "_bucket").withColumn("_i", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_j")
    a = placed.select(F.col(key).alias("a"), "_bucket", "_i", each)
    b = placed.select(F.col(key).alias("b"), "_bucket", F.col("_i").alias("_j"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_i"))
    found = a.join(b.hint("merge"), ["_bucket", "_i", "_j"]).where("a < b").select("a", "b").distinct()
    found = found.join(sets.select(F.col(key).alias("a"), F.col(shingles).alias("_sa")).hint("merge"), "a").join(sets.select(F.col(key).alias("b"), F.col(shingles).alias("_sb")).hint("merge"), "b")
    common = F.size(F.array_intersect("_sa", "_sb"))
    return found.select("a", "b", (common / (F.size("_sa") + F.size("_sb") - common)).alias("similarity")).where(F.col("similarity") >= similarity)


def near_pairs(items: DataFrame, key: str, shingles: str, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs of ``similar_pairs`` for long texts of few templates, whose bands would collide; none is missed.

    Sets of a Jaccard similarity s share one of the n - ceil(s n) + 1 rarest members of
    each, so only those are joined, and candidates are verified.
    """
    sets = items.select(key, shingles).where(F.size(shingles) > 0)
    each = sets.select(key, F.size(shingles).alias("_n"), F.explode(shingles).alias("_s"))
    often = each.groupBy("_s").agg(F.count("*").alias("_f")).where("_f > 1")
    ordered = each.join(often, "_s", "left").groupBy(key, "_n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_f", F.lit(1)).alias("f"), F.col("_s").alias("s")))).alias("_o"))
    prefix = F.slice("_o", F.lit(1), (F.col("_n") - F.ceil(F.col("_n") * similarity - 1e-9) + 1).cast("int"))
    rare = ordered.select(key, "_n", F.explode(F.filter(prefix, lambda x: x["f"] > 1)).alias("_x")).select(key, "_n", F.col("_x.s").alias("_s"))
    a, b = rare.select(F.col(key).alias("a"), F.col("_n").alias("_na"), "_s"), rare.select(F.col(key).alias("b"), F.col("_n").alias("_nb"), "_s")
    found = a.join(b, "_s").where("a < b").where(F.least("_na", "_nb") >= F.greatest("_na", "_nb") * similarity - 1e-9).select("a", "b").distinct()
    found = found.join(sets.select(F.col(key).alias("a"), F.col(shingles).alias("_sa")), "a").join(sets.select(F.col(key).alias("b"), F.col(shingles).alias("_sb")), "b")
    common = F.size(F.array_intersect("_sa", "_sb"))
    return found.select("a", "b", (common / (F.size("_sa") + F.size("_sb") - common)).alias("similarity")).where(F.col("similarity") >= similarity)


def classes(items: DataFrame, links: DataFrame, key: str, rounds: int = 30) -> DataFrame:
    """``key`` and ``class``, the least key that can be reached over ``links(a, b)``.

    Labels spread by joins, with a pointer jump in each round, until none changes;
    the links are kept on the shared folder.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = items.select(key, F.col(key).alias("class")).checkpoint()
    for _ in range(rounds):
        near = both.join(labels.select(F.col(key).alias("b"), "class"), "b").groupBy(F.col("a").alias(key)).agg(F.min("class").alias("_near"))
        step = labels.join(near, key, "left").select(key, F.least("class", F.coalesce("_near", "class")).alias("class"), F.col("class").alias("_old"))
        jump = step.select(F.col(key).alias("_k"), F.col("class").alias("_c"))
        done = step.join(jump, F.col("class") == F.col("_k"), "left").select(key, F.least("class", F.coalesce("_c", "class")).alias("class"), "_old").checkpoint()
        labels = done.select(key, "class")
        if done.where(F.col("class") != F.col("_old")).isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")

