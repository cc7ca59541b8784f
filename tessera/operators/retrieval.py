"""Retrieval: lexical index, ranked lists, fusion, gates and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import raw_tokens, token_forms

# --- fixed values: parameters of BM25 and of rank fusion --------------------------------------------------
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60


def postings(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Term counts: key, term, tf.  Counted by a partial aggregation before the shuffle.

    Raw tokens become rows first, so that their forms are made in generated code, and
    only tokens that have several forms are made into arrays.
    """
    raw = texts.select(key, F.explode(raw_tokens(F.col(text))).alias("_t"))
    forms = F.when(F.col("_t").rlike("[-',$]"), token_forms(F.col("_t"))).otherwise(F.array("_t"))
    return raw.select(key, F.explode(forms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def lengths(posts: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Length of every text in tokens, 0 for those without."""
    return texts.select(key).distinct().join(posts.groupBy(key).agg(F.sum("tf").alias("dl")), key, "left").select(key, F.coalesce("dl", F.lit(0)).alias("dl"))


def term_weights(posts: DataFrame, n_docs: DataFrame) -> DataFrame:
    """Inverse document frequency of each term; negative ones are raised to a share of the mean."""
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(n_docs)).select("term", "df", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = idf.agg((EPSILON * F.avg("raw")).alias("floor"))
    return idf.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def bm25(posts: DataFrame, docs: DataFrame, query_terms: DataFrame, key: str) -> DataFrame:
    """Scores of all texts that share a term with a query: query_id, key, score > 0.

    ``query_terms(query_id, term, qtf)``.  Postings meet the queries on the term; a hot
    term is one row on the query side, and sums are partial before the shuffle.
    """
    size = docs.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    weights = term_weights(posts, size.select("n_docs"))
    hits = posts.join(query_terms, "term").join(weights, "term").join(docs, key).crossJoin(F.broadcast(size.select("avgdl")))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", key).agg(F.sum(F.col("qtf") * part).alias("score")).where(F.col("score") > 0)


def ranked(scores: DataFrame, key: str, k: int, by: str = "query_id") -> DataFrame:
    """Ranks from 1 by score, ties to the smaller key, up to k.  Scores are compared to 9 decimals."""
    order = Window.partitionBy(by).orderBy(F.round("score", 9).desc(), key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rrf(lists: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion over all lists of a query: query_id, key, rrf, n_lists, best_rank."""
    return lists.groupBy("query_id", key).agg(
        F.sum(1 / (k + F.col("rank"))).alias("rrf"), F.count("*").alias("n_lists"), F.min("rank").alias("best_rank")
    )


def where(condition: dict) -> Column:
    """A metadata filter: field equality, ``$in``, ``$eq`` and ``$and``; null fails."""
    if "$and" in condition:
        out = F.lit(True)
        for part in condition["$and"]:
            out = out & where(part)
        return out
    ((field, value),) = condition.items()
    if isinstance(value, dict):
        ((op, arg),) = value.items()
        test = F.col(field).isin(list(arg)) if op == "$in" else F.col(field) == F.lit(arg)
        if op not in ("$in", "$eq"):
            raise ValueError(f"unknown operator {op}")
    else:
        test = F.col(field) == F.lit(value)
    return F.coalesce(test, F.lit(False))


def with_retry(filtered: DataFrame, unfiltered: DataFrame, key: str, least: int = 3) -> DataFrame:
    """The filtered lists, but for queries with fewer than ``least`` results the unfiltered ones."""
    enough = filtered.groupBy("query_id").agg(F.countDistinct(key).alias("n")).where(F.col("n") >= least).select("query_id")
    return filtered.join(enough, "query_id", "left_semi").unionByName(unfiltered.join(enough, "query_id", "left_anti"))


def expand_parents(candidates: DataFrame, children: DataFrame, parts: DataFrame) -> DataFrame:
    """Table parts that row-fact candidates pull in: query_id, chunk_id, expanded_from.

    ``candidates(query_id, chunk_id, rank)``, ``children(chunk_id, parent_id)``,
    ``parts(parent_id, part_id, part_no)``.  A part already among the candidates is left
    out; of several candidates that pull it the best ranked counts.
    """
    # One candidate stands for each parent, so a parent's parts are not repeated for all its children.
    held = candidates.join(children.where(F.col("parent_id").isNotNull()), "chunk_id")
    held = held.groupBy("query_id", "parent_id").agg(F.min(F.struct("rank", "chunk_id")).alias("_c"))
    pulled = held.join(parts, "parent_id").select("query_id", "part_id", F.struct("_c.rank", "_c.chunk_id", "part_no").alias("_c"))
    new = pulled.join(candidates.select("query_id", F.col("chunk_id").alias("part_id")), ["query_id", "part_id"], "left_anti")
    first = new.groupBy("query_id", "part_id").agg(F.min("_c").alias("_c"))
    return first.select("query_id", F.col("part_id").alias("chunk_id"), F.col("_c.chunk_id").alias("expanded_from"), F.col("_c.part_no").alias("part_no"))


def floor_and_keep(scored: DataFrame, key: str, floor: float, min_keep: int, final_k: int) -> DataFrame:
    """Reordered candidates above a floor, at least ``min_keep`` of them, at most ``final_k``."""
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), key)
    out = scored.withColumn("rerank_rank", F.row_number().over(order))
    return out.where(((F.col("rerank_score") >= floor) | (F.col("rerank_rank") <= min_keep)) & (F.col("rerank_rank") <= final_k))


def fill_budget(items: DataFrame, group: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """Greedy fill in order: an item that does not fit is skipped, later ones are still tried.

    Items of one group are one question's context, so their array is small; the fold
    runs inside the JVM.
    """
    rows = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, cost))).alias("_i"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(rows.schema["_i"].dataType).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x[cost] <= budget
        return F.struct(
            F.when(fits, acc["used"] + x[cost]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"),
        )

    filled = rows.select(group, F.aggregate("_i", start, step).alias("f"))
    return filled.select(group, F.col("f.used").alias("used"), F.explode("f.kept").alias("x")).select(group, "used", "x.*")
