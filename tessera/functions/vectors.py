"""Vectors: products, hashed term vectors and exact search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Query vectors that are sent to the executors as they are; more are joined in blocks.  4,096 vectors of 1,024 floats are 16 MB.
QUERY_BLOCK = 4096
#: Vectors of one block where queries and vectors meet block by block.
VECTOR_BLOCK = 4096

Decode = Callable[[pd.Series], np.ndarray]


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str) -> Column:
    return F.sqrt(F.aggregate(F.col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: str, b: str) -> Column:
    """Cosine of two vectors; 0 for a zero vector."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def sparse_matrix(dimensions: int) -> Decode:
    """Decodes vectors written as place, weight, place, weight, ..."""

    def decode(column: pd.Series) -> np.ndarray:
        out = np.zeros((len(column), dimensions))
        for row, v in zip(out, column):
            pairs = np.asarray(v, dtype=np.float64)
            row[pairs[::2].astype(np.int64)] = pairs[1::2]
        return out

    return decode


def _products(vectors: DataFrame, queries: DataFrame, key: str, vector: str, decode: Decode, work: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """``work(keys, matrix, query_ids, query_matrix)`` for blocks of vectors and queries, every pair of which meets once.

    Up to ``QUERY_BLOCK`` queries (they are counted) go to all tasks and meet the vectors
    where these are read.  More are cut into blocks by hash, as are the vectors, and each
    pair of blocks is one row of a join, so nothing passes through the driver.
    """
    spark = vectors.sparkSession
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("query_id"), F.col(vector).alias("_q"))
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("_k"), F.col(vector).alias("_v"))
    first = asked.limit(QUERY_BLOCK + 1).toPandas()
    if len(first) <= QUERY_BLOCK:
        first = first.sort_values("query_id", kind="stable")
        sent = spark.sparkContext.broadcast((first["query_id"].to_numpy(dtype=np.int64), decode(first["_q"]) if len(first) else np.zeros((0, 0))))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, m = sent.value
            for pdf in batches:
                for a in range(0, len(pdf), VECTOR_BLOCK):
                    part = pdf.iloc[a : a + VECTOR_BLOCK]
                    if len(ids):
                        yield work(part["_k"].to_numpy(), decode(part["_v"]), ids, m)

        return rows.mapInPandas(scan, schema)
    n_q, n_v = asked.count(), rows.count()
    blocks, chunks = -(-n_q // QUERY_BLOCK), max(1, -(-n_v // VECTOR_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("b")).agg(F.collect_list(F.struct("query_id", "_q")).alias("q")).select("b", "q", every(chunks).alias("c"))
    v = rows.groupBy(F.pmod(F.xxhash64("_k"), F.lit(chunks)).cast("int").alias("c")).agg(F.collect_list(F.struct("_k", "_v")).alias("v")).select("c", "v", every(blocks).alias("b"))
    pairs = q.join(v.hint("merge"), ["b", "c"]).select(F.col("q.query_id").alias("i"), F.col("q._q").alias("q"), F.col("v._k").alias("k"), F.col("v._v").alias("v"))

    def cross(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, qs, k, vs in pdf.itertuples(index=False):
                yield work(np.asarray(k), decode(pd.Series(list(vs))), np.asarray(i, dtype=np.int64), decode(pd.Series(list(qs))))

    return pairs.mapInPandas(cross, schema)


def exact_topk(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", decode: Decode = _matrix, digits: int | None = None) -> DataFrame:
    """The k nearest of ``vectors`` for each query by cosine: query_id, key, score, rank.

    Blocks of vectors meet blocks of queries as matrix products; k rows per query leave a
    block, and ranks are given to these only.  Scores are compared to ``digits`` decimals
    where given.  Ties go to the smaller key; null vectors match nothing.
    """
    kind = dict(vectors.dtypes)[key]

    def work(keys: np.ndarray, matrix: np.ndarray, ids: np.ndarray, m: np.ndarray) -> pd.DataFrame:
        order = np.argsort(keys, kind="stable")
        scores, keys = (_unit(matrix) @ _unit(m).T)[order], keys[order]
        best = np.argsort(-(scores if digits is None else np.round(scores, digits)), axis=0, kind="stable")[:k]
        return pd.DataFrame({"query_id": np.repeat(ids, len(best)), key: keys[best.T.ravel()], "score": np.take_along_axis(scores, best, axis=0).T.ravel()})

    out = _products(vectors, queries, key, vector, decode, work, f"query_id long, {key} {kind}, score double")
    by = F.col("score") if digits is None else F.round("score", digits)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(by.desc(), key)))
    return ranked.where(F.col("rank") <= k)


def best_product(spark: SparkSession, vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The greatest dot product of each vector with any query: key, best."""
    kind = dict(vectors.dtypes)[key]

    def work(keys: np.ndarray, matrix: np.ndarray, ids: np.ndarray, m: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({key: keys, "best": (matrix @ m.T).max(axis=1)})

    return _products(vectors, queries, key, vector, _matrix, work, f"{key} {kind}, best double").groupBy(key).agg(F.max("best").alias("best"))


def packed_terms(tokens: DataFrame, key: str, dimensions: int = 256) -> DataFrame:
    """Hashed term vectors, one row a text: key and ``v``, written as place, weight, place, weight, ..."""
    cells = tokens.groupBy(key, _place(dimensions).alias("bucket")).agg(F.sum("tf").cast("double").alias("c"))
    pairs = F.array_sort(F.collect_list(F.struct("bucket", "c")))
    return cells.groupBy(key).agg(F.flatten(F.transform(pairs, lambda x: F.array(x["bucket"].cast("double"), x["c"]))).alias("v"))


def _place(dimensions: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5("term"), 1, 6), 16, 10).cast("long"), F.lit(dimensions)).cast("int")


def hashed_terms(tokens: DataFrame, key: str, dimensions: int = 256) -> DataFrame:
    """Sparse unit vectors from token counts: key, bucket, weight.  ``tokens(key, term, tf)``."""
    cells = tokens.groupBy(key, _place(dimensions).alias("bucket")).agg(F.sum("tf").cast("double").alias("c"))
    lengths = cells.groupBy(key).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("len"))
    return cells.join(lengths, key).select(key, "bucket", (F.col("c") / F.col("len")).alias("weight"))
