"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import use_shared_folder
from ..sources.tables import spread, table
from . import chunking, mixture, pairs, percentiles, sentences, subjects, tokenization

SHARES = (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.sketch(percentiles.measurements(table(spark, d, "usage_records")), "latency_ms", ["model", "role", "day"])


def p1_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Mergeable bucket counts of latency by model, role and day."""
    return _daily(spark, d)


def p1_daily(spark: SparkSession, d: str) -> DataFrame:
    """Latency percentiles by model, role and day."""
    return percentiles.percentiles(_daily(spark, d), ["model", "role", "day"], SHARES)


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Latency percentiles by model and role, from the merged sketches of the days."""
    return percentiles.percentiles(percentiles.merge(_daily(spark, d), ["model", "role"]), ["model", "role"], SHARES)


def _p2_items(spark: SparkSession, d: str) -> DataFrame:
    elements = table(spark, d, "elements").select(F.lit("elements").alias("item_table"), F.col("element_id").alias("item_id"), F.lit(False).alias("is_table"), "text")
    chunks = table(spark, d, "chunks").where(F.col("modality").isin("text", "table"))
    chunks = chunks.select(F.lit("chunks").alias("item_table"), F.col("chunk_id").alias("item_id"), (F.col("modality") == "table").alias("is_table"), F.col("document").alias("text"))
    return spread(elements.unionByName(chunks))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Items over the limit, with the first kind of boundary that brings them under it."""
    return chunking.split_oversized(_p2_items(spark, d)).select("item_table", "item_id", "boundary").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Ordered pieces of the items over the limit."""
    whole = chunking.split_oversized(_p2_items(spark, d)).distinct()
    return whole.select("item_table", "item_id", F.size("pieces").alias("n_pieces"), F.explode("pieces").alias("p")).select("item_table", "item_id", "n_pieces", "p.*")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective question and answer pairs with their defect."""
    use_shared_folder(spark)
    golden = table(spark, d, "golden").where(F.col("expected").isNull() & F.col("expected_behavior").isNull())
    cached = table(spark, d, "cached_answers").where(F.coalesce(F.col("intent") != "OUT_OF_SCOPE", F.lit(True)))
    golden = golden.select(F.lit("golden").alias("pair_table"), F.col("id").alias("pair_id"), "question", F.col("reference_answer").alias("answer"))
    cached = cached.select(F.lit("cached_answers").alias("pair_table"), F.col("entry_id").alias("pair_id"), "question", "answer")
    return pairs.broken_pairs(spread(golden.unionByName(cached)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Sentence units of all documents and text chunk bodies."""
    documents = table(spark, d, "documents").select(F.lit("documents").alias("item_table"), F.col("doc_id").cast("string").alias("item_id"), "text")
    chunks = table(spark, d, "chunks").where(F.col("modality") == "text")
    bodies = chunks.select(F.lit("chunks").alias("item_table"), F.col("chunk_id").alias("item_id"), sentences.chunk_body("document").alias("text"))
    return sentences.split_sentences(spread(documents.unionByName(bodies)))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokenization.encode_corpus(spark, spread(table(spark, d, "documents").select("doc_id", "text")))


def _p7_sizes(spark: SparkSession, d: str) -> DataFrame:
    # Read several times by the schedule, so written once to the shared folder.
    use_shared_folder(spark)
    documents = table(spark, d, "documents").where(F.col("source").isNotNull()).select("doc_id", "source", "text")
    return tokenization.count_tokens(spark, spread(documents)).checkpoint()


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents drawn for the mixture and how often."""
    return mixture.draws(mixture.mix(_p7_sizes(spark, d), table(spark, d, "mix_targets")))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    targets = table(spark, d, "mix_targets")
    return mixture.shares(mixture.mix(_p7_sizes(spark, d), targets), targets)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Documents and their subject areas with the share of sentences that deal with them."""
    use_shared_folder(spark)
    return subjects.subjects_of(spark, spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "subject_labels"), table(spark, d, "subjects"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and their subject areas."""
    return p8_shares(spark, d).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters of the corpus by subject; documents without any count under null."""
    documents = table(spark, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    return documents.join(p8_found(spark, d), "doc_id", "left").groupBy("subject").agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_sketches": p1_sketches,
    "p1_daily": p1_daily,
    "p1_percentiles": p1_percentiles,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_shares": p8_shares,
    "p8_composition": p8_composition,
}
