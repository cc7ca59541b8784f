"""Queries of unit conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import units
from ..sources.tables import table


def measured_items(spark: SparkSession, d: str) -> DataFrame:
    """Values of row-fact chunks and golden questions with what tells their unit."""
    facts = table(spark, d, "chunks").where((F.col("modality") == "row_fact") & F.col("value_fy2026").isNotNull())
    facts = facts.select(
        F.lit("chunks").alias("item_table"), F.col("chunk_id").alias("item_id"), F.col("value_fy2026").alias("value"), "unit", F.col("document").alias("text"),
        F.col("line_item").alias("category"), F.col("filing_id").alias("source"), F.coalesce("value_fy2025", "value_fy2024").alias("neighbour"),
    )
    asked = table(spark, d, "golden").where(F.col("expected.value").isNotNull())
    category = F.regexp_extract("question", r"(?i)^(?:give|how much was|what was|what were)\s+(.*?)\s+(?:of|for|at)\s", 1)
    asked = asked.select(
        F.lit("golden").alias("item_table"), F.col("id").alias("item_id"), F.col("expected.value").alias("value"), F.col("expected.unit").alias("unit"),
        F.concat_ws(" ", "question", "notes").alias("text"), category.alias("category"), F.lit("golden").alias("source"), F.lit(None).cast("double").alias("neighbour"),
    )
    return facts.unionByName(asked)


def p4_all(spark: SparkSession, d: str) -> DataFrame:
    """Every value with its unit, how that was found, and the value in the common unit."""
    whole = units.convert(units.resolve(measured_items(spark, d)), table(spark, d, "unit_targets"))
    return whole.select("item_table", "item_id", "value", "resolved", "by", "confidence", "dimension", "common_unit", "common_value").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Values that were not in the common unit, converted."""
    whole = units.convert(units.resolve(measured_items(spark, d)), table(spark, d, "unit_targets"))
    moved = whole.where(F.col("resolved").isNotNull() & (F.col("resolved") != F.col("common_unit")))
    return moved.select("item_table", "item_id", "common_value").distinct()


def p4_review(spark: SparkSession, d: str) -> DataFrame:
    """Values whose unit the field does not tell and the forest only guesses, or guesses against the text."""
    left = units.resolve(measured_items(spark, d)).where(F.col("by") == "review")
    return left.select("item_table", "item_id", "value", "category", "predicted", "confidence").distinct()


QUERIES = {"p4_found": p4_found, "p4_all": p4_all, "p4_review": p4_review}
