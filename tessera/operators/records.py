"""Records around retrieval: stored indexes, traces, figures of a page, page lookups, fact texts, and small checks.

Everything is a composition of DataFrame operations.  Null keys match nothing; empty
tables give empty results; the cases of single functions stand at each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .statements import label_key

# --- fixed values: beginnings of lines that are no rows, and limits of a figure in points and shares ------
FURNITURE = ("see accompanying notes", "see notes to", "the accompanying notes")
LEAST_SIDE, LEAST_AREA, LEAST_RASTER, MOST_COVERED = 40.0, 0.01, 0.05, 0.5


# --- stored indexes and traces ---------------------------------------------------------------------------


def save_vectors(vectors: DataFrame, path: str, by: str = "modality") -> None:
    """A vector store as Parquet, written anew and split by ``by``, so that a filter on it reads its part only."""
    vectors.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def save_index(path: str, **tables: DataFrame) -> None:
    """The tables of a lexical index (postings, lengths, weights) side by side under ``path``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """Tables of a saved index by name; a name that was not saved raises an error."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def append_records(records: DataFrame, path: str, by: str | None = None) -> None:
    """Appends traces, ledger lines or decisions; nested columns are kept as they are."""
    out = records.write.mode("append")
    (out.partitionBy(by) if by else out).parquet(path)


def find_record(records: DataFrame, request_id: str) -> DataFrame:
    """The latest trace of a request, or no row."""
    return records.where(F.col("request_id") == request_id).orderBy(F.col("ts").desc_nulls_last()).limit(1)


def node_latencies(traces: DataFrame) -> DataFrame:
    """``request_id, node, ms`` from a map column ``latency_ms_by_node``; null and empty maps give no row."""
    return traces.select("request_id", F.explode("latency_ms_by_node").alias("node", "ms"))


def decided_chunks(decisions: DataFrame) -> DataFrame:
    """One row a chunk of nested decisions, with all fields of the chunk."""
    return decisions.select("request_id", F.explode("chunks").alias("c")).select("request_id", "c.*")


# --- figures and pages -----------------------------------------------------------------------------------


def drop_kinds(rows: DataFrame, kind: str, dropped: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``kind`` is not among ``dropped`` (null stays), and how many were dropped by reason: ``reason, n``."""
    gone = F.coalesce(F.col(kind).isin(*dropped), F.lit(False))
    return rows.where(~gone), rows.where(gone).groupBy(F.col(kind).alias("reason")).agg(F.count("*").alias("n"))


def area(box: str) -> Column:
    """Area of a box (left, top, right, bottom); 0 for an empty, reversed or incomplete one."""
    side = lambda a, b: F.greatest(F.get(box, F.lit(b)) - F.get(box, F.lit(a)), F.lit(0.0))
    return F.coalesce(side(0, 2) * side(1, 3), F.lit(0.0))


def overlap(a: str, b: str) -> Column:
    """Area that two boxes share."""
    width = F.least(F.get(a, F.lit(2)), F.get(b, F.lit(2))) - F.greatest(F.get(a, F.lit(0)), F.get(b, F.lit(0)))
    height = F.least(F.get(a, F.lit(3)), F.get(b, F.lit(3))) - F.greatest(F.get(a, F.lit(1)), F.get(b, F.lit(1)))
    return F.coalesce(F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0)), F.lit(0.0))


def figure_candidates(boxes: DataFrame, occupied: DataFrame) -> DataFrame:
    """Boxes that may be figures, with ``covered``, the share of them that lies under occupied boxes of their page.

    ``boxes(page_key, box_id, bbox, raster, width, height)`` with the size of the page;
    ``occupied(page_key, bbox)`` are tables and known pictures.  A figure has both sides of
    40 points, a hundredth of the page (a raster a twentieth), and less than half covered.
    """
    page = F.col("width") * F.col("height")
    tall = F.least(F.get("bbox", F.lit(2)) - F.get("bbox", F.lit(0)), F.get("bbox", F.lit(3)) - F.get("bbox", F.lit(1))) >= LEAST_SIDE
    big = area("bbox") >= F.when(F.col("raster"), LEAST_RASTER).otherwise(LEAST_AREA) * page
    fit = boxes.where(tall & big)
    taken = occupied.select("page_key", F.col("bbox").alias("_o"))
    under = fit.join(taken, "page_key").groupBy("page_key", "box_id").agg(F.sum(overlap("bbox", "_o")).alias("_u"))
    both = fit.join(under, ["page_key", "box_id"], "left").withColumn("covered", F.least(F.coalesce(F.col("_u") / area("bbox"), F.lit(0.0)), F.lit(1.0)))
    return both.where(F.col("covered") < MOST_COVERED).drop("_u")


def without_furniture(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows whose label does not begin like a foot line of a page; null labels stay."""
    key = label_key(F.col(label))
    foot = F.lit(False)
    for start in FURNITURE:
        foot = foot | F.coalesce(key.startswith(start), F.lit(False))
    return rows.where(~foot)


def section_of_pages(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """``pages(page)`` with the section whose range ``first_page..last_page`` holds them; a page outside all raises ValueError.

    Of overlapping ranges the one that begins last counts.  Ranges are exploded to pages, so this is an equi-join.
    """
    each = sections.select("section", "first_page", F.explode(F.sequence("first_page", "last_page")).alias("page"))
    best = each.groupBy("page").agg(F.max_by("section", "first_page").alias("section"))
    out = pages.join(best, "page", "left")
    lost = out.where("section is null").select("page").limit(1).collect()
    if lost:
        raise ValueError(f"page {lost[0]['page']} lies in no section")
    return out


def label_of_pages(pages: DataFrame, blocks: DataFrame, default: str) -> DataFrame:
    """``pages(page)`` with the ``label`` of the first block on it by ``order_no``, or the default."""
    first = blocks.where("label is not null").groupBy("page").agg(F.min_by("label", "order_no").alias("label"))
    return pages.join(first, "page", "left").withColumn("label", F.coalesce("label", F.lit(default)))


# --- facts, questions and budgets ------------------------------------------------------------------------


def fact_documents(rows: DataFrame, phrase: str = "for the fiscal year ended") -> DataFrame:
    """Chunks of statement rows as text: ``chunk_id, document, line_item_norm`` and the values, ids unique on a page.

    ``rows(page, row_no, breadcrumb, title, label, group, unit, cells)``; ``cells`` is an array of
    (value, period_end, fiscal_year), and a nil value prints as "nil".
    """
    printed = F.transform("cells", lambda c: F.concat(F.coalesce(F.format_number(c["value"], 0), F.lit("nil")), F.lit(f" {phrase} "), F.coalesce(c["period_end"], F.lit("?")), F.lit(" (FY"), c["fiscal_year"].cast("string"), F.lit(")")))
    note = F.when(F.col("group").isin("body", "other") | F.col("group").isNull(), "").otherwise(F.concat(F.lit(" ["), F.replace("group", F.lit("_"), F.lit(" ")), F.lit("]")))
    text = F.concat(F.lit("["), F.coalesce("breadcrumb", F.lit("")), F.lit("]\n"), F.coalesce("title", F.lit("")), F.lit(" — "), F.coalesce("label", F.lit("")), note, F.lit(": "), F.array_join(printed, "; "), F.lit("."))
    norm = label_key(F.coalesce("label", F.lit("")))
    slug = F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(norm, "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("row"))
    k = F.row_number().over(Window.partitionBy("page", "_slug").orderBy("row_no"))
    named = rows.withColumn("_slug", slug).withColumn("_k", k)
    ident = F.concat(F.lit("rowfact_p"), F.col("page").cast("string"), F.lit("_"), "_slug", F.when(F.col("_k") > 1, F.concat(F.lit("_"), F.col("_k").cast("string"))).otherwise(""))
    return named.select(ident.alias("chunk_id"), "page", text.alias("document"), norm.alias("line_item_norm"), "group", "unit", "cells")


def statement_of(facts: DataFrame) -> DataFrame:
    """``item, statement``: the first statement, in the order of ``position``, that has the item, and whether others have it too."""
    by = facts.where("item is not null").groupBy("item", "statement").agg(F.min("position").alias("p"))
    return by.groupBy("item").agg(F.min_by("statement", "p").alias("statement"), (F.count("*") > 1).alias("ambiguous"))


def has_figure(text: Column) -> Column:
    """Whether a text states a number; digits glued to letters are names, and null is none."""
    return F.coalesce(text.rlike(r"(?<![A-Za-z0-9])\d"), F.lit(False))


def is_multi_part(question: Column, asked: Column) -> Column:
    """Whether a question asks for several things: two slots, two question marks, or a joining word; null asks for one."""
    marks = F.length(question) - F.length(F.replace(question, F.lit("?"), F.lit("")))
    return F.coalesce((asked >= 2) | (marks >= 2) | F.lower(question).rlike(r"\b(?:and also|as well as|along with|in addition)\b"), F.lit(False))


def even_groups(items: DataFrame, key: str, order: str, room: int) -> DataFrame:
    """Adds ``part``: the items of each key in ``room`` groups of even size (the last may be smaller)."""
    if room < 1:
        raise ValueError("no room")
    within = Window.partitionBy(key)
    size = F.ceil(F.count("*").over(within) / room)
    return items.withColumn("part", F.floor((F.row_number().over(within.orderBy(order)) - 1) / size).cast("int"))


def shed(items: DataFrame, key: str, order: str, text_tokens: str, cost: int, cap: int) -> DataFrame:
    """Items of each key kept from the front while text and ``cost`` an item stay within ``cap``; the first always stays."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return items.withColumn("_n", n).where((F.col("_n") == 1) | (F.col(text_tokens) + F.col("_n") * cost <= cap)).drop("_n")


def gate(rates: DataFrame, base: str, points: float = 3.0) -> DataFrame:
    """``arm, gain, passed``: whether an arm's ``rate`` (in per cent) is ``points`` above that of ``base``."""
    own = rates.where(F.col("arm") == base).select(F.col("rate").alias("_b"))
    gain = F.col("rate") - F.col("_b")
    return rates.where(F.col("arm") != base).crossJoin(F.broadcast(own.limit(1))).select("arm", gain.alias("gain"), (gain >= points).alias("passed"))


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """JSON of named columns with sorted keys, so that equal contents hash alike; nulls are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def follow_up_ok(want: Column, got: Column, carried: Column) -> Column:
    """Whether a rewritten follow-up has every slot that was wanted and none beyond those wanted or carried over."""
    empty = F.array().cast("array<string>")
    want, got, carried = F.coalesce(want, empty), F.coalesce(got, empty), F.coalesce(carried, empty)
    return (F.size(F.array_except(want, got)) == 0) & (F.size(F.array_except(got, F.array_union(want, carried))) == 0)
