"""Checks of printed statements: wrapped labels, groups, subtotals, the balance identity, and cells of two readings.

A statement is rows of ``table_id, row_no, label, values``; ``values`` is an array of
amounts in which nil is null, and a row without values is a header.  Windows run inside
one table, which is one printed page.

Defined cases: null labels count as empty and rows with neither label nor values are
left out; a null or missing ``values`` is a row without values; an identity whose rows
are not both there has the status ``missing``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse

#: Points by which left edges may differ and still be one indent.
INDENT = 2.0

# --- fixed values: the totals of a balance sheet and the group each closes ------------------------------
TOTALS = {
    "total current assets": "current_assets",
    "total assets": "assets",
    "total current liabilities": "current_liabilities",
    "total liabilities": "liabilities",
    "total shareholders' equity": "equity",
    "total stockholders' equity": "equity",
    "total liabilities and shareholders' equity": "liabilities_and_equity",
    "total liabilities and stockholders' equity": "liabilities_and_equity",
}
#: The group that begins below a total.
AFTER_TOTAL = {
    "current_assets": "non_current_assets",
    "assets": "liabilities_header",
    "current_liabilities": "non_current_liabilities",
    "liabilities": "commitments",
    "equity": "equity",
    "liabilities_and_equity": "done",
}


def label_key(label: Column) -> Column:
    """A row label in lower case without footnote marks and punctuation; apostrophes stay, as the totals have them."""
    text = F.regexp_replace(F.replace(F.lower(label), F.lit("’"), F.lit("'")), r"\([0-9a-z]\)", " ")
    return collapse(F.regexp_replace(text, r"[^a-z0-9&%$' -]+", " "))


def _clean(rows: DataFrame) -> DataFrame:
    values = F.coalesce("values", F.array().cast("array<double>"))
    rows = rows.withColumn("label", F.trim(F.coalesce("label", F.lit("")))).withColumn("values", values)
    return rows.where((F.col("label") != "") | (F.size("values") > 0))


def _lookup(value: Column, pairs: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, v in pairs.items():
        out = out.when(value == k, v)
    return out


def join_wrapped(rows: DataFrame) -> DataFrame:
    """``rows(table_id, row_no, label, values, x0)`` with labels that wrapped onto several lines in one row.

    A line without values whose next line has the same left edge (or an unknown one) is a
    piece of what follows; before a line that ends in a colon only if the last piece breaks
    off inside a sentence, else the pieces are headers of their own.
    """
    order = Window.partitionBy("table_id").orderBy("row_no")
    near = F.coalesce(F.abs(F.col("x0") - F.lead("x0").over(order)) <= INDENT, F.lit(True))
    piece = (F.size("values") == 0) & ~F.col("label").endswith(":") & F.lead("row_no").over(order).isNotNull() & near
    marked = _clean(rows).withColumn("_piece", piece)
    ends = F.coalesce(F.sum((~F.col("_piece")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    islands = marked.withColumn("_island", ends).groupBy("table_id", "_island").agg(F.array_sort(F.collect_list(F.struct("row_no", "label", "values", "_piece"))).alias("r"))
    size = F.size("r")
    last, before = F.get("r", size - 1), F.get("r", size - 2)["label"]
    inside = before.rlike(r"[,;–—/-]$|(^|\s)\p{Ll}\p{L}*$")
    apart = last["label"].endswith(":") & (F.size(last["values"]) == 0) & (size > 1) & ~inside
    whole = F.array(F.struct(last["row_no"].alias("row_no"), F.array_join(F.transform("r", lambda x: x["label"]), " ").alias("label"), last["values"].alias("values")))
    each = F.transform("r", lambda x: F.struct(x["row_no"].alias("row_no"), x["label"].alias("label"), x["values"].alias("values")))
    return islands.select("table_id", F.explode(F.when(apart, each).otherwise(whole)).alias("x")).select("table_id", "x.*")


def balance_groups(rows: DataFrame) -> DataFrame:
    """Adds ``label_norm`` and ``group`` to the rows of balance sheets.

    Headers and totals change the running group; every other row has the last one set above it.
    """
    norm = F.col("label_norm")
    header = F.size("values") == 0
    kind = _lookup(norm, TOTALS)
    by_header = (
        F.when(norm.startswith("current assets"), "current_assets").when(norm.startswith("current liabilities"), "current_liabilities")
        .when(norm.contains("equity") & ~norm.contains("liabilities"), "equity").when(norm == "assets", "assets_header").when(norm.contains("liabilities"), "liabilities_header")
    )
    set_here = F.when(header, by_header).otherwise(_lookup(kind, AFTER_TOTAL))
    above = Window.partitionBy("table_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    seen = _clean(rows).withColumn("label_norm", label_key(F.col("label"))).withColumn("_set", set_here).withColumn("_above", F.coalesce(F.last("_set", ignorenulls=True).over(above), F.lit("header")))
    outside = F.col("_above").isin("assets_header", "liabilities_header", "commitments", "header")
    group = F.when(header, "header").when(F.col("_above") == "done", "footer").when(kind.isNotNull(), kind).when(outside, "other").otherwise(F.col("_above"))
    return seen.withColumn("group", group).drop("_set", "_above")


def check_identity(rows: DataFrame, left: str = "total assets", right: str = "total liabilities and shareholders' equity") -> DataFrame:
    """``table_id, left, right, status`` (holds, fails, missing) from the first row of each label; amounts must be equal and not nil."""
    found = rows.where(F.size("values") > 0).groupBy("table_id").agg(
        F.min_by(F.when(F.col("label_norm") == left, F.col("values")), F.when(F.col("label_norm") == left, F.col("row_no"))).alias("left"),
        F.min_by(F.when(F.col("label_norm") == right, F.col("values")), F.when(F.col("label_norm") == right, F.col("row_no"))).alias("right"),
    )
    tables = rows.select("table_id").distinct().join(found.hint("merge"), "table_id", "left")
    same = (F.size("left") == F.size("right")) & F.forall(F.arrays_zip("left", "right"), lambda p: F.coalesce(p["left"] == p["right"], F.lit(False)))
    status = F.when(F.col("left").isNull() | F.col("right").isNull(), "missing").when(same, "holds").otherwise("fails")
    return tables.select("table_id", "left", "right", status.alias("status"))


def require_identity(rows: DataFrame) -> DataFrame:
    """``rows``, after the identity of every table was found to hold; otherwise raises ValueError naming one that does not."""
    bad = check_identity(rows).where("status <> 'holds'").limit(1).collect()
    if bad:
        raise ValueError(f"the identity of {bad[0]['table_id']} {'fails' if bad[0]['status'] == 'fails' else 'lacks a row'}: {bad[0]['left']} against {bad[0]['right']}")
    return rows


def check_subtotals(rows: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """``table_id, row_no, group, stated, computed, holds`` for each total row whose group has other rows.

    Nil counts as 0 in a sum; a nil total never holds.  A group's sums are partial before their shuffle.
    """
    total = F.col("label_norm").startswith("total ")
    cells = rows.where(~total & (F.size("values") > 0)).select("table_id", "group", F.posexplode("values").alias("col", "v"))
    sums = cells.groupBy("table_id", "group", "col").agg(F.sum(F.coalesce("v", F.lit(0.0))).alias("s"))
    sums = sums.groupBy("table_id", "group").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "s"))), lambda x: x["s"]).alias("computed"))
    stated = rows.where(total & (F.size("values") > 0)).select("table_id", "row_no", "group", F.col("values").alias("stated"))
    both = stated.join(sums.hint("merge"), ["table_id", "group"])
    holds = F.forall(F.arrays_zip("stated", "computed"), lambda p: F.coalesce(F.abs(p["stated"] - p["computed"]) < tolerance, F.lit(False)))
    return both.select("table_id", "row_no", "group", "stated", "computed", holds.alias("holds"))


def compare_cells(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of one reading of a table with the same row of another: ``agree`` (null where it has none) and ``differing`` columns.

    Both have ``table_id, row_no, label_norm, values``.  The k-th row of a label meets the
    k-th of the same label, so repeated labels pair with their twins; the shorter of two
    rows is filled up with nil, and two nils agree.
    """

    def numbered(df: DataFrame, name: str) -> DataFrame:
        k = F.row_number().over(Window.partitionBy("table_id", "label_norm").orderBy("row_no"))
        return df.where(F.size("values") > 0).select("table_id", "label_norm", "row_no", k.alias("_k"), F.col("values").alias(name))

    both = numbered(rows, "mine").join(numbered(other, "theirs").drop("row_no").hint("merge"), ["table_id", "label_norm", "_k"], "left")
    columns = F.sequence(F.lit(0), F.greatest(F.size("mine"), F.size("theirs")) - 1)
    differing = F.filter(columns, lambda i: ~F.get("mine", i).eqNullSafe(F.get("theirs", i)))
    found = F.when(F.col("theirs").isNotNull(), differing)
    return both.select("table_id", "row_no", "label_norm", "mine", "theirs", (F.size(found) == 0).alias("agree"), found.alias("differing")).withColumn("agree", F.when(F.col("theirs").isNotNull(), F.col("agree")))
