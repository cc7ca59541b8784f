"""Shortening of context: rows of a table, sentences of a text, with a guard that no number is invented.

Everything is a column expression over the lines or sentences of one row.

Defined cases: null bodies stay null; a body without a table, or a table without a fitting
row, is kept whole; a text without sentences gives no indexes; nothing is ever shortened to
a text with a number that the body does not have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .statements import label_key
from .verification import numbers

_TOTAL = r"(^| )total"

#: Stands where sentences were left out.
ELLIPSIS = "[…]"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row; named inside a lambda it would be computed again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _table(body: Column) -> tuple[Column, Column, Column, Column]:
    """Lines of a body, the place of the first one of its table, the rows after heading and rule, and whether there is a table."""
    lines = F.split(body, "\n")
    first = F.array_position(F.transform(lines, lambda x: F.ltrim(x).startswith("|")), True).cast("int")
    n = F.size(lines)
    return lines, first, F.slice(lines, first + 2, F.greatest(n - first - 1, F.lit(0))), (first > 0) & (n - first + 1 >= 3)


def _cells(row: Column) -> Column:
    return F.split(F.regexp_replace(F.trim(row), r"^\|+|\|+$", ""), r"\|")


def _label(cells: Column) -> Column:
    return label_key(F.trim(F.get(cells, F.lit(0))))


def _always(cells: Column, label: Column) -> Column:
    """Rows that stay whatever is asked: those without figures, and totals."""
    figures = F.exists(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda c: c.rlike(r"\d"))
    return ~figures | label.rlike(_TOTAL)


def wanted_labels(labels: Column) -> Column:
    return F.transform(F.coalesce(labels, F.array().cast("array<string>")), label_key)


def row_select(body: Column, labels: Column) -> Column:
    """(text, kept, rows) of a printed table cut to the rows whose label is in ``labels``, rows without figures and totals.

    What stands above the table, its heading and rule stay.
    """
    lines, first, rows, table = _table(body)
    kept = bound(wanted_labels(labels), lambda wanted: F.filter(rows, lambda row: F.array_contains(wanted, _label(_cells(row))) | _always(_cells(row), _label(_cells(row)))))
    text = F.array_join(F.concat(F.slice(lines, 1, first + 1), kept), "\n")
    whole = F.struct(body.alias("text"), F.lit(0).alias("kept"), F.when(table, F.size(rows)).otherwise(0).alias("rows"))
    short = F.struct(text.alias("text"), F.size(kept).alias("kept"), F.size(rows).alias("rows"))
    return F.when(table & (F.size(kept) > 0), short).otherwise(whole)


def select_sentences(scores: Column, least: float, neighbours: int = 1) -> Column:
    """Indexes from 0 of the sentences that score ``least`` and their neighbours; of the two best if none does."""
    indexes = F.when(F.size(scores) > 0, F.sequence(F.lit(0), F.size(scores) - 1)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(indexes, lambda i: F.get(scores, i) >= least)
    ranked = F.array_sort(F.transform(indexes, lambda i: F.struct((-F.get(scores, i)).alias("s"), i.alias("i"))))
    chosen = F.when(F.size(hits) > 0, hits).otherwise(F.transform(F.slice(ranked, 1, 2), lambda x: x["i"]))
    return bound(chosen, lambda c: F.filter(indexes, lambda i: F.exists(c, lambda j: F.abs(i - j) <= neighbours)))


def join_sentences(sentences: Column, indexes: Column) -> Column:
    """The chosen sentences in order, with a mark where others were left out between them."""
    pieces = F.transform(indexes, lambda i, k: F.concat(F.when((k > 0) & (i != F.get(indexes, k - 1) + 1), F.lit(ELLIPSIS + " ")).otherwise(""), F.get(sentences, i)))
    return F.array_join(pieces, " ")


def _plain(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.regexp_replace(t, "[$,]", ""))


def invented(short: Column, body: Column) -> Column:
    """The numbers of ``short`` that ``body`` does not have; thousands marks and currency signs aside."""
    return F.array_except(_plain(numbers(short)), _plain(numbers(body)))


def guarded(short: Column, body: Column) -> Column:
    """(text, reverted): ``short``, or ``body`` where a number was invented or nothing was left."""
    bad = (F.size(invented(short, body)) > 0) | (F.trim(short) == "")
    return F.struct(F.when(bad, body).otherwise(short).alias("text"), bad.alias("reverted"))


# --- the same without the texts: what a body holds is counted once, and questions choose among its parts --------
# Blanks and line ends stand between parts, and no number or citation reaches over one, so a text has the numbers of its parts.


def _figures(parts: Column, own: Column, extra: Callable[[Column], list[Column]]) -> Column:
    """Of each part how many numbers it has and how many different ones its body (``own``) does not have, beside what is ``extra``."""
    each = F.transform(parts, lambda x: F.struct(x.alias("part"), _plain(numbers(x)).alias("figures")))

    def counted(e: Column) -> Column:
        same = F.flatten(F.transform(e, lambda x: x["figures"])) == own  # then none is strange, and none need be looked up
        strange = lambda x, s: F.when(s, F.lit(0)).otherwise(F.size(F.array_except(x["figures"], own)))
        return bound(same, lambda s: F.transform(e, lambda x: F.struct(*extra(x["part"]), F.size(x["figures"]).alias("numbers"), strange(x, s).alias("strange"))))

    return bound(each, counted)


def table_figures(body: Column) -> Column:
    """(table, total, parts) of a body: whether it has a table, its numbers, and of what stands above the rows and then of each row (label, always, numbers, strange)."""
    lines, first, rows, table = _table(body)
    parts = F.concat(F.array(F.array_join(F.slice(lines, 1, first + 1), "\n")), rows)
    extra = lambda x: [bound(_cells(x), lambda c: bound(_label(c), lambda k: F.struct(k.alias("label"), _always(c, k).alias("always")))).alias("row")]
    return bound(_plain(numbers(body)), lambda own: F.struct(table.alias("table"), F.size(own).alias("total"), F.when(table, _figures(parts, own, extra)).alias("parts")))


def sentence_figures(sentences: Column, body: Column, words: Callable[[Column], Column]) -> Column:
    """(total, parts) of a text: its numbers, and of each sentence (words, numbers, strange)."""
    return bound(_plain(numbers(body)), lambda own: F.struct(F.size(own).alias("total"), _figures(sentences, own, lambda x: [words(x).alias("words")]).alias("parts")))


def _checked(total: Column, chosen: Column, bad: Column) -> Column:
    held = F.aggregate(chosen, F.lit(0), lambda a, x: a + x["numbers"])
    strange = F.aggregate(chosen, F.lit(0), lambda a, x: a + x["strange"])
    reverted = bad | (strange > 0)
    return F.struct(F.when(reverted, total).otherwise(held).alias("numbers"), (reverted | (strange == 0)).alias("faithful"))


def table_fidelity(figures: Column, wanted: Column) -> Column:
    """(numbers, faithful) of what ``row_select`` and ``guarded`` make of a body, by its ``table_figures`` and the ``wanted_labels``."""
    kept = F.filter(figures["parts"], lambda x, i: (i == 0) | F.array_contains(wanted, x["row"]["label"]) | x["row"]["always"])
    whole = F.struct(figures["total"].alias("numbers"), F.lit(True).alias("faithful"))
    return bound(kept, lambda k: F.when(figures["table"] & (F.size(k) > 1), _checked(figures["total"], k, F.lit(False))).otherwise(whole))


def _bare(x: Column) -> Column:
    return F.struct(x["numbers"].alias("numbers"), x["strange"].alias("strange"))


def sentence_fidelity(figures: Column, asked: Column, least: float) -> Column:
    """(numbers, faithful) of what ``select_sentences``, ``join_sentences`` and ``guarded`` make of a text, by its ``sentence_figures`` and the words of the question."""
    parts = figures["parts"]
    scores = F.transform(parts, lambda x: F.size(F.array_intersect(x["words"], asked)) / F.greatest(F.size(asked), F.lit(1)))
    chosen = bound(scores, lambda c: F.transform(select_sentences(c, least), lambda i: _bare(F.get(parts, i))))
    return bound(chosen, lambda c: _checked(figures["total"], c, F.size(c) == 0))
