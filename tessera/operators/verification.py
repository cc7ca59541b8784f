"""Checks of an answer against its context: numbers, citations and the parts of the question.

All checks are column expressions over arrays of one row, so they are maps without any
shuffle once an answer stands beside its context.

Defined cases: a null answer or context counts as empty text; a token that is no number
(a lone sign) is supported; without numbers and citations an answer passes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: forms of numbers and citations, scales that an answer may restate a value in -----------
NUMBER = r"(?<![\w.])-?\$?\d(?:[\d,]*\d)?(?:\.\d+)?%?(?![\w])"
CITATION = r"\[([CK]\d+)\]"
SCALES = (1.0, 1000.0, 0.001)
PERCENT_SCALE = 100.0
YEARS = (1990, 2100)
SMALL = 31


def numbers(text: Column) -> Column:
    """Number tokens of a text in order; citations are left out and Unicode blanks count as blanks."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[    ]", " "), CITATION, " ")
    return F.regexp_extract_all(plain, F.lit(f"({NUMBER})"), F.lit(1))


def value_of(token: Column) -> Column:
    """The number of a token, or null."""
    return F.regexp_replace(token, "[$,%]", "").try_cast("double")


def decimals_of(token: Column) -> Column:
    return F.length(F.regexp_extract(token, r"\.(\d+)", 1))


def _whole(x: Column) -> Column:
    return x == F.floor(x)


def waved_through(token: Column) -> Column:
    """Years and small whole numbers, which any context supports and which prove nothing."""
    x, amount = value_of(token), F.contains(token, F.lit("$"))
    year = _whole(x) & x.between(*YEARS) & ~amount
    small = _whole(x) & (F.abs(x) <= SMALL) & ~amount & ~F.contains(token, F.lit(","))
    return F.coalesce(year | small, F.lit(True))


def _matches(token: Column, allowed: Column) -> Column:
    x, places = value_of(token), decimals_of(token)
    step = F.pow(F.lit(10.0), -places.cast("double"))
    tolerance = 0.5 * step + 1e-9

    def near(a: Column, scale: Column) -> Column:
        c = a * scale
        rounded = F.rint(c / step) * step  # as the answer may round
        return (F.abs(F.abs(c) - F.abs(x)) <= tolerance) | (F.abs(rounded - x) <= tolerance)

    tried = [F.exists(allowed, _with(near, s)) for s in SCALES]
    any_scale = tried[0] | tried[1] | tried[2]
    return F.coalesce(any_scale | (F.contains(token, F.lit("%")) & F.exists(allowed, _with(near, PERCENT_SCALE))), F.lit(False))


def _with(near: Callable[[Column, Column], Column], scale: float) -> Callable[[Column], Column]:
    return lambda a: near(a, F.lit(scale))


def unsupported(tokens: Column, allowed: Column) -> Column:
    """The different tokens that no value of ``allowed`` supports at any scale, in order."""
    return F.array_distinct(F.filter(tokens, lambda t: ~(waved_through(t) | _matches(t, allowed))))


def values(*texts: Column) -> Column:
    """All numbers of the texts as values."""
    tokens = F.flatten(F.array(*[numbers(t) for t in texts]))
    return F.array_distinct(F.filter(F.transform(tokens, value_of), lambda x: x.isNotNull()))


def verify(answers: DataFrame, answer: str, question: str, context: str, blocks: str, extra: Column | None = None) -> DataFrame:
    """Adds ``numbers_checked, unmatched, cited, invalid, issues, passed``.

    ``context`` is the text of the blocks, ``blocks`` the array of their ids (C1, K1, ...), and
    ``extra`` an array of values that calculations gave.
    """
    allowed = values(F.col(context), F.col(question))
    if extra is not None:
        allowed = F.array_union(allowed, F.coalesce(extra, F.array().cast("array<double>")))
    out = answers.withColumn("_tokens", numbers(F.col(answer))).withColumn("_allowed", allowed)
    cited = F.array_distinct(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(CITATION), F.lit(1)))
    out = out.withColumn("unmatched", unsupported(F.col("_tokens"), F.col("_allowed"))).withColumn("cited", cited)
    out = out.withColumn("invalid", F.array_except("cited", F.coalesce(blocks, F.array().cast("array<string>"))))
    # Whole numbers that any context supports need no citation.
    bare = F.exists("_tokens", lambda t: ~waved_through(t)) & (F.size("cited") == 0)
    issues = F.array_compact(F.array(F.when(F.size("unmatched") > 0, "numbers"), F.when(F.size("invalid") > 0, "citations"), F.when(bare, "uncited")))
    out = out.withColumn("issues", issues).withColumn("numbers_checked", F.size("_tokens")).withColumn("passed", F.size("issues") == 0)
    return out.drop("_tokens", "_allowed")


def answered(answer: Column, expected: Column) -> Column:
    """Whether the answer gives one of the values of a part of the question; what any context supports proves nothing."""
    plain = F.contains
    telling = F.filter(numbers(answer), lambda t: plain(t, F.lit("%")) | plain(t, F.lit("$")) | ~waved_through(t))
    return F.exists(telling, lambda t: _matches(t, expected))
