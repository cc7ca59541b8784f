"""Text functions as column expressions, all of them inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the token grammar ---------------------------------------------------------------------
#: A number with its sign of currency and percent, or a word with inner hyphens and apostrophes.
TOKEN = r"\$?[0-9][0-9,]*(?:\.[0-9]+)?%?|[a-z0-9]+(?:[-'][a-z0-9]+)*"
NUMBER = r"^\$?[0-9][0-9,]*(\.[0-9]+)?%?$"


def raw_tokens(text: Column) -> Column:
    """Numbers and words of a text in lower case, as they stand."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def token_forms(token: Column) -> Column:
    """All forms under which one raw token is indexed."""
    plain = F.regexp_replace(token, ",", "")
    number = F.when(plain.startswith("$"), F.array(plain, F.substring(plain, 2, 1 << 20))).otherwise(F.array(plain))
    parts = F.filter(F.split(token, "[-']"), lambda p: p != "")
    word = F.when(token.rlike("[-']"), F.concat(F.array(token), parts)).otherwise(F.array(token))
    return F.when(token.rlike(NUMBER), number).otherwise(word)


def finance_tokens(text: Column) -> Column:
    """Tokens of a text: numbers without thousands marks, "$5" also as "5", hyphenated words whole and in parts.

    Null gives null, a text without tokens an empty array.
    """
    return F.flatten(F.transform(raw_tokens(text), token_forms))


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def normalise_label(label: Column) -> Column:
    """A row label in lower case without footnote marks and punctuation."""
    text = F.regexp_replace(F.lower(label), r"\([0-9a-z]\)", " ")
    return collapse(F.regexp_replace(text, r"[^a-z0-9&%$ -]+", " "))


def parse_amount(text: Column) -> Column:
    """(status, value) of a printed amount: nil for a dash, number, or text.

    Parentheses make negative; currency signs, thousands marks, blanks and a footnote
    letter are dropped.
    """
    bare = F.trim(text)
    dash = bare.rlike("^[-–—]+$")
    inner = F.regexp_replace(F.regexp_replace(bare, r"[$, ]", ""), r"\([a-z]\)$", "")
    negative = inner.rlike(r"^\([0-9.]+\)%?$")
    digits = F.regexp_replace(inner, r"[()%]", "")
    number = F.when(digits.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), digits.try_cast("double"))
    value = F.when(dash, F.lit(None)).when(negative, -number).otherwise(number)
    return F.struct(F.when(dash, "nil").when(number.isNotNull(), "number").otherwise("text").alias("status"), value.alias("value"))


#: Shapes of provider keys and mail addresses that must not reach a log.
SECRET_SHAPES = (r"sk-[A-Za-z0-9_-]{8,}", r"gsk_[A-Za-z0-9]{8,}", r"AIza[A-Za-z0-9_-]{10,}", r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}")


def redact(text: Column, known: tuple[str, ...] = ()) -> Column:
    """Text with known secrets, longest first, and anything of a secret's shape replaced."""
    for value in sorted(known, key=len, reverse=True):
        text = F.replace(text, F.lit(value), F.lit("[redacted]"))
    for shape in SECRET_SHAPES:
        text = F.regexp_replace(text, shape, "[redacted]")
    return text


def slug(text: Column) -> Column:
    """Lower-case letters and digits joined by underscores, "row" if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(out == "", "row").otherwise(F.substring(out, 1, 48))


def token_estimate(text: Column) -> Column:
    """Tokens of a text by the rule of four characters."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")
