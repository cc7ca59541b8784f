"""Splitting oversized items at natural boundaries (problem 2).

Content-defined chunking: a rolling hash over a short window of characters
marks landmarks; each cut snaps from the landmark of its region to the nearest
natural boundary of the best kind that the region has.  Landmarks depend on the
characters around them only, so an edit moves the cuts next to it and leaves
the others in place.

Defined cases: null, empty and short items are not oversized and give no row;
repeated rows give their item once; a text without any boundary is cut at its
landmarks; a table row over the limit is cut like text.  A piece is shorter than
``min_share`` of the limit only where no boundary lies between that and the limit,
or at the end of the item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentences import sentence_ends

CHARS_PER_TOKEN = 4
KINDS = ("paragraph", "line", "sentence", "word")

_BLANK = re.compile(r"(?:\r\n|\n|\r)[^\S\r\n]*(?:\r\n|\n|\r)\s*")
_BREAK = re.compile(r"\r\n|\n|\r")
_SPACE = re.compile(r"\s+")
_RULE_ROW = re.compile(r"\|[\s:|-]+\|\s*$")


@dataclass(frozen=True)
class SplitSpec:
    """Limits in size tokens (ceil of characters / 4)."""

    text_limit: int = 450
    table_limit: int = 1500
    overlap: int = 40
    min_share: float = 0.5
    window: int = 16


def size_tokens(text: F.Column) -> F.Column:
    return F.ceil(F.length(text) / CHARS_PER_TOKEN)


def _stretches_fit(text: str, cuts: list[int], limit: int) -> bool:
    """Whether every stretch between neighbouring cuts is within ``limit`` without its white space."""
    a = 0
    for b in [*cuts, len(text)]:
        if b - a > limit and len(text[a:b].strip()) > limit:
            return False
        a = b
    return True


def boundaries(text: str, limit: int) -> tuple[str, list[tuple[int, int]]]:
    """The first kind under which no stretch is over ``limit`` characters, and the cuts up to it.

    Cuts are (position, kind number), sorted, the position being where the next stretch begins.
    """
    known: dict[int, int] = {}
    for kind, name in enumerate(KINDS):
        if name == "paragraph":
            found = [m.end() for m in _BLANK.finditer(text)]
        elif name == "line":
            found = [m.end() for m in _BREAK.finditer(text)]
        elif name == "sentence":
            found = sentence_ends(text)
        else:
            found = [m.end() for m in _SPACE.finditer(text)]
        for p in found:
            if 0 < p < len(text):
                known.setdefault(p, kind)
        if _stretches_fit(text, sorted(known), limit):
            return name, sorted(known.items())
    return "none", sorted(known.items())


def _landmarks(text: str, window: int) -> np.ndarray:
    """Hash of the ``window`` characters before each position, mixed so that maxima are spread evenly."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    h = np.zeros(len(codes) + 1, dtype=np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(min(window, len(codes))):
            h[k + 1 :] += codes[: len(codes) - k] * power
            power = power * factor
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def _pieces(text: str, cuts: list[tuple[int, int]], limit: int, overlap: int, spec: SplitSpec) -> list[tuple[int, int, int]]:
    """Pieces as (start with overlap, start of the new part, end), each of at most ``limit`` characters."""
    marks = _landmarks(text, spec.window)
    positions = np.array([p for p, _ in cuts], dtype=np.int64)
    kinds = np.array([k for _, k in cuts], dtype=np.int64)
    pieces, start, fresh = [], 0, 0
    while len(text) - start > limit:
        far = start + limit
        near = max(fresh + 1, min(far, start + int(limit * spec.min_share)))
        i, j = np.searchsorted(positions, near), np.searchsorted(positions, far, side="right")
        landmark = near + int(np.argmax(marks[near : far + 1]))
        if i == j:  # none in the usual region: the last before it, so that the piece is as long as a boundary allows
            i = max(np.searchsorted(positions, fresh + 1), j - 1)
        if i < j:
            best = kinds[i:j].min()
            here = positions[i:j][kinds[i:j] == best]
            cut = int(here[np.argmin(np.abs(here - landmark))])
        else:
            cut = landmark
        pieces.append((start, fresh, cut))
        fresh = cut
        start = cut
        if overlap:
            a, b = np.searchsorted(positions, max(pieces[-1][0] + 1, cut - overlap)), np.searchsorted(positions, cut)
            if a < b:
                best = kinds[a:b].min()
                start = int(positions[a:b][kinds[a:b] == best][0])
            elif not len(positions):
                start = max(pieces[-1][0] + 1, cut - overlap)
    pieces.append((start, fresh, len(text)))
    return pieces


def split_item(text: str, is_table: bool, spec: SplitSpec = SplitSpec()) -> tuple[str, list[tuple[str, int, int, int]]]:
    """Boundary kind of one oversized item, and its pieces as (text, start, end, shared characters)."""
    limit = (spec.table_limit if is_table else spec.text_limit) * CHARS_PER_TOKEN
    kind, cuts = boundaries(text, limit)
    if not is_table:
        return kind, [(text[a:b], a, b, f - a) for a, f, b in _pieces(text, cuts, limit, spec.overlap * CHARS_PER_TOKEN, spec)]
    head = 0
    for m in _BREAK.finditer(text):
        line = text[head : m.start()]
        if head and not line.lstrip().startswith("|"):
            break
        head = m.end()
        if _RULE_ROW.match(line.strip()):
            break
    else:
        head = 0
    if head > limit // 2:
        head = 0
    header, body = text[:head], text[head:]
    inner = [(p - head, k) for p, k in cuts if p > head]
    if any(k > 1 for _, k in inner):  # row ends go before the cuts inside a row
        inner.sort()
    return kind, [(header + body[a:b], head + a, head + b, len(header)) for a, _, b in _pieces(body, inner, limit - head, 0, spec)]


def split_oversized(items: DataFrame, spec: SplitSpec = SplitSpec()) -> DataFrame:
    """Pieces of every oversized item of ``items(item_table, item_id, is_table, text)``.

    One row per item: ``boundary`` and ``pieces``, an array of (piece_no, start_char,
    end_char, shared_chars, text).  Items within the limit are filtered in the JVM, by
    their real length, and never reach Python; nothing is shuffled.
    """
    limit = F.when(F.col("is_table"), spec.table_limit).otherwise(spec.text_limit) * CHARS_PER_TOKEN
    over = items.select("item_table", "item_id", "is_table", "text").where(F.length("text") > limit)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kinds, all_pieces = [], []
            for text, is_table in zip(pdf["text"], pdf["is_table"]):
                kind, pieces = split_item(text, bool(is_table), spec)
                kinds.append(kind)
                all_pieces.append([{"piece_no": n, "start_char": a, "end_char": b, "shared_chars": s, "text": t} for n, (t, a, b, s) in enumerate(pieces)])
            yield pd.DataFrame({"item_table": pdf["item_table"], "item_id": pdf["item_id"], "boundary": kinds, "pieces": all_pieces})

    return over.mapInPandas(
        work,
        "item_table string, item_id string, boundary string, "
        "pieces array<struct<piece_no:int,start_char:long,end_char:long,shared_chars:int,text:string>>",
    )
