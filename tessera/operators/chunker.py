"""Passages of prose blocks, cut where neighbouring sentences differ most.

A block is cut where the distance of two neighbouring sentences is over a threshold of
the whole corpus; small pieces join the neighbour that is nearer, oversized ones are cut
at their greatest inner distance, and a block that is small as a whole joins the next
block of its subsection, else the passage before it.

Sentences, their sizes and distances are made where the block is read; only numbers
travel on.  The last step reads rows sorted inside partitions and holds one open passage
at a time, so no subsection is gathered, however large.

Defined cases: null and blank texts have no sentences and no passage; a sentence over the
limit is a passage of its own; ties of size go to the first piece, ties of distance to the
left; sentences without words are at distance 1 from any other.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Piece = tuple[int, int]
#: Size tokens of a passage.
LEAST, MOST = 120, 450
#: Share of all neighbour distances that lie under the threshold.
PERCENTILE = 0.95
DIMENSIONS = 256

_SENTENCE = re.compile(r"[^.!?。！？…।؟\n]+(?:[.!?…।؟]+(?=\s|$)|[。！？]+|\n+|[.!?…।؟]|$)|[.!?。！？…।؟]+")
_WORD = re.compile(r"\w+")


def split_at(distances: Sequence[float], threshold: float) -> list[Piece]:
    """Pieces [first, beyond) of len(distances) + 1 sentences, cut at every distance over ``threshold``."""
    cuts = [i + 1 for i, d in enumerate(distances) if d > threshold]
    return list(zip([0, *cuts], [*cuts, len(distances) + 1]))


def join_small(pieces: Sequence[Piece], sizes: Sequence[int], distances: Sequence[float], least: int, most: int | None = None) -> list[Piece]:
    """``pieces`` after those under ``least`` joined the neighbour across the smaller distance that stays within ``most``.

    The smallest goes first.  A piece that fits nowhere never will, as neighbours only
    grow, so each is looked at once: n log n in all.
    """
    upto = np.concatenate([[0], np.cumsum(sizes)])
    begin = {b: a for a, b in pieces}  # by end
    end = dict(pieces)  # by begin
    weigh = lambda a: int(upto[end[a]] - upto[a])
    heap = [(weigh(a), a) for a in end if weigh(a) < least]
    heapq.heapify(heap)
    while heap:
        size, a = heapq.heappop(heap)
        if a not in end or weigh(a) != size:
            continue
        b = end[a]
        near = []
        if a in begin:
            near.append((distances[a - 1], begin[a]))
        if b in end:
            near.append((distances[b - 1], b))
        for _, other in sorted(near, key=lambda x: x[0]):
            if most is not None and weigh(other) + size > most:
                continue
            first, second = min(a, other), max(a, other)
            end[first] = end.pop(second)
            del begin[second]
            begin[end[first]] = first
            if weigh(first) < least:
                heapq.heappush(heap, (weigh(first), first))
            break
    return sorted(end.items())


def cut_large(pieces: Sequence[Piece], sizes: Sequence[int], distances: Sequence[float], most: int) -> list[Piece]:
    """``pieces`` with those over ``most`` cut at their greatest inner distance, again and again; single sentences stay."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    inner = np.asarray(distances, dtype=float)
    out, todo = [], list(pieces)
    while todo:
        a, b = todo.pop()
        if b - a <= 1 or upto[b] - upto[a] <= most:
            out.append((a, b))
        else:
            at = a + 1 + int(inner[a : b - 1].argmax())
            todo += [(a, at), (at, b)]
    return sorted(out)


def pieces_of(sizes: Sequence[int], distances: Sequence[float], threshold: float, least: int = LEAST, most: int = MOST) -> list[Piece]:
    """The passages of one block of sentences."""
    if not sizes:
        return []
    pieces = join_small(split_at(distances, threshold), sizes, distances, least, most)
    return join_small(cut_large(pieces, sizes, distances, most), sizes, distances, least, most)


def sentences_of(text: str) -> list[str]:
    """Sentences of one block by their marks; blanks at their ends left out."""
    return [x for x in (m.group().strip() for m in _SENTENCE.finditer(text)) if x]


def _vector(sentence: str) -> np.ndarray:
    words = [zlib.crc32(w.encode("utf-8", "replace")) % DIMENSIONS for w in _WORD.findall(sentence.lower())]
    v = np.bincount(words, minlength=DIMENSIONS).astype(float)
    n = np.sqrt(v @ v)
    return v / n if n else v


def measure(blocks: DataFrame, groups: Sequence[str], text: str) -> DataFrame:
    """``groups``, ``sizes`` of the sentences of each block in size tokens, and ``distances`` of neighbours (1 - cosine)."""
    kinds = dict(blocks.dtypes)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes, distances = [], []
            for t in pdf[text]:
                found = sentences_of(t) if isinstance(t, str) else []
                sizes.append([-(-len(s) // 4) + 1 for s in found])
                row, last = [], None
                for s in found:
                    v = _vector(s)
                    if last is not None:
                        row.append(float(1 - last @ v))
                    last = v
                distances.append(row)
            yield pdf[list(groups)].assign(sizes=sizes, distances=distances)

    schema = ", ".join(f"`{g}` {kinds[g]}" for g in groups)
    return blocks.select(*groups, text).mapInPandas(work, f"{schema}, sizes array<int>, distances array<double>")


def threshold_of(measured: DataFrame, share: float = PERCENTILE) -> float:
    """The distance below which ``share`` of all neighbours lie, within a hundred-thousandth of the rank; 0 without any."""
    each = measured.select(F.explode("distances").alias("d"))
    return each.agg(F.percentile_approx("d", share, 100_000).alias("t")).first()["t"] or 0.0


def passages(measured: DataFrame, section: Sequence[str], block: str, threshold: float, least: int = LEAST, most: int = MOST) -> DataFrame:
    """``section, passage, first_block, first_sentence, last_block, sentences, tokens``: the passages of each subsection in order.

    ``measured`` has a row a block: the columns ``section``, the number ``block``, and what
    ``measure`` gives.  A passage of several blocks has one more size token for each.
    """
    kinds = dict(measured.dtypes)
    keys = list(section)
    # Null sections are a section like any other.
    rows = measured.where(F.size("sizes") > 0).select(*keys, block, "sizes", "distances")
    rows = rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, block)
    nk = len(keys)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The open passage, and the one before it of the same subsection, which a small block may still join.
        where: tuple | None = None
        last: list | None = None
        pending: list | None = None
        number = 0

        def join(a: list, b: list) -> list:
            return [a[0], a[1], b[2], a[3] + b[3], a[4] + b[4] + 1]

        for pdf in batches:
            out: list[tuple] = []

            def close(passage: list | None) -> None:
                nonlocal number
                if passage is not None:
                    out.append((*where, number, *passage))
                    number += 1

            def settle() -> None:
                """A small block that found no room behind it joins the passage before, or stands alone."""
                nonlocal last, pending
                if pending is not None:
                    if last is not None and last[4] + pending[4] + 1 <= most:
                        last = join(last, pending)
                    else:
                        close(last)
                        last = pending
                    pending = None

            for row in pdf.itertuples(index=False):
                here = tuple(None if isinstance(x, float) and x != x else x for x in row[:nk])
                if here != where:
                    settle()
                    close(last)
                    where, last, number = here, None, 0
                sizes, distances = [int(x) for x in row[nk + 1]], list(row[nk + 2])
                pieces = pieces_of(sizes, distances, threshold, least, most)
                for a, b in pieces:
                    passage = [row[nk], a, row[nk], b - a, sum(sizes[a:b])]
                    if pending is not None and pending[4] + passage[4] + 1 <= most:
                        passage, pending = join(pending, passage), None
                    settle()
                    if passage[4] < least and len(pieces) == 1:
                        pending = passage
                    else:
                        close(last)
                        last = passage
            if out:
                yield pd.DataFrame(out, columns=columns)
        out = []
        tail = [x for x in (last, pending) if x is not None]
        if len(tail) == 2 and tail[0][4] + tail[1][4] + 1 <= most:
            tail = [join(*tail)]
        for passage in tail:
            out.append((*where, number, *passage))
            number += 1
        if out:
            yield pd.DataFrame(out, columns=columns)

    columns = [*keys, "passage", "first_block", "first_sentence", "last_block", "sentences", "tokens"]
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return rows.mapInPandas(work, f"{schema}, passage int, first_block {kinds[block]}, first_sentence int, last_block {kinds[block]}, sentences int, tokens int")
