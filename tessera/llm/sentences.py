"""Sentence units of multilingual text (problem 5).

The splitter works in two layers.

* Layout: lines are grouped into paragraphs; headings, speaker lines, list
  items and table rows are units of their own, other line breaks are ignored.
* Prose: a semi-Markov dynamic programme chooses whole spans between candidate
  cuts.  ``span_score`` adds up the word and mark that close a span, the word that
  opens it, its length and whether it holds an odd number of quotation marks or
  brackets without partner; a span that would hold half a matched quotation is not
  feasible.  Spans are scored jointly, so a doubtful cut is taken only where the
  spans on both sides gain by it.  All spans compete, however long: as the score
  depends on the length by class and on the marks by parity, the best start of each
  span is a sliding maximum, and the work is linear in the text.

Defined cases: null, empty and blank texts (also texts made only of invisible
format characters) have no units; repeated rows of one item give its units
once; extra input columns are ignored.  Whole texts are read at any length.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: marks and abbreviations -------------------------------------------------
OPENERS = {"(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "【": "】", "“": "”", "«": "»", "„": "“”", "‘": "’", "《": "》"}
#: Never the last word of a sentence: a name, number or phrase follows.
INNER_ABBREVIATIONS = frozenset(
    "dr mr mrs ms prof st no nos nr fig figs sec secs p pp ref refs approx vs cf ch vol ed eds e.g i.e "
    "art arts abs bzw ca vgl mio mrd tsd ee z.b d.h u.a sr sra srta núm p.ej ej mill mm mlle mme m cap pág págs al "
    "डॉ د श्री jan feb mar apr jun jul aug sep sept oct nov dec gen gov sen rep col".split()
)
#: Can end a sentence; the next word decides.
EITHER_ABBREVIATIONS = frozenset("u.s u.k e.u inc corp ltd co s.a a.m p.m etc suiv uu usa plc jr bros llc".split())
COMPANY_WORDS = ("Inc", "Corp", "Ltd", "Holdings", "Systems", "S.A", "AG", "Co.", "plc", "LLC", "Group")
GERMAN_MONTHS = (
    "Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November",
    "Dezember", "Quartal", "Jahrhundert", "Kapitel", "Halbjahr", "Geschäftsjahr", "Mal", "Auflage", "Woche",
)
ORDINAL_LEADS = frozenset("am im dem der vom zum den des das die seit ab bis".split())
THAI_INNER = ("ใน", "ล้าน", "พัน", "และ", "หรือ", "ที่", "ของ", "กับ", "โดย", "เมื่อ", "ถึง", "ต่อ", "บาท", "ดอลลาร์", "เปอร์เซ็นต์")

_LINE = re.compile(r"[^\n\r  ]+")
_VISIBLE = re.compile(r"[^\s​-‏⁠-⁤﻿­]")
_MARK = re.compile(r"[.!?…。！？｡।॥؟۔]+")
#: Closing marks that belong to the sentence before them even where their opening is not in sight.
_TAIL = ")]）」』】》\u201d\u00bb"
_PAIRS = re.compile(r"[()\[\]（）「」『』【】“”„«»‘’\"《》]")
_WORD_BEFORE = re.compile(r"[^\s(\[（「『“”„«»‘\"]+$")
_BULLET = re.compile(r"(?:[-*•·▪◦‣–—]\s+|\(?\d{1,3}[.)、]\s+|\(?[A-Za-z][.)]\s+|[一二三四五六七八九十]{1,3}、)")
_SPEAKER = re.compile(r"[^\W\d_a-z][\w.'’-]*(?:(?:\s*[,—–-]\s*|\s+)(?:of|and|the|for|[^\W\d_a-z][\w.'’-]*|[a-z][A-Z]\w*))*:?$")
_STRONG = re.compile(r"[^\W\d_]{3,}[.!?]\s+[^\W\d_a-z]")
_THAI_GAP = re.compile(r"(?<=[ก-๛0-9%])[  　\n]+(?=[ก-ไ])")
_HAS_THAI = re.compile(r"[ก-๛]")
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
_NUMBER = re.compile(r"[\d.,]*\d$")
_ENDS = tuple(".!?…。！？｡।॥؟۔\"”’»“)）」』]】")
_ELLIPSES = frozenset(("...", "…", "……", "....", "…."))
_CJK_STOPS = frozenset("。！？｡")
_QUOTE_CLOSERS = frozenset("”」』’\"»》")


def _quoted(text: str, s: int, e: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Outermost matched quotations and brackets of a segment, as (open, close), and the marks that found no partner."""
    stack: list[tuple[str, int]] = []
    pairs: list[tuple[int, int]] = []
    alone: list[int] = []
    for m in _PAIRS.finditer(text, s, e):
        c, k = m.group(), m.start()
        if c == '"':
            if any(o == '"' for o, _ in stack):
                while stack[-1][0] != '"':
                    alone.append(stack.pop()[1])
                pairs.append((stack.pop()[1], k))
            else:
                stack.append((c, k))
            continue
        if c == "“" and any(o == "„" for o, _ in stack):
            while stack[-1][0] != "„":
                alone.append(stack.pop()[1])
            pairs.append((stack.pop()[1], k))
            continue
        if c == "’" and 0 < k < len(text) - 1 and text[k - 1].isalpha() and text[k + 1].isalpha():
            continue
        if c in OPENERS:
            stack.append((c, k))
        elif any(c in OPENERS.get(o, "") for o, _ in stack):
            while c not in OPENERS.get(stack[-1][0], ""):
                alone.append(stack.pop()[1])
            pairs.append((stack.pop()[1], k))
        else:
            alone.append(k)
    alone += [k for _, k in stack]
    pairs.sort()
    outer, reach = [], -1
    for a, b in pairs:
        if b > reach:
            outer.append((a, b))
            reach = b
    return outer, sorted(alone)


def _opening(text: str, q: int, e: int) -> str:
    """Class of what follows a cut: upper, lower, digit, open, letter (a script without case), other."""
    c = text[q]
    if c.isupper():
        return "upper"
    if c.islower():
        return "upper" if q + 1 < e and text[q + 1].isupper() else "lower"
    if c.isdigit():
        return "digit"
    if c in OPENERS or c in "\"¡¿'":
        return "open"
    return "letter" if c.isalpha() else "other"


def _full_stop(text: str, s: int, e: int, at: int, end: int, q: int, partner: dict[int, int]) -> float:
    """Score of closing a span with a full stop at ``at``; ``q`` is the next visible character."""
    m = _WORD_BEFORE.search(text, max(s, at - 40), at)
    word = m.group() if m else ""
    if not word.isascii():
        word = _INVISIBLE.sub("", word)
    kind, spaced, low = _opening(text, q, e), q > end, word.lower()
    if not spaced:
        if end > at + 1:  # closing quote or bracket, then text at once
            return 3.0 if kind in ("upper", "open") else -6.0
        if kind == "open":
            return 3.0 if len(word) > 2 and low not in INNER_ABBREVIATIONS else -6.0
        if kind == "letter":
            return 3.0 if word and low not in INNER_ABBREVIATIONS and not word[-1].isdigit() else -6.0
        if kind != "upper" or low in INNER_ABBREVIATIONS or not word or "/" in word or "@" in word or "www" in low:
            return -6.0
        if low in EITHER_ABBREVIATIONS:
            return 1.0 if q + 1 < e and text[q + 1].islower() else -6.0
        # "rose.The", "5%.The", "MWh.The" end a sentence; "S.A" and "v1.A" do not.
        plain = word[-1].isdigit() or word[-1] in "%)" or len(word) > 1 and word[-1].isalpha() and not ("." in word and not word[-2].isalpha())
        return 3.0 if plain and (q + 1 >= e or text[q + 1].isalpha() or text[q + 1].isspace() or text[q + 1] in "'’") else -6.0
    if end > at + 1 and text[end - 1] in ")]）":  # a closed bracket ends what it holds
        return -6.0 if kind == "lower" else 5.0
    if kind == "lower":
        return -6.0
    if end > at + 1 and low not in INNER_ABBREVIATIONS:
        return 5.0
    if not word:
        return 2.0
    if low in INNER_ABBREVIATIONS or len(word) == 1 and word.isalpha():
        return -6.0
    if kind == "open" and text[q] in "(（[":  # a bracketed sentence, or a remark on what stands before?
        shut = partner.get(q, 0)
        if shut > 0 and text[shut - 1] not in ".!?…":
            return -6.0
    if low in EITHER_ABBREVIATIONS or "." in word[:-1] and len(word) <= 5 and word.replace(".", "").isalpha():
        return -6.0 if text.startswith(COMPANY_WORDS, q) and kind == "upper" else 2.0
    if _NUMBER.fullmatch(word):
        head = at - len(word)
        while head > s and text[head - 1].isspace():
            head -= 1
        if head == s:
            return -8.0
        if len(word) <= 2:
            if text.startswith(GERMAN_MONTHS, q):
                return -6.0
            lead = text[max(s, text.rfind(" ", max(s, head - 40), head) + 1) : head].lower()
            if lead in ORDINAL_LEADS and kind == "upper":
                return -5.0
        return 3.0
    return 3.0 if kind == "other" else 5.0


def _cuts(text: str, s: int, e: int, partner: dict[int, int]) -> list[tuple[int, float]]:
    """Candidate cuts of a segment, each with the score of closing there and opening behind it."""
    out: list[tuple[int, float]] = []
    closing = set(partner.values())
    for m in _MARK.finditer(text, s, e):
        mark = m.group()
        at = m.start()
        end = m.end()
        while end < e and (end in closing or text[end] in _TAIL):
            end += 1
        if end + 1 < e and text[end].isspace() and text[end + 1] == "\u00bb":
            end += 2
        if end >= e:
            break
        q = end
        while q < e and text[q].isspace():
            q += 1
        if q >= e:
            break
        c = text[q]
        if _MARK.match(c):
            continue
        if mark == ".":
            score = _full_stop(text, s, e, at, end, q, partner)
        elif mark in _ELLIPSES:
            kind = _opening(text, q, e)
            if q == end:
                score = 2.0 if kind == "upper" and mark[0] == "." and text[at - 1].islower() or kind == "upper" and mark == "…" and text[at - 1].isascii() else -6.0
            else:
                score = -6.0 if kind == "lower" else 4.0
        elif mark[-1] in _CJK_STOPS:
            follow = text[end - 1] in _QUOTE_CLOSERS and q == end and not (c in OPENERS or c == '"')
            score = -6.0 if follow else 6.0
        elif mark[-1] in "।॥؟۔":
            score = 6.0
        else:
            kind = _opening(text, q, e)
            if q > end:
                score = -4.0 if kind == "lower" else 5.0
            else:
                score = 3.0 if kind in ("upper", "letter", "open") and text[end - 1] not in _QUOTE_CLOSERS else -6.0
        out.append((end, score))
    if _HAS_THAI.search(text, s, e):
        known = {p for p, _ in out}
        for m in _THAI_GAP.finditer(text, s, e):
            p, q = m.span()
            if p in known:
                continue
            before = text[p - 1]
            if before.isdigit():
                head = _WORD_BEFORE.search(text, max(s, p - 12), p)
                year = head and len(head.group()) == 4 and text[max(s, p - 8) : p - 4].rstrip().endswith("ปี")
                score = 5.0 if year else -6.0
            elif before == "%":
                score = -6.0 if text.startswith(THAI_INNER, q) else -2.0
            else:
                score = -5.0 if text.startswith(THAI_INNER, q) else 4.0
            out.append((p, score))
        out.sort()
    return out


#: Cuts at or below this score are left out beforehand: no length, opening or balance can make up for it (see ``span_score``).
NEVER = -5.0
#: Spans shorter than this, and longer, are unlikely sentences.
SHORT, LONG = 3, 1200
SHORT_SCORE, LONG_SCORE, LOWER_SCORE, ODD_SCORE = -8.0, -0.5, -1.0, -1.0


def span_score(closing: float, opening: str, length: int, odd: bool) -> float:
    """Score of a whole span: its closing word and mark, the kind of word that opens it, its length, and its marks without partner.

    Beside ``closing``, splitting a span in two gains 0.5 at most (two of usual length for
    one over ``LONG``; an odd span splits into an odd and an even one).
    """
    score = closing
    if length < SHORT:
        score += SHORT_SCORE
    elif length > LONG:
        score += LONG_SCORE
    if opening == "lower":
        score += LOWER_SCORE
    return score + ODD_SCORE if odd else score


def _best_spans(ends: list[int], closing: list[float], opening: list[str], marks: list[int]) -> list[int]:
    """Indexes of the cuts of the best segmentation, each span scored by ``span_score``; of equals the shorter last span.

    ``marks`` counts the marks without partner before each cut.  For a span's end its start
    is the best of four sliding maxima (usual length or over ``LONG``, marks even or odd)
    and the few starts less than ``SHORT`` before it.
    """
    n = len(ends)
    best, back = [0.0] * n, [0] * n
    usual: tuple[deque[int], deque[int]] = (deque(), deque())
    far: list[int] = [-1, -1]
    enter = leave = 0
    for j in range(1, n):
        while ends[j] - ends[enter] >= SHORT:
            row = usual[marks[enter] & 1]
            while row and best[row[-1]] + _open(opening[row[-1]]) <= best[enter] + _open(opening[enter]):
                row.pop()
            row.append(enter)
            enter += 1
        while leave < enter and ends[j] - ends[leave] > LONG:
            p = marks[leave] & 1
            if usual[p] and usual[p][0] == leave:
                usual[p].popleft()
            if far[p] < 0 or best[far[p]] + _open(opening[far[p]]) <= best[leave] + _open(opening[leave]):
                far[p] = leave
            leave += 1
        starts = [row[0] for row in usual if row] + [i for i in far if i >= 0] + list(range(enter, j))
        top, arg = -1e18, -1
        for i in starts:
            score = best[i] + span_score(closing[j], opening[i], ends[j] - ends[i], (marks[j] - marks[i]) % 2 == 1)
            if score > top or score == top and i > arg:
                top, arg = score, i
        best[j], back[j] = top, arg
    path, j = [], n - 1
    while j > 0:
        path.append(j)
        j = back[j]
    return path[::-1]


def _open(kind: str) -> float:
    return LOWER_SCORE if kind == "lower" else 0.0


def _prose(text: str, s: int, e: int, out: list[tuple[int, int]]) -> None:
    """Best segmentation of one prose segment into whole spans."""
    quoted, alone = _quoted(text, s, e)
    ends, closing, k = [s], [0.0], 0
    for p, score in _cuts(text, s, e, dict(quoted)):
        if score <= NEVER:
            continue
        while k < len(quoted) and quoted[k][1] < p:
            k += 1
        if k < len(quoted) and quoted[k][0] < p:  # both spans would hold half a quotation or bracket
            continue
        ends.append(p)
        closing.append(score)
    ends.append(e)
    closing.append(0.0)
    if len(ends) == 2:
        out.append((s, e))
        return
    opening, marks, k = [], [], 0
    for p in ends:
        while k < len(alone) and alone[k] < p:
            k += 1
        marks.append(k)
        while p < e and text[p].isspace():
            p += 1
        opening.append(_opening(text, p, e) if p < e else "other")
    begin = s
    for j in _best_spans(ends, closing, opening, marks):
        a, b = begin, ends[j]
        while a < b and text[a].isspace():
            a += 1
        stop = b
        while stop > a and text[stop - 1].isspace():
            stop -= 1
        if stop > a:
            out.append((a, stop))
        begin = b


def sentence_spans(text: str | None, prose_only: bool = False) -> list[tuple[int, int]]:
    """Sentence units of one text as (start, end) in code points, in order.

    With ``prose_only`` headings, speaker lines, list items and table rows are left out.
    """
    if not text:
        return []
    paragraphs: list[list[tuple[int, int]]] = []
    lines: list[tuple[int, int]] = []
    last = 0
    for m in _LINE.finditer(text):
        a, b = m.span()
        if lines and a - last > 1 and (text.count("\n", last, a) > 1 or text.count("\r", last, a) > 1 or a - last > 2):
            paragraphs.append(lines)
            lines = []
        last = b
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a == b:
            if lines:
                paragraphs.append(lines)
                lines = []
            continue
        lines.append((a, b))
    if lines:
        paragraphs.append(lines)
    out: list[tuple[int, int]] = []
    layout: list[tuple[int, int]] = [] if prose_only else out
    for lines in paragraphs:
        if len(lines) == 1:
            a, b = lines[0]
            thai = _HAS_THAI.search(text, a, b)
            bare = b - a <= 90 and not text[a:b].endswith(_ENDS) and not _STRONG.search(text, a, b)
            if text[a] == "|" or bare and (not thai or b - a <= 24 and text[a:b].isalpha() or prose_only and b - a <= 24 and not any(c.isdigit() for c in text[a:b]) and " " not in text[a:b]) or _BULLET.match(text, a, b) and prose_only:
                layout.append((a, b))
            else:
                _prose(text, a, b, out)
            continue
        k, items = 0, False
        if not text[lines[0][0] : lines[0][1]].endswith(_ENDS) and lines[0][1] - lines[0][0] <= 60 and text[lines[0][0]] != "|":
            a, b = lines[0]
            if _SPEAKER.match(text, a, b) and _opening(text, lines[1][0], lines[1][1]) != "lower":
                layout.append((a, b))
                k = 1
        begin = -1
        stop = 0
        while k < len(lines):
            a, b = lines[k]
            if text[a] == "|":
                if begin >= 0:
                    _prose(text, begin, stop, out)
                    begin = -1
                layout.append((a, b))
                items = False
            elif (items or k == 0 or text[lines[k - 1][1] - 1] in ":：") and _BULLET.match(text, a, b) and (text[a] in "-*•·▪◦‣–—" or items or k > 0 or _BULLET.match(text, *lines[1])):
                if begin >= 0:
                    if not items and text[stop - 1] in ":：" and text.count("\n", begin, stop) == 0:
                        layout.append((begin, stop))
                    elif items:
                        layout.append((begin, stop))
                    else:
                        _prose(text, begin, stop, out)
                begin, stop, items = a, b, True
            else:
                if begin < 0:
                    begin = a
                stop = b
            k += 1
        if begin >= 0:
            if items:
                layout.append((begin, stop))
            else:
                _prose(text, begin, stop, out)
    return [u for u in out if _VISIBLE.search(text, *u)]


def sentence_ends(text: str) -> list[int]:
    """Ends of the sentences of one text wherever they stand, in list items and table cells too."""
    out: list[tuple[int, int]] = []
    begin = stop = -1
    for m in _LINE.finditer(text):
        a, b = m.span()
        row = text[a:b].lstrip().startswith("|")
        if begin >= 0 and (row or text.count("\n", stop, a) > 1 or not text[a:b].strip()):
            _prose(text, begin, stop, out)
            begin = -1
        if row:
            _prose(text, a, b, out)
        elif text[a:b].strip():
            begin, stop = (a if begin < 0 else begin), b
    if begin >= 0:
        _prose(text, begin, stop, out)
    return [b for _, b in out]


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        starts, ends = [], []
        for text in pdf["text"]:
            spans = sentence_spans(text) if isinstance(text, str) else []
            starts.append([a for a, _ in spans])
            ends.append([b for _, b in spans])
        yield pd.DataFrame({"item_table": pdf["item_table"], "item_id": pdf["item_id"], "starts": starts, "ends": ends})


def split_sentences(items: DataFrame) -> DataFrame:
    """Sentence units of ``items(item_table, item_id, text)``: one row per unit with its offsets.

    Texts never cross the network: each is split where it is read, and only the
    offsets are shuffled, to give the units of repeated rows once.  Items whose
    text has no visible character give no row; a null ``item_id`` is kept as null.
    """
    spans = items.select("item_table", "item_id", "text").mapInPandas(_units, "item_table string, item_id string, starts array<int>, ends array<int>")
    once = spans.where(F.size("starts") > 0).distinct()
    pairs = once.select("item_table", "item_id", F.explode(F.arrays_zip("starts", "ends")).alias("u"))
    return pairs.select("item_table", "item_id", F.col("u.starts").cast("long").alias("start_char"), F.col("u.ends").cast("long").alias("end_char"))


def chunk_body(column: str) -> F.Column:
    """The body of a chunk's document: what follows the breadcrumb line, or all if there is none."""
    return F.expr(f"case when startswith({column}, '[') and instr({column}, '\\n') > 0 then substring({column}, instr({column}, '\\n') + 1) else {column} end")
