"""What a question asks for: fiscal periods, line items, formulas, direction, and its canonical text.

Rules compete for the characters of the normalised question: periods first, then phrases
of a glossary, longest first; what one has taken no other can.  The glossary is a table
(kind, canonical, phrase), found by runs of words in a hash table, so its size does not
matter to the work on a question.  That needs a memory of taken spans, so it is one Arrow
function; nothing is shuffled.

Defined cases: null and blank questions have no slots and a null or empty canonical text;
a year outside the calendar is no period; a bare calendar year is ambiguous and resolved to
the fiscal year that holds most of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame

#: Phrases of a glossary are sent to every worker, so their number is bounded.
MOST_PHRASES = 100_000

# --- fixed values: months and the words of relative periods, directions and comparisons ------------------
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
LATEST = ("last fiscal year", "latest fiscal year", "most recent fiscal year", "current fiscal year", "this fiscal year", "the fiscal year just ended", "end of last fiscal year", "last year end", "most recent year end", "latest year end")
PRIOR = ("prior fiscal year", "previous fiscal year", "the year before", "a year earlier", "prior year end", "previous year end")
LEXICON = [
    *[("direction", "up", w) for w in "increase increased rise rose grow grew growth higher gain gained".split()],
    *[("direction", "down", w) for w in "decrease decreased fall fell decline declined lower drop dropped".split()],
    *[("aggregation", "yoy", w) for w in ("year over year", "yoy", "compared", "versus", "vs")],
    *[("aggregation", "change", w) for w in ("change", "changed", "move", "moved")],
    *[("aggregation", "total", w) for w in ("in total", "altogether")],
]


def last_sunday_of_january(year: int) -> date:
    end = date(year, 1, 31)
    return end - timedelta(days=(end.weekday() + 1) % 7)


@dataclass(frozen=True)
class Calendar:
    """Fiscal years by their last days; a year begins the day after the one before it ended."""

    ends: dict[int, date] = field(default_factory=lambda: {y: last_sunday_of_january(y) for y in range(2023, 2027)})
    offset: int = 1

    @property
    def years(self) -> list[int]:
        """The years whose first day is known."""
        return sorted(self.ends)[1:]

    def year_of(self, day: date) -> int | None:
        return next((y for y in self.years if self.ends[y - 1] < day <= self.ends[y]), None)

    def resolve(self, period: str) -> int:
        year = int(period[-4:])
        if period.startswith("FY"):
            return year
        shifted = year + self.offset
        return shifted if shifted in self.years else min(max(year, self.years[0]), self.years[-1])


def normalised(question: str) -> str:
    """Lower case; punctuation is blank except marks that belong to amounts, dates and names."""
    text = question.lower().replace("’", "'")
    text = re.sub(r"[^\w$%.'/& ]+|(?<!\d)\.|\.(?!\d)", " ", text)
    return " ".join(text.split())


def _day(year: str, month: str | int, day: str) -> date | None:
    try:
        return date(int(year), int(month), int(day))
    except ValueError:
        return None


_E = r"(?![a-z0-9])"
_B = r"(?<![a-z0-9])"
_MONTH = "|".join(f"{m}[a-z]*" for m in MONTHS)
Rule = tuple[re.Pattern[str], Callable[[re.Match[str], Calendar], str | None]]


def _fy(raw: str, calendar: Calendar) -> str | None:
    year = int(raw) if len(raw) == 4 else 2000 + int(raw)
    return f"FY{year}" if year in calendar.years else None


def _of_day(day: date | None, calendar: Calendar) -> str | None:
    year = calendar.year_of(day) if day else None
    return f"FY{year}" if year else None


def _bare(m: re.Match[str], calendar: Calendar) -> str | None:
    year = int(m[1])
    return f"AMBIGUOUS_{year}" if year in calendar.years or year + calendar.offset in calendar.years else None


#: Forms of a period, in the order in which they may take characters.
PERIODS: list[Rule] = [
    (re.compile(rf"{_B}fy ?(\d{{4}}|\d\d){_E}"), lambda m, c: _fy(m[1], c)),
    (re.compile(rf"{_B}fiscal(?: year)?(?: end(?:ed|ing)?)?(?: of)? ?(\d{{4}}|\d\d){_E}(?: year end{_E})?"), lambda m, c: _fy(m[1], c)),
    (re.compile(rf"{_B}({_MONTH}) ?(?:(\d{{1,2}}) )?(\d{{4}}){_E}"), lambda m, c: _of_day(_day(m[3], MONTHS[m[1][:3]], m[2] or "15"), c)),
    (re.compile(rf"{_B}(\d{{4}}) (\d\d) (\d\d){_E}"), lambda m, c: _of_day(_day(m[1], m[2], m[3]), c)),
    (re.compile(rf"(?<![a-z0-9/])(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?![a-z0-9/])"), lambda m, c: _of_day(_day(m[3], m[1], m[2]), c)),
    (re.compile(rf"{_B}year end(?:ed|ing)? (\d{{4}}){_E}"), lambda m, c: _fy(m[1], c)),
    (re.compile(r"(?<![a-z0-9$%.])(20\d\d)(?![a-z0-9%.])"), _bare),
]


class SlotReader:
    """Reads the slots of questions with one calendar and one glossary of (kind, canonical, phrase)."""

    def __init__(self, glossary: Iterable[tuple[str, str, str]] = (), calendar: Calendar | None = None) -> None:
        self.calendar = calendar or Calendar()
        latest = self.calendar.years[-1]
        relative = [("period", f"FY{latest}", p) for p in LATEST] + [("period", f"FY{latest - 1}", p) for p in PRIOR]
        self.levels = [self._table(relative), self._table(glossary), self._table(LEXICON)]

    @staticmethod
    def _table(rows: Iterable[tuple[str, str, str]]) -> tuple[dict[str, tuple[str, str]], int]:
        found: dict[str, tuple[str, str]] = {}
        for kind, canonical, phrase in sorted(rows):
            if key := normalised(phrase):
                found.setdefault(key, (kind, canonical))
        return found, max((k.count(" ") + 1 for k in found), default=0)

    def read(self, question: str | None) -> dict | None:
        if question is None:
            return None
        text = normalised(question)
        taken = bytearray(len(text))
        matches: list[tuple[int, int, str, str]] = []

        def take(a: int, b: int, kind: str, canonical: str) -> None:
            if not any(taken[a:b]):
                taken[a:b] = b"\x01" * (b - a)
                matches.append((a, b, kind, canonical))

        words = [m.span() for m in re.finditer(r"[^ ]+", text)]

        def phrases(level: int) -> None:
            table, longest = self.levels[level]
            hits = []
            for i in range(len(words)):
                for j in range(i, min(i + longest, len(words))):
                    if (hit := table.get(text[words[i][0] : words[j][1]])) is not None:
                        hits.append((words[i][0] - words[j][1], words[i][0], words[j][1], hit))
            for _, a, b, (kind, canonical) in sorted(hits):
                take(a, b, kind, canonical)

        phrases(0)
        for pattern, period in PERIODS:
            for m in pattern.finditer(text):
                if (name := period(m, self.calendar)) is not None:
                    take(*m.span(), "period", name)
        phrases(1)
        phrases(2)
        matches.sort()

        def named(kind: str) -> list[str]:
            return list(dict.fromkeys(c for _, _, k, c in matches if k == kind))

        periods = sorted(set(named("period")), key=lambda p: (self.calendar.resolve(p), p))
        unsure = [p for p in periods if p.startswith("A")]
        note = None
        if unsure:
            year = self.calendar.resolve(unsure[-1])
            note = f"{unsure[-1][-4:]} was read as fiscal {year}, which ended {self.calendar.ends[year]:%B %d, %Y}"
        directions = named("direction")
        out, at = [], 0
        for a, b, kind, canonical in matches:
            if kind not in ("direction", "aggregation"):
                out += [text[at:a], canonical.lower().replace(" ", "_").replace("'", "")]
                at = b
        out.append(text[at:])
        return {
            "periods": periods, "years": sorted({self.calendar.resolve(p) for p in periods}), "note": note, "metrics": named("metric"), "formulas": named("formula"), "statements": named("statement"),
            "direction": directions[0] if len(directions) == 1 else None, "aggregation": named("aggregation"), "canonical": " ".join("".join(out).split()),
        }


FIELDS = "periods array<string>, years array<int>, note string, metrics array<string>, formulas array<string>, statements array<string>, direction string, aggregation array<string>, canonical string"


def glossary_rows(glossary: DataFrame) -> list[tuple[str, str, str]]:
    """The rows of a glossary table, of at most ``MOST_PHRASES`` phrases; more raise an error."""
    rows = glossary.select("kind", "canonical", "phrase").where("kind is not null and canonical is not null and phrase is not null").distinct().limit(MOST_PHRASES + 1).collect()
    if len(rows) > MOST_PHRASES:
        raise ValueError(f"more than {MOST_PHRASES} phrases")
    return [tuple(r) for r in rows]


def read_slots(questions: DataFrame, glossary: DataFrame, key: str = "id", question: str = "question", calendar: Calendar | None = None) -> DataFrame:
    """``key`` and the slots of each question."""
    rows = glossary_rows(glossary)
    kind = dict(questions.dtypes)[key]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = SlotReader(rows, calendar)
        names = [c.split()[0] for c in FIELDS.split(", ")]
        for pdf in batches:
            found = [reader.read(q if isinstance(q, str) else None) or dict.fromkeys(names) for q in pdf[question]]
            yield pd.DataFrame({key: pdf[key], **{n: pd.Series([f[n] for f in found], dtype=object) for n in names}})

    return questions.select(key, question).mapInPandas(work, f"{key} {kind}, {FIELDS}")
