"""Day ranges named in a question, in English and Chinese, relative to a given day.

A scanner cuts the question into the words of a small lexicon (units, pointers such as "last",
day names, numbers); neighbouring words then spell a range, and one calendar turns it
into days.  What says most wins: dates, then named days, calendar weeks and months,
counted units, and vague words last.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, timedelta
from typing import NamedTuple

DIGITS = {c: k for k, c in enumerate("零一二三四五六七八九")} | {"两": 2}
UNIT_DAYS = {"day": 1, "week": 7, "month": 30}


@dataclass(frozen=True)
class DayRange:
    first: date
    last: date
    words: tuple[str, ...]

    def rest(self, question: str) -> str:
        """The question without the words that named the range."""
        for w in self.words:
            question = question.replace(w, " ")
        return question


def chinese_number(s: str) -> int | None:
    """1 to 99, in digits or in characters."""
    if s.isdigit():
        return int(s)
    tens, ten, ones = s.rpartition("十")
    if not ten:
        return DIGITS.get(s)
    if any(c not in DIGITS for c in tens + ones) or len(tens) > 1 or len(ones) > 1:
        return None
    return 10 * (DIGITS[tens] if tens else 1) + (DIGITS[ones] if ones else 0)


class Word(NamedTuple):
    """A word of the lexicon in the question: its kind, value, and place."""

    kind: str
    value: object
    start: int
    end: int


#: kind -> value -> spellings.  "turn" points at a calendar unit, "span" may stand before a count.
LEXICON: dict[str, dict[object, str]] = {
    "unit": {"day": "day days 天", "week": "week weeks 周 星期 礼拜", "month": "month months 月 个月"},
    "named": {0: "today 今天 今日", -1: "yesterday 昨天 昨日", -2: "前天"},
    "turn": {0: "this 本 这 这个", -1: "last 上 上个"},
    "span": {"": "past recent 近 过去"},
    "vague": {7: "recently lately 最近"},
    "ago": {"": "前"},
    "few": {"": "几"},
    "year": {"": "年"},
    "date": {"": "日 号"},
    "before": {"": "before"},
}
SPELLED = {spelling: (kind, value) for kind, values in LEXICON.items() for value, spellings in values.items() for spelling in spellings.split()}
COUNTING = {"last", "past", "recent", "最近", "近", "过去", "这"}
SCAN = re.compile(
    "(?P<number>[0-9]{1,4}|[零一两二三四五六七八九十]{1,3})|(?P<word>[A-Za-z]+|" + "|".join(sorted((w for w in SPELLED if not w.isascii()), key=len, reverse=True)) + ")"
)


def scan(question: str) -> list[Word]:
    """The lexicon's words in order; each other Latin word is a word of kind "other"."""
    out: list[Word] = []
    for m in SCAN.finditer(question):
        if m["number"]:
            out.append(Word("number", chinese_number(m[0]), m.start(), m.end()))
        else:
            kind, value = SPELLED.get(m[0].lower(), ("other", m[0]))
            out.append(Word(kind, value, m.start(), m.end()))
    return out


class Calendar:
    """Days around a given one."""

    def __init__(self, today: date):
        self.today = today

    def day(self, away: int) -> tuple[date, date]:
        d = self.today + timedelta(away)
        return d, d

    def back(self, days: int) -> tuple[date, date]:
        return self.today - timedelta(days - 1), self.today

    def unit(self, unit: str, turn: int) -> tuple[date, date]:
        """This week or month so far, or the whole one before; weeks start on Monday."""
        first = self.today - timedelta(self.today.weekday()) if unit == "week" else self.today.replace(day=1)
        if turn == 0:
            return first, self.today
        end = first - timedelta(1)
        return (end - timedelta(6) if unit == "week" else end.replace(day=1)), end

    def date(self, year: int | None, month: int, day: int) -> tuple[date, date] | None:
        try:
            d = date(year or self.today.year, month, day)
        except ValueError:
            return None
        return d, d


def spelled(words: list[Word], question: str, calendar: Calendar) -> tuple[int, int, tuple[date, date]] | None:
    """(weight, words used, range) of what the words from the first on spell, if anything."""
    near = 1
    while near < len(words) and not question[words[near - 1].end : words[near].start].strip():
        near += 1
    kinds, values = [w.kind for w in words[:near]], [w.value for w in words[:near]]
    text = question[words[0].start : words[0].end].lower()

    def stands(*wanted: str) -> bool:
        return kinds[: len(wanted)] == list(wanted)

    for year in (2, 0):
        if (year == 0 or stands("number", "year")) and kinds[year : year + 4] == ["number", "unit", "number", "date"] and question[words[year + 1].start : words[year + 1].end] == "月" and None not in (values[year], values[year + 2]):
            found = calendar.date(values[0] if year else None, values[year], values[year + 2])
            return (0, year + 4, found) if found else None
    if stands("unit", "before", "named") and values[0] == "day" and values[2] == -1:
        return 1, 3, calendar.day(-2)
    if stands("named"):
        return 2, 1, calendar.day(values[0])
    if stands("turn", "unit") and values[1] != "day":
        return 3, 2, calendar.unit(values[1], values[0])
    if text in COUNTING and kinds[1:3] == ["number", "unit"] and values[1]:
        return 4, 3, calendar.back(values[1] * UNIT_DAYS[values[2]])
    if (stands("turn", "few", "unit") or stands("ago", "few", "unit")) and values[2] == "day" and text in ("这", "前"):
        return 5, 3, calendar.back(7)
    return (5, 1, calendar.back(values[0])) if stands("vague") else None


def parse_range(question: str, today: date) -> DayRange | None:
    """Inclusive; ISO dates come first, several of them span a range.  Weeks start on Monday."""
    iso: list[date] = []
    given = re.findall(r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)", question)
    for w in given:
        try:
            iso.append(date.fromisoformat(w))
        except ValueError:
            continue
    if iso:
        return DayRange(min(iso), max(iso), tuple(dict.fromkeys(given)))
    words, best = scan(question), None
    for k in range(len(words)):
        if (found := spelled(words[k:], question, Calendar(today))) and (best is None or found[0] < best[0]):
            best = (found[0], DayRange(*found[2], (question[words[k].start : words[k + found[1] - 1].end],)))
    return best[1] if best else None


def range_word(word: str, today: date) -> tuple[date, date] | None:
    """The words of a filter bar: today, yest, w7, a day, or nothing."""
    calendar = Calendar(today)
    if not word:
        return None
    if word in ("today", "yest"):
        return calendar.day(0 if word == "today" else -1)
    if m := re.fullmatch(r"w(\d+)", word):
        return calendar.back(int(m[1]))
    d = date.fromisoformat(word)
    return d, d
