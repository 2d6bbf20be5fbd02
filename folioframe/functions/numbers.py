"""Numbers in texts, read out in words.

A literal is a run of digit groups with single separators, with what belongs to
it in front (a currency sign) and behind (a percent sign, an ordinal's letters,
the half of the day). Its groups are read from the left: the longest beginning
that makes sense as one of the kinds below is said in words, and what makes no
sense stays as it is. Whole numbers of up to three digits stay in digits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
_MONTHS = "January February March April May June July August September October November December".split()
_ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
#: Currencies and their coins.
_COINS = {"$": ("dollar", "cent"), "£": ("pound", "penny"), "€": ("euro", "cent")}
KINDS = ("iso_date", "us_date", "time", "money", "percent", "ordinal", "grouped", "decimal", "plain")


def _small(n: int) -> str:
    """Words of a number below a thousand."""
    if n >= 100:
        return f"{_ONES[n // 100]} hundred" + (f" {_small(n % 100)}" if n % 100 else "")
    if n >= 20:
        return _TENS[n // 10] + (f"-{_ONES[n % 10]}" if n % 10 else "")
    return _ONES[n]


def int_words(n: int | str) -> str:
    """Words of an integer, given as such or by its digits, from 0 to a quadrillion; digits beyond."""
    digits = str(n).lstrip("0")
    if len(digits) > 15:
        return digits
    n = int(digits or 0)
    parts = [f"{_small(n // u % 1000)} {name}" for u, name in ((10**12, "trillion"), (10**9, "billion"), (10**6, "million"), (10**3, "thousand")) if n // u % 1000]
    if n % 1000 or not parts:
        parts.append(_small(n % 1000))
    return " ".join(parts)


def year_words(n: int) -> str:
    """A year as it is read: nineteen eighty-four, twenty oh five, two thousand."""
    century, rest = divmod(n, 100)
    if not 100 <= n <= 2999 or n % 1000 == 0:
        return int_words(n)
    return f"{int_words(century)} " + ("hundred" if not rest else f"oh {int_words(rest)}" if rest < 10 else int_words(rest))


def ordinal_words(n: int | str) -> str:
    """first, twenty-second, one hundredth."""
    head, last = re.fullmatch("(.*?)([a-z]+|[0-9]+)", int_words(n)).groups()
    return head + (_ORDINALS.get(last) or (last[:-1] + "ieth" if last.endswith("y") else last + "th"))


def point_words(whole: str, part: str) -> str:
    """A decimal: the digits behind the point one by one."""
    return " ".join([int_words(whole), "point", *(_ONES[int(d)] for d in part)])


def date_words(year: str, month: str, day: str) -> str:
    return f"{_MONTHS[int(month) - 1]} {ordinal_words(int(day))}, {year_words(int(year))}"


def clock_words(hour: int, minute: int, half: str) -> str:
    """A time of day on the twelve-hour clock; without a stated half of the day the hour tells it, and 0 stays 0."""
    if not half:
        if minute == 0 and hour in (0, 12):
            return ("midnight", "noon")[hour // 12]
        half = ("AM", "PM")[hour >= 12]
    elif half == "AM" and hour == 0:
        hour = 12
    said = [int_words(hour - 12 if hour > 12 else hour)]
    return " ".join(said + ([int_words(minute)] if minute else []) + [half])


def money_words(sign: str, whole: str, part: str) -> str:
    """Coins and notes; more than two digits behind the point are read as a decimal."""
    note, coin = _COINS[sign]
    if len(part) > 2:
        return f"{point_words(whole, part)} {note}s"
    said = [f"{int_words(n)} {name}" + ("s" if n != "1" else "") for n, name in ((whole.lstrip("0"), note), (part.ljust(2, "0").lstrip("0"), coin)) if n]
    return " and ".join(said) or f"zero {note}s"


#: A run of digit groups; its sign, and what may follow it.
_RUN = re.compile(r"([$£€]?)([0-9]+(?:[.,:/-][0-9]+)*)")
_BEHIND = re.compile(r"%|(?:st|nd|rd|th)\b|\s*[ap]m\b", re.I)


def _in(text: str, low: int, high: int, widths: tuple[int, ...] = (1, 2)) -> bool:
    return len(text) in widths and low <= int(text) <= high


def _thousands(groups: list[str]) -> bool:
    return len(groups[0]) <= 3 and all(len(g) == 3 for g in groups[1:])


def reading(sign: str, groups: list[str], marks: str, behind: str, left: str, right: str) -> tuple[str, str] | None:
    """(kind, words) of digit groups and the marks between them, or None.

    ``behind`` follows the last group and must be read with it; ``left`` and
    ``right`` are the characters around.
    """
    if sign:
        point = marks.endswith(".")
        if behind or set(marks[: len(marks) - point]) - {","}:
            return None
        whole = "".join(groups[: len(groups) - point])
        return "money", money_words(sign, whole, groups[-1] if point else "")
    if behind == "%":
        return ("percent", (int_words(groups[0]) if not marks else point_words(*groups)) + " percent") if marks in ("", ".") else None
    if behind[:1].isalpha() and not behind.endswith("m"):
        return ("ordinal", ordinal_words(groups[0])) if not marks else None
    if marks in (":", "::"):
        fits = _in(groups[0], 0, 23) and all(_in(g, 0, 59, (2,)) for g in groups[1:])
        return ("time", clock_words(int(groups[0]), int(groups[1]), behind.strip().upper())) if fits else None
    if behind:
        return None
    if marks == "--" and len(groups[0]) == 4 and _in(groups[1], 1, 12, (2,)) and _in(groups[2], 1, 31, (2,)):
        return "iso_date", date_words(*groups)
    if marks == "//" and _in(groups[0], 1, 12) and _in(groups[1], 1, 31) and len(groups[2]) == 4:
        return "us_date", date_words(groups[2], groups[0], groups[1])
    if marks and set(marks) == {","} and _thousands(groups):
        return "grouped", int_words("".join(groups))
    if marks == "." and left not in "-/" and right not in "-/":  # no part of a range or a fraction
        return "decimal", point_words(*groups)
    if not marks and len(groups[0]) >= 4 and left != "." and right != ".":
        digits = groups[0].lstrip("0")
        return "plain", year_words(int(digits)) if len(digits) == 4 and digits <= "2099" else int_words(digits)
    return None


def _numbers_of(sign: str, run: str, before: str, after: str, nearest: str, beyond: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, words) of the numbers of a run, counted from its first digit.

    ``before`` is the character in front of the sign and the run, ``after`` what
    may be read with it, ``nearest`` the character behind the run and ``beyond``
    the one behind ``after``; all are blank at the ends of a text.
    """
    found, end = [], len(run)
    groups, marks = re.split("[.,:/-]", run), re.sub("[0-9]", "", run)
    stuck = not after and (nearest.isalnum() or nearest == "_")
    starts = [0]
    for g in groups:
        starts.append(starts[-1] + len(g) + 1)
    i = 0
    if not sign and (before.isalnum() or before == "_"):
        i = 1  # the first group belongs to a word
    while i < len(groups):
        run_end = i + 1  # of thousands, or of an amount of money
        while run_end < len(groups) and marks[run_end - 1] == "," and (sign or (len(groups[i]) <= 3 and len(groups[run_end]) == 3)):
            run_end += 1
        for j in range(min(len(groups), max(run_end + 1, i + 3)), i, -1):
            last = j == len(groups)
            stop = starts[j] - 1
            if last and stuck and not sign:
                continue
            begin = starts[i] - len(sign)
            left = run[begin - 1] if i else before
            tries = [(after, end + len(after), beyond), ("", end, nearest)] if last and after.strip()[-1:].lower() == "m" else [(after, end + len(after), beyond)] if last else [("", stop, run[stop])]
            for tail, to, right in tries:
                read = reading(sign, groups[i:j], marks[i : j - 1], tail.lower() if tail != "%" else tail, left, right)
                if read:
                    found.append((begin, to, *read))
                    break
            else:
                continue
            i = j
            break
        else:
            i += 1
        sign = ""
    return found


#: The same runs come again and again in a corpus; long ones are not kept.
_known_numbers, _KEPT = lru_cache(maxsize=1 << 16)(_numbers_of), 40


def numbers_in(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, words) of the numbers of a text."""
    for run in _RUN.finditer(text):
        start, end = run.span()
        at = run.start(2)
        behind = _BEHIND.match(text, end)
        after = behind[0] if behind else ""
        of = _known_numbers if end + len(after) - start <= _KEPT else _numbers_of
        beyond = end + len(after)
        for begin, to, kind, words in of(run[1], run[2], text[start - 1] if start else " ", after, text[end : end + 1] or " ", text[beyond : beyond + 1] or " "):
            yield at + begin, at + to, kind, words


@lru_cache(maxsize=1 << 16)
def say_number(literal: str) -> str:
    """A literal in words; what is no number stays."""
    return spoken(literal)


def spoken(text: str) -> str:
    """A text with its numbers in words."""
    out, at = [], 0
    for start, end, _, words in numbers_in(text):
        out += [text[at:start], words]
        at = end
    return "".join(out) + text[at:]


def verbalize_numbers(docs: DataFrame, text: str = "text") -> DataFrame:
    """Texts with their numbers in words; texts without digits stay in the JVM."""

    @F.pandas_udf("string")
    def said(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else spoken(t))

    digits = F.col(text).rlike("[0-9]")
    return docs.withColumn(text, F.when(digits, said(F.when(digits, F.col(text)))).otherwise(F.col(text)))


def number_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """(``literal``, ``count``, ``kind``, ``words``): the distinct numbers of a corpus, counted per batch before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter((t[s:e], kind, words) for t in batch.column(0).to_pylist() for s, e, kind, words in numbers_in(t))
            literal, kind, words = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(literal, pa.string()), pa.array(kind, pa.string()), pa.array(words, pa.string()), pa.array(found.values(), pa.int64())], ["literal", "kind", "words", "n"])

    counts = docs.filter(F.col(text).rlike("[0-9]")).select(text).mapInArrow(count, "literal string, kind string, words string, n long")
    return counts.groupBy("literal", "kind", "words").agg(F.sum("n").alias("count"))
