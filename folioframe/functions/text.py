"""Column functions on text; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentence ends: closing punctuation before blanks and an opening, closing punctuation before a line end, or a blank line.
SENTENCE_GAP = r"(?<=[.!?…])\s+(?=[A-Z\"“‘(])|(?<=[.!?…])\s*\n|\n{2,}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it (in lambdas too)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_cuts(units: Column, start: Column, step: Callable[[Column, Column], Column], cut: Callable[[Column, Column], Column], mark: Callable[[Column], Column], kind: str, part: int = 512) -> Column:
    """A fold over an array that notes places: struct ``cuts`` (an array of ``kind``) and ``last`` (the final state).

    ``mark`` of the state is noted before each unit that ``cut`` holds for. Notes
    are kept per part of the units, as appending to one array copies it.
    """
    n_parts = F.greatest(F.ceil(F.size(units) / part).cast("int"), F.lit(1))
    parts = F.transform(F.sequence(F.lit(0), n_parts - 1), lambda k: F.slice(units, k * part + 1, F.lit(part)))
    none = F.array().cast(f"array<{kind}>")
    note = lambda a, u: F.when(cut(a["s"], u), F.concat(a["c"], F.array(mark(a["s"])))).otherwise(a["c"])
    inside = lambda s, us: F.aggregate(us, F.struct(s.alias("s"), none.alias("c")), lambda a, u: F.struct(step(a["s"], u).alias("s"), note(a, u).alias("c")))
    begin = F.struct(start.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("c"))
    return F.aggregate(
        parts, begin, lambda a, us: let(inside(a["s"], us), lambda r: F.struct(r["s"].alias("s"), F.concat(a["c"], F.array(r["c"])).alias("c"))), lambda a: F.struct(F.flatten(a["c"]).alias("cuts"), a["s"].alias("last"))
    )


def count_of(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a non-empty literal."""
    return F.when(F.length(text) > 0, ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")).otherwise(F.lit(0).cast("long"))


def snippet(text: Column, at: Column, length: int, context: int = 60) -> Column:
    """Up to ``context`` characters on each side of a hit at 1-based ``at``, cut ends marked."""
    start = F.greatest(F.lit(1), at - context)
    stop = F.least(F.length(text) + 1, at + length + context)
    cut = F.trim(F.regexp_replace(F.substring(text, start, stop - start), "\n", " "))
    return F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(stop <= F.length(text), "…").otherwise(""))


def all_terms(query: str, hay: Column) -> Column:
    """Every blank-separated term of the query stands in the text; an empty query matches all."""
    terms = query.lower().split()
    return reduce(lambda a, t: a & F.contains(F.lower(hay), F.lit(t)), terms, F.lit(True))


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences."""
    return F.filter(F.transform(F.split(text, SENTENCE_GAP), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def norm_doi(doi: Column) -> Column:
    """Lower case, without resolver address or label."""
    low = F.lower(F.trim(doi))
    for prefix in ("https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/", "doi:"):
        low = F.when(F.startswith(low, F.lit(prefix)), F.substring(low, len(prefix) + 1, 1 << 20)).otherwise(low)
    return F.trim(low)


def norm_isbn(isbn: Column) -> Column:
    """Upper case, without hyphens and blanks."""
    return F.upper(F.regexp_replace(isbn, r"[\s-]", ""))


def valid_isbn(isbn: Column) -> Column:
    """Check digit of a 10- or 13-digit number holds."""
    s = norm_isbn(F.coalesce(isbn, F.lit("")))
    digits = F.split(s, "(?!^)")
    weigh = lambda weight: F.aggregate(
        F.transform(digits, lambda d, i: F.when(d == "X", 10).otherwise(F.coalesce(d.try_cast("int"), F.lit(0))) * weight(i)), F.lit(0), lambda a, x: a + x
    )
    ten = s.rlike("^[0-9]{9}[0-9X]$") & (weigh(lambda i: 10 - i) % 11 == 0)
    thirteen = s.rlike("^[0-9]{13}$") & (weigh(lambda i: F.when(i % 2 == 0, 1).otherwise(3)) % 10 == 0)
    return F.coalesce(ten | thirteen, F.lit(False))


def fmt_duration(seconds: Column) -> Column:
    """``1h 02m``, ``2m 05s`` or ``5s``."""
    s = F.rint(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%dh %02dm", h, m)).when(m > 0, F.format_string("%dm %02ds", m, r)).otherwise(F.format_string("%ds", r))


def fmt_timestamp(seconds: Column, vtt: bool = False) -> Column:
    """``HH:MM:SS,mmm`` (``.mmm`` for captions on the web)."""
    ms = F.greatest(F.rint(seconds * 1000), F.lit(0.0)).cast("long")
    return F.format_string(f"%02d:%02d:%02d{'.' if vtt else ','}%03d", F.floor(ms / 3_600_000), F.floor(ms % 3_600_000 / 60_000), F.floor(ms % 60_000 / 1000), ms % 1000)


def split_tags(raw: Column) -> Column:
    """Tags separated by commas or blanks, without leading signs."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), r"[,\s]+"), lambda t: F.regexp_replace(t, "^#+", "")), lambda t: t != "")


def norm_relation(name: Column) -> Column:
    """Upper case with underscores."""
    return F.regexp_replace(F.upper(F.trim(name)), r"[\s-]+", "_")


def sanitize_name(name: Column) -> Column:
    """A file name without separators and signs that file systems refuse."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(name, r'[\\/:*?"<>|\[\]#^]', " "), r"\s+", " "))
    return F.when(clean == "", "untitled").otherwise(clean)


def parse_ref(ref: Column) -> Column:
    """``archive!member`` split at the first ``!``; member null without one."""
    at = F.instr(ref, "!")
    return F.struct(
        F.when(at > 0, F.substring(ref, F.lit(1), at - 1)).otherwise(ref).alias("archive"),
        F.when(at > 0, F.substring(ref, at + 1, F.length(ref))).alias("member"),
    )


def stable_key(*parts: Column, n: int = 16) -> Column:
    """First digits of a digest of the parts."""
    return F.substring(F.md5(F.concat_ws("\x1f", *parts).cast("binary")), 1, n)


def citation_label(author: Column, year: Column, title: Column, key: Column) -> Column:
    """``Surname (year). Title [key]`` of the parts that are there."""
    first = F.element_at(F.split(F.coalesce(author, F.lit("")), " and "), 1)
    surname = F.trim(F.when(F.contains(first, F.lit(",")), F.element_at(F.split(first, ","), 1)).otherwise(F.element_at(F.split(F.trim(first), r"\s+"), -1)))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.concat_ws(
        " ",
        F.when(surname != "", surname),
        F.when(~blank(year), F.concat(F.lit("("), F.trim(year), F.lit(").")) ),
        F.when(~blank(title), F.trim(title)),
        F.when(~blank(key), F.concat(F.lit("["), key, F.lit("]"))),
    )
