"""Word rules shared by the operators: runs of anything but space, tab to carriage return."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words (null text: 0), without leaving the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def words_of(text: str | None) -> list[bytes]:
    """The words as UTF-8 bytes with A-Z lower-cased; ``bytes.lower`` and
    ``bytes.split`` know only ASCII letters and the six ASCII blanks, which is
    the same rule as ``WORD``."""
    return text.encode("utf-8").lower().split() if text else []


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n`` (null id: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))
