"""Text normalisation: lexicons, abbreviations and numbers in words; numbers and markup are read in their own modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.markup import strip_markdown, wiki_rule_hits, wiki_to_markdown
from folioframe.functions.numbers import number_table, say_number, verbalize_numbers

__all__ = ["apply_lexicon", "expand_abbreviations", "normalize_corpus", "number_table", "say_number", "strip_markdown", "verbalize_numbers", "wiki_rule_hits", "wiki_to_markdown"]


def _quoted(term: str) -> str:
    return "".join("\\" + c if not c.isalnum() and not c.isspace() and ord(c) < 128 else c for c in term)


def expand_abbreviations(text: Column, builtin: dict[str, str], custom: dict[str, str] | None = None) -> Column:
    """Abbreviations written out: custom ones before built-in ones, the longest first."""
    for table in (custom or {}, builtin):
        for short in sorted(table, key=lambda k: (-len(k), k)):
            text = F.regexp_replace(text, rf"(?U)(?<!\w){_quoted(short)}(?!\w)", table[short].replace("\\", "\\\\").replace("$", "\\$"))
    return text


def apply_lexicon(text: Column, lexicon: dict[str, str]) -> Column:
    """Whole words replaced by their spoken form, whatever their case."""
    for word in sorted(lexicon, key=lambda k: (-len(k), k)):
        text = F.regexp_replace(text, rf"(?iU)(?<!\w){_quoted(word)}(?!\w)", lexicon[word].replace("\\", "\\\\").replace("$", "\\$"))
    return text


def normalize_corpus(docs: DataFrame, *, lexicon: dict[str, str] | None = None, abbreviations: dict[str, str] | None = None, numbers: bool = True, text: str = "text") -> DataFrame:
    """Lexicon, then abbreviations, then numbers, each on demand; ``changed`` tells whether a text differs."""
    before = docs.withColumn("_before", F.col(text))
    if lexicon:
        before = before.withColumn(text, apply_lexicon(F.col(text), lexicon))
    if abbreviations:
        before = before.withColumn(text, expand_abbreviations(F.col(text), abbreviations))
    if numbers:
        before = verbalize_numbers(before, text)
    return before.withColumn("changed", ~F.col(text).eqNullSafe(F.col("_before"))).drop("_before")
