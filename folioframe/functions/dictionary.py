"""Dictionaries as tables: all terms are found in one pass over a text.

A dictionary is a DataFrame of ``term`` and ``spoken``, and if it has them
``custom`` (goes before the others) and ``fold`` (found whatever its case). Its
terms become a table of words and, where they have other forms, one automaton for
exact and one for folded terms, built once per Python worker. A dictionary is
bounded: one of more than ``MOST`` rows raises.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 1_000_000
HIT = "text string, hits array<struct<term:string,n:int>>"
_BUILT: dict[str, Finder] = {}


def _folded(text: str) -> str:
    """Lower case, place by place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _in_word(c: str) -> bool:
    return c == "_" or c.isalnum()


#: What ``_in_word`` calls a word, as a pattern.
_WORDS = re.compile(r"(\w+)")


class Finder:
    """Finds and replaces the terms of (term, spoken, custom, fold) rows; of equal terms a custom one counts, else the first.

    A term that is one word can stand only where a word of the text equals it,
    so it is looked up per word; terms of other forms are sought by automata.
    """

    def __init__(self, rows: list[tuple[str, str, bool, bool]]):
        import ahocorasick

        self.words: list[tuple[bool, dict[str, tuple[int, str, str, bool]]]] = []
        self.automata = []
        for fold in (False, True):
            terms: dict[str, tuple[str, str, bool]] = {}
            for term, spoken, custom, folds in sorted(rows, key=lambda r: not r[2]):
                if term and folds == fold:
                    terms.setdefault(_folded(term) if fold else term, (term, spoken, custom))
            words = {k: (len(k), *v) for k, v in terms.items() if _WORDS.fullmatch(k)}
            if words:
                self.words.append((fold, words))
            if len(words) < len(terms):
                automaton = ahocorasick.Automaton()
                for key, (term, spoken, custom) in terms.items():
                    if key not in words:
                        automaton.add_word(key, (len(key), term, spoken, custom))
                automaton.make_automaton()
                self.automata.append((fold, automaton))

    def _word(self, word: str) -> tuple[str, str] | None:
        """(term, spoken) of a word of the text: a custom term first."""
        if len(self.words) == 1 and not self.words[0][0]:
            hit = self.words[0][1].get(word)
            return hit and hit[1:3]
        found = [w for fold, words in self.words if (w := words.get(_folded(word) if fold else word))]
        return min((not custom, term, spoken) for _, term, spoken, custom in found)[1:] if found else None

    def matches(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, term, spoken) of whole-word terms in order: custom ones first, then longer ones, then those in front; none overlap."""
        found = []
        for fold, words in self.words:
            for m in _WORDS.finditer(_folded(text) if fold else text):
                if hit := words.get(m[0]):
                    size, term, spoken, custom = hit
                    found.append((not custom, -size, *m.span(), term, spoken))
        for fold, automaton in self.automata:
            for last, (size, term, spoken, custom) in automaton.iter(_folded(text) if fold else text):
                start, end = last + 1 - size, last + 1
                if not (start and _in_word(text[start - 1])) and not (end < len(text) and _in_word(text[end])):
                    found.append((not custom, -size, start, end, term, spoken))
        taken, out = bytearray(len(text)), []
        for _, size, start, end, term, spoken in sorted(found):
            if taken.find(1, start, end) < 0:
                taken[start:end] = b"\x01" * -size
                out.append((start, end, term, spoken))
        return sorted(out)

    def replaced(self, text: str) -> tuple[str, list[tuple[str, int]]]:
        if not self.automata:  # words don't overlap: the text is taken apart once
            parts = _WORDS.split(text)
            counts = Counter(parts[1::2])
            found = {w: hit for w in counts if (hit := self._word(w))}
            parts[1::2] = [found[w][1] if w in found else w for w in parts[1::2]]
            hits = Counter()
            for w, (term, _) in found.items():
                hits[term] += counts[w]
            return "".join(parts), sorted(hits.items())
        parts, at, hits = [], 0, Counter()
        for start, end, term, spoken in self.matches(text):
            parts += (text[at:start], spoken)
            at = end
            hits[term] += 1
        return "".join([*parts, text[at:]]), sorted(hits.items())


def apply_dictionary(docs: DataFrame, dictionary: DataFrame, *, text: str = "text", most: int = MOST) -> DataFrame:
    """``docs`` with terms replaced and ``hits``, how often each was; a null text stays null and has none.

    What was put in is not looked at again.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in dictionary.columns else F.lit(False)
    rows = [tuple(r) for r in dictionary.filter("term is not null").select("term", F.coalesce("spoken", F.lit("")), flag("custom"), flag("fold")).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a dictionary holds {most} terms at most")
    shared, name = docs.sparkSession.sparkContext.broadcast(sorted(rows)), uuid.uuid4().hex

    @F.arrow_udf(HIT)
    def replace(texts: pa.Array) -> pa.Array:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Finder(shared.value)
        said, ends, terms, counts = [], [0], [], []
        for t in texts:  # hits go out as flat columns, not as an object each
            new, hits = (None, ()) if not t.is_valid else _BUILT[name].replaced(t.as_py())
            said.append(new)
            terms += [k for k, _ in hits]
            counts += [n for _, n in hits]
            ends.append(len(terms))
        flat = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int32())], ["term", "n"])
        return pa.StructArray.from_arrays([pa.array(said, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["text", "hits"])

    #: so called, it is run once per text, and no filter on hits runs it again in front
    replace = replace.asNondeterministic()
    return docs.withColumn("_said", replace(F.col(text))).withColumn(text, F.col("_said.text")).withColumn("hits", F.coalesce("_said.hits", F.array().cast("array<struct<term:string,n:int>>"))).drop("_said")


def rule_hits(applied: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(``by``, ``term``, ``hits``, ``docs``): how often each term was replaced, and in how many documents."""
    rows = applied.select(*by, F.explode("hits").alias("h"))
    return rows.groupBy(*by, F.col("h.term").alias("term")).agg(F.sum("h.n").alias("hits"), F.count(F.lit(1)).alias("docs"))
