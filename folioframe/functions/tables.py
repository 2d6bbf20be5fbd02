"""Extractors as table functions, for SQL that uses them laterally. Rows travel as Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from folioframe.operators.mining import CAP_PHRASE
from folioframe.sources.files import _Blocks

_NAME = re.compile(CAP_PHRASE)


@udtf(returnType="seq int, kind string, level int, text string, href string", useArrow=True)
class PageBlocks:
    """The blocks of a page, as ``page_blocks`` has them."""

    def eval(self, html: str) -> Iterator[tuple]:
        for n, row in enumerate(_Blocks().read(html or "")):
            yield (n, *row)


@udtf(returnType="start int, end int, text string", useArrow=True)
class ConceptSpans:
    """The names of ``concept_spans`` in a text: capitalised words that open no sentence."""

    def eval(self, text: str) -> Iterator[tuple]:
        at = 0
        for m in _NAME.finditer(text or ""):
            gap = text[at : m.start()].rstrip(" \t")
            if gap[-1:] not in (".", "!", "?", "\n") and (gap or at):
                yield m.start(), m.end(), m[0]
            at = m.end()


def register_tables(spark: SparkSession) -> None:
    """Makes ``page_blocks_of(html)`` and ``concepts_of(text)`` known to SQL."""
    spark.udtf.register("page_blocks_of", PageBlocks)
    spark.udtf.register("concepts_of", ConceptSpans)
