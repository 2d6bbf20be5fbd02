"""Joins and groups where one key may hold a large share of all rows, and batches where a row may make many."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 256
#: Rows of a batch that a Python step takes at once.
SLICE = 512


def join_spread(rows: DataFrame, lookup: DataFrame, keys: list[str], by: str, *, salts: int = SALTS, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``lookup`` on ``keys``, dealt out by the keys and a salt of the column ``by``.

    ``lookup`` has few rows per key. Its rows go to those salts that the key's
    rows have, ``salts`` at most, so that no task gets more than a fraction of a
    key. ``rows`` is read twice; write it before.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    wanted = salted.select(*keys, "_salt").distinct()
    return salted.join(lookup.join(wanted, keys), [*keys, "_salt"], how).drop("_salt")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """``batches`` in slices of at most ``rows`` rows.

    What a step makes of a slice leaves Python before the next one, so that a
    worker, which keeps its peak, and Spark's readers hold that much and not what
    ten thousand texts make.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
