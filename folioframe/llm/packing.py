"""Packing by power-of-two decomposition.

A document's tokens are cut into as many full sequences as fit and then into
pieces whose lengths are the powers of two in what remains, longest first.
Every piece is a sequence of its own: no sequence crosses documents and none
needs padding. Pieces of equal length form a bucket; a salt by content splits
a bucket over tasks, and pieces are numbered inside (length, salt).

Defined cases: a null or empty text is one piece holding the end token; a null
id stays null; rows with equal ids or texts are packed separately; special token
strings in a text become their special id, as in the vocabulary file; a text of
any length, of one run of blanks too, gets the ids of the vocabulary file; an
empty table gives an empty result; extra columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_TOKENS = 2048
END = 1
SALTS = 1024
#: Pieces leave Python in batches of about so many tokens, however long a batch of documents is.
BATCH_TOKENS = 1 << 18
VOCABULARY = "byte_bpe_50k"


@lru_cache(maxsize=2)
def encoder(name: str = VOCABULARY):
    """A function from texts to lists of ids.

    The vocabulary's rank file gives the same ids as its json file several
    times faster; a test holds the two against each other. Its splitting of a
    text gives up on runs of about a million blanks; such a text goes to the
    json file.
    """
    import public_tokenizers
    import tiktoken
    import tokenizers

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {"<|endoftext|>": len(ranks)}
    enc = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    slower: list[tokenizers.Tokenizer] = []

    def encode(text: str) -> list[int]:
        try:
            return enc.encode(text, allowed_special="all")
        except ValueError:  # the pattern's stack is exhausted
            if not slower:
                slower.append(tokenizers.Tokenizer.from_file(public_tokenizers.path(f"{name}.json")))
            return slower[0].encode(text, add_special_tokens=False).ids

    return encode


def pieces(n: int, most: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of each piece of ``n`` tokens; ``most`` is a power of two."""
    found = [(i * most, most) for i in range(n // most)]
    start = n // most * most
    for bit in range(most.bit_length() - 2, -1, -1):
        if n & (1 << bit):
            found.append((start, 1 << bit))
            start += 1 << bit
    return found


def piece_rows(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", most: int = MAX_TOKENS, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """One row per piece, with the tokens themselves if ``with_ids``."""

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def made(out: list[list[int]], kept: list[np.ndarray]) -> pa.RecordBatch:
        arrays = [pa.array(v, pa.int64()) for v in out]
        if with_ids:
            ends = np.cumsum([0, *out[names.index("length")]], dtype=np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept))))
        return pa.RecordBatch.from_arrays(arrays, [*names, "ids"] if with_ids else names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            out, kept, held = [[] for _ in names], [], 0
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                key, ids = key.as_py(), np.array([*encode(value.as_py() or ""), END], "<u4")
                for start, length in pieces(len(ids), most):
                    for column, v in zip(out, (key, start, length, zlib.crc32(ids[start : start + length]), len(ids)), strict=True):
                        column.append(v)
                if with_ids:
                    kept.append(ids.astype("<i4"))
                held += len(ids)
                if held >= BATCH_TOKENS:
                    yield made(out, kept)
                    out, kept, held = [[] for _ in names], [], 0
            if held:
                yield made(out, kept)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(cut, schema)


def pack(docs: DataFrame, *, salts: int = SALTS, **options: object) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; ids are equal on reruns."""
    rows = piece_rows(docs, **options).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "ids_crc32", "start"), F.lit(salts)))
    bucket = F.log2("length").cast("long") * salts + F.col("_salt")
    number = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    return rows.withColumn("sequence_id", bucket * F.lit(1 << 40) + number).withColumn("offset", F.lit(0).cast("long")).drop("_salt")


def op8_pack_power_of_two(spark, sf_dir):
    """Every document cut and packed into sequences of at most 2048 tokens."""
    from folioframe.session import table

    return pack(table(spark, sf_dir, "documents"))
