"""Best-fit packing by large-item matching.

A document's tokens and its end token are one item; one longer than a sequence
is cut into full sequences after a first piece that may be shorter. Items above
a third of a sequence are large: no three of them fit together, so they are
matched in pairs, longest first, each with the longest that still fits, and
each pair or single opens a sequence. Smaller items, longest first, go where
the least room is left that holds them, and open sequences once nothing does.

All this depends on lengths alone. Items are counted by length, so the plan is
made over at most ``most`` classes of equal items instead of over documents:
sequences that are alike are one group with a number of members, and one step
fills a whole group. A step leaves its group less than half of its room and
splits off two groups at most, so the plan has no more rows than a small
multiple of ``most`` times its logarithm, at any corpus size; it is the only
thing that the driver and every task hold. An item finds its place by its rank
among the items of its length. Ranks come from counts by length and a salt over
the id and content, so a length that many documents share is ranked in parts;
the parts grow in number with the rows.

Defined cases: a null or empty text is an item of the end token; a null id stays
null; rows with equal ids or texts are packed separately; special token strings
in a text become their special id, as in the vocabulary file; a text of any
length gets the ids of the vocabulary file; ties between items of equal length go
by id, place and content; an empty table gives an empty result; extra columns,
whatever their names, are ignored. Result: DOC_PIECES, with ``ids`` if asked for.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.packing import MAX_TOKENS, VOCABULARY, encoder
from folioframe.llm.spread import sliced
from folioframe.session import materialize, table

END = 0
#: Parts in which equal lengths are ranked: at least so many, and one more for each so many items.
PARTS, ITEMS_A_PART = 256, 100_000
DOC_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cuts(n: int, most: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of each piece of ``n`` tokens: the first may be shorter than ``most``."""
    first = n % most
    return ([(0, first)] if first else []) + [(s, most) for s in range(first, n, most)]


@dataclass
class Plan:
    """Where items go, by length and by rank among equal lengths.

    A row says that ``each`` items of ``length`` go into each of the sequences
    from ``sequence`` on, beginning at ``offset``; its items have the ranks from
    ``rank`` on, up to the next row of that length.
    """

    most: int
    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    sequences: int = 0

    def add(self, length: int, rank: int, each: int, sequence: int, offset: int) -> None:
        for column, value in zip((self.length, self.rank, self.each, self.sequence, self.offset), (length, rank, each, sequence, offset), strict=True):
            column.append(value)


def plan(counts: dict[int, int], most: int = MAX_TOKENS) -> Plan:
    """The plan for ``counts`` items of each length (1 to ``most``)."""
    out, taken = Plan(most), dict.fromkeys(counts, 0)
    left = {k: v for k, v in counts.items() if v}
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> groups (first sequence, members)
    order: list[int] = []  # rooms that have groups, ascending

    def put(room: int, sequence: int, members: int) -> None:
        if members and room:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(order, room)
            rooms[room].append((sequence, members))

    def place(length: int, members: int, each: int, sequence: int, offset: int) -> None:
        out.add(length, taken[length], each, sequence, offset)
        taken[length] += members * each
        left[length] -= members * each
        if not left[length]:
            del left[length]

    large = sorted(k for k in left if 3 * k > most)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, most - a) - 1
        b = large[at] if at >= 0 else None
        if b == a:
            members, b = (left[a] // 2, a) if left[a] > 1 else (1, large[at - 1] if at else None)
        else:
            members = left[a] if b is None else min(left[a], left[b])
        if b == a:
            place(a, members, 2, out.sequences, 0)
        else:
            place(a, members, 1, out.sequences, 0)
            if b is not None:
                place(b, members, 1, out.sequences, a)
        put(most - a - (b or 0), out.sequences, members)
        out.sequences += members
        large = [k for k in large if k in left]
    for size in sorted((k for k in left), reverse=True):
        while size in left:
            at = bisect.bisect_left(order, size)
            if at < len(order):
                room = order[at]
                sequence, members = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(at)
            else:
                room, sequence = most, out.sequences
                members = -(-left[size] // (most // size))
                out.sequences += members
            each = room // size
            full = min(members, left[size] // each)
            if full:
                place(size, full, each, sequence, most - room)
                put(room - each * size, sequence, full)
            if full < members and size in left:
                rest = left[size]  # fewer than a sequence takes: one more sequence, and the group's others stay as they are
                place(size, 1, rest, sequence + full, most - room)
                put(room - rest * size, sequence + full, 1)
                full += 1
            put(room, sequence + full, members - full)
    return out


def piece_rows(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", most: int = MAX_TOKENS, vocabulary: str = VOCABULARY, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document, with the tokens themselves if ``with_ids``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in sliced(batches):
            out: list[list] = [[] for _ in range(5)]
            kept = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(value.as_py() or ""), end], "<u4")
                for n, (start, length) in enumerate(cuts(len(ids), most)):
                    part = ids[start : start + length]
                    for column, v in zip(out, (key, n, start, length, zlib.crc32(part.tobytes())), strict=True):
                        column.append(v)
                    if with_ids:
                        kept.append(part.astype("<i4"))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays, names = [pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(cut, DOC_PIECES + (", ids array<int>" if with_ids else ""))


def ranked(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` with ``rank``, from 0, among those of equal ``length``."""
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)))
    sizes = dealt.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("length", "_part", (F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "start", "ids_crc32")) - 1
    return dealt.withColumn("_in", inside).join(before, ["length", "_part"]).withColumn("rank", F.col("_before") + F.col("_in")).drop("_part", "_before", "_in")


def placed(rows: DataFrame, made: Plan) -> DataFrame:
    """Ranked rows with ``sequence_id`` and ``offset``; the plan's bound is in the module's docstring."""
    columns = {k: np.array(getattr(made, k), np.int64) for k in ("length", "rank", "each", "sequence", "offset")}
    by = np.lexsort((columns["rank"], columns["length"]))
    columns = {k: v[by] for k, v in columns.items()}
    names = [c for c in rows.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = np.searchsorted(columns["length"], np.arange(made.most + 2))
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("length", "rank"))
            at = np.empty(len(length), np.int64)
            for k in np.unique(length):
                here = length == k
                at[here] = firsts[k] + np.searchsorted(columns["rank"][firsts[k] : firsts[k + 1]], rank[here], "right") - 1
            nth, place = np.divmod(rank - columns["rank"][at], columns["each"][at])
            found = [pa.array(columns["sequence"][at] + nth), pa.array(columns["offset"][at] + place * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), *found], [*names, "sequence_id", "offset"])

    return rows.mapInArrow(run, rows.select(names).schema.add("sequence_id", "long").add("offset", "long"))


def pack(docs: DataFrame, *, most: int = MAX_TOKENS, parts: int = PARTS, items_a_part: int = ITEMS_A_PART, **options: object) -> DataFrame:
    """Pieces of all documents in as few sequences as best fit finds, equal on reruns.

    Texts are read and encoded once; the pieces are written to the shared folder.
    """
    rows = materialize(piece_rows(docs, most=most, **options), "best-fit-pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # ``most`` rows at most
    keyed = ranked(rows, max(parts, sum(counts.values()) // items_a_part))
    return placed(keyed, plan(counts, most))


def op13_best_fit(spark, sf_dir):
    """Every document in sequences of at most 2048 tokens, cut only where it is longer."""
    return pack(table(spark, sf_dir, "documents"))
