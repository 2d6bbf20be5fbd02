"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct word shingles. Sets that are equal, by two
digests of 64 bits, are one class from the start; the first digest names it, and
classes that share a name get others. Every class carries ``HASHES`` minwise values. In
each of ``trees`` independent trees the classes branch recursively: at a node,
every coordinate is chosen with probability 1 / (threshold * HASHES), by a hash
of the node, and a class descends to one child per chosen coordinate, named by
its minwise value there. Classes with similarity at the threshold thus share
one child per level in expectation. A node of at most ``limit`` classes is
compared exhaustively by one-byte sketches of the minwise values.

Links are confirmed on full sets, in two rounds. In the first, a node emits no
more than a spanning forest of its candidate pairs, best estimates first; a
large node does so block by block, its first class standing in every block.
Confirmed links join classes into components; a further link inside a
component would change nothing. In the second, large nodes that hold more than
``limit`` classes beside their largest component branch on, ``depth`` levels
at most, and nodes that stay large are compared block by block, all pairs of
blocks that hold different components, so none is skipped. As a pair is less
likely to share a node the deeper the nodes are, the classes of such nodes
descend ``deep_trees`` further trees. Members with a
candidate in another component get their full sets, and the node confirms
links itself. So either round emits rows in proportion to a node's members,
not to its pairs.

Defined cases: a null or blank text has an empty set and is linked with
nothing; a text shorter than a shingle is one shingle; rows with equal ids
each count (they are one class); extra columns, whatever their names, are
ignored; texts of any length are read whole; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.spread import join_spread, sliced
from folioframe.llm.words import WORD
from folioframe.operators.components import connected_components
from folioframe.session import discard, forget_shuffles, materialize

WORDS = 5
SIMILARITY = 0.8
HASHES = 128
TREES = 16
#: Further trees for the classes of large nodes, as a pair is less likely to share a node the deeper nodes are.
DEEP_TREES = 8
DEPTH = 6
#: Classes that are compared with each other at once: a node of more costs a row a member, tree and level on its way down.
LIMIT = 1024
#: Parts that a node is counted in.
PARTS = 256
#: A pair whose sketches agree less than this many standard errors below the threshold is no candidate.
ERRORS = 4.0

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: Random values of the bytes, an odd base and its inverse modulo 2^64.
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse; kept, and grown by doubling."""
    if len(_powers[0]) <= n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[k] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, base, np.uint64))])
    return _powers[0], _powers[1]


def word_hashes(text: str | None, part: int = 1 << 18) -> np.ndarray:
    """64-bit hashes of a text's words (the rule of ``words_of``), without making the words.

    A word's hash is a polynomial of its bytes, taken from running sums over a
    part of the text; parts end at blanks.
    """
    data = np.frombuffer(text.encode("utf-8").lower(), np.uint8) if text else np.empty(0, np.uint8)
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + part)
        if end < len(data):
            blanks = np.flatnonzero(_BLANK[data[at:end]])
            while not len(blanks) and end < len(data):  # a word longer than a part
                end = min(len(data), at + 2 * (end - at))
                blanks = np.flatnonzero(_BLANK[data[at:end]])
            end = at + int(blanks[-1]) + 1 if len(blanks) and end < len(data) else end
        chunk = data[at:end]
        solid = np.concatenate([[False], ~_BLANK[chunk], [False]])
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        first, last = edges[::2], edges[1::2]
        up, down = _power(len(chunk))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[chunk] * up[: len(chunk)])])
        found.append(_mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def shingles(text: str | None, k: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    out = np.full(n, np.uint64(min(k, len(h))), np.uint64)
    for i in range(min(k, len(h))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def minwise(sets: np.ndarray) -> np.ndarray:
    """The smallest value of each hash over a non-empty set, 32 bits."""
    best = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    x = (sets >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 512):  # a part's products stay in the cache
        np.minimum(best, (x[None, i : i + 512] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1), out=best)
    return (_mix(best.astype(np.uint64) + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)


def set_rows(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, id_bits: int = 64) -> DataFrame:
    """Per document: ``text_hash``, ``n_shingles``, ``class_id`` and ``class_check`` (digests of the set; null if empty) and the minwise values."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, names, checks, signatures = [], [], [], []
            for value in batch.column(2):
                s = shingles(value.as_py(), words)
                sizes.append(len(s))
                names.append(class_name(s, id_bits))
                checks.append(class_check(s))
                signatures.append(minwise(s).tobytes() if len(s) else None)
            arrays = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(checks, pa.int64()), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "n_shingles", "class_id", "class_check", "signature"])

    schema = "doc_id long, text_hash long, n_shingles long, class_id long, class_check long, signature binary"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text)).mapInArrow(build, schema)


def class_name(s: np.ndarray, bits: int = 64) -> int | None:
    """A set's name: a digest of its sorted members."""
    return (xxhash.xxh3_64_intdigest(s.tobytes()) >> (64 - bits)) - (1 << 63) if len(s) else None


def class_check(s: np.ndarray) -> int | None:
    """Another digest, which tells sets of one name apart."""
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=1) - (1 << 63) if len(s) else None


def _chosen(seed: np.uint64, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The coordinates that a node chooses, and a number for each that names its children."""
    draws = _mix(seed ^ (np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)))
    at = np.flatnonzero(draws < np.uint64(int(2**64 / (threshold * HASHES))))
    return at, draws[at]


def branch(rows: DataFrame, level: int, trees: range, threshold: float) -> DataFrame:
    """Rows (``node``, ``class_id``) one level below (``node``, ``class_id``, ``signature``).

    Level 0 branches every class at the roots of all ``trees``; there ``node`` is
    ignored. A root that chooses no coordinate takes its first.
    """

    def roots() -> tuple[np.ndarray, np.ndarray]:
        found = []
        for tree in trees:
            at, draws = _chosen(np.uint64((tree + 1) * 1_000_003), threshold)
            found.append((at, draws) if len(at) else (np.array([tree % HASHES]), np.array([tree + 1], np.uint64)))
        return np.concatenate([a for a, _ in found]), np.concatenate([d for _, d in found])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = np.uint64(0x9E3779B97F4A7C15)
        for batch in sliced(batches):
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, HASHES).astype(np.uint64)
            if level == 0:
                at, draws = roots()
                child = _mix(draws[None, :] + sig[:, at] * name).view(np.int64).ravel()
                who = np.repeat(ids, len(at))
            else:
                parts, owners = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                node = batch.column(0).to_numpy(zero_copy_only=False)
                for n in np.unique(node):
                    mine = np.flatnonzero(node == n)
                    at, draws = _chosen(np.uint64((int(n) * 31 + level) & 0xFFFFFFFFFFFFFFFF), threshold)
                    parts.append(_mix(draws[None, :] + sig[np.ix_(mine, at)] * name).view(np.int64).ravel())
                    owners.append(np.repeat(ids[mine], len(at)))
                child, who = np.concatenate(parts), np.concatenate(owners)
            yield pa.RecordBatch.from_arrays([pa.array(child, pa.int64()), pa.array(who, pa.int64())], ["node", "class_id"])

    return rows.select("node", "class_id", "signature").mapInArrow(down, "node long, class_id long")


SMALL = 48


def near_pairs(comp: np.ndarray, sizes: np.ndarray, side: np.ndarray, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (i, j, estimate) of a group: members of different
    components that may be linked, of either side where there are two sides.
    There may be a million, so they take twelve bytes each."""
    least = threshold - ERRORS * np.sqrt(threshold * (1 - threshold) / HASHES)
    n = len(comp)
    apart = side.any() and not side.all()
    if n <= SMALL:
        at = np.arange(n)
        meet = (side[:, None] < side[None, :]) if apart else (at[:, None] < at[None, :])
        meet &= (comp[:, None] != comp[None, :]) & (np.minimum(sizes[:, None], sizes[None, :]) >= threshold * np.maximum(sizes[:, None], sizes[None, :]) - 1e-9)
        i, j = np.nonzero(meet)
        e = (sketch[i] == sketch[j]).mean(axis=1) if len(i) else np.empty(0)
        return i[e >= least].astype(np.int32), j[e >= least].astype(np.int32), e[e >= least].astype(np.float32)
    left = (np.flatnonzero(side == 0) if apart else np.arange(n)).astype(np.int32)
    right = np.flatnonzero(side == 1).astype(np.int32) if apart else None
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in left:
        to = right if apart else np.arange(i + 1, n, dtype=np.int32)
        to = to[(comp[to] != comp[i]) & (np.minimum(sizes[to], sizes[i]) >= threshold * np.maximum(sizes[to], sizes[i]) - 1e-9)]
        if len(to):
            e = (sketch[to] == sketch[i]).mean(axis=1)
            near = e >= least
            found.append((np.full(int(near.sum()), i, np.int32), to[near], e[near].astype(np.float32)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.float32))


class Union:
    """Sets of components that grow together."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether they were apart."""
        a, b = self.root(a), self.root(b)
        self.parent[b] = a
        return a != b


def groups_in(batches: Iterator[pa.RecordBatch], n_numbers: int) -> Iterator[list]:
    """Sorted runs of equal first three columns as lists of columns.

    The first ``n_numbers`` columns become arrays, the next (the sketches) a
    matrix; lists and sets after it become lists of arrays. A run that a batch
    cuts is carried to the next; runs of one row are passed over.
    """
    held: list | None = None

    def arrays(column: pa.Array) -> list[np.ndarray]:
        if pa.types.is_list(column.type):
            flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            return [flat[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]
        return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]

    for batch in batches:
        if not batch.num_rows:
            continue
        cols: list = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_numbers)]
        cols.append(np.frombuffer(b"".join(batch.column(n_numbers).to_pylist()), np.uint8).reshape(-1, HASHES))
        cols += [arrays(batch.column(i)) for i in range(n_numbers + 1, batch.num_columns)]
        if held is not None:
            cols = [h + c if isinstance(c, list) else np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        change = (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        held = [c[starts[-1] :] for c in cols]
        ends = starts[1:]
        for s, e in zip(starts[:-1][ends - starts[:-1] > 1], ends[ends - starts[:-1] > 1], strict=True):
            yield [c[s:e] for c in cols]
    if held is not None and len(held[0]) > 1:
        yield held


def first_common(a: np.ndarray, b: np.ndarray) -> int:
    """The smallest node that both lists hold."""
    return min(set(a.tolist()) & set(b.tolist()))


KEYS = ["node", "p", "q"]


def sorted_groups(groups: DataFrame, *columns: str) -> DataFrame:
    return groups.select(*KEYS, *columns).repartition(*KEYS).sortWithinPartitions(*KEYS)


def forests(groups: DataFrame, threshold: float) -> DataFrame:
    """Pairs (``a`` < ``b``): per group a spanning forest of its candidate pairs, best estimates first."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, ids, comp, sizes, side, sketch in groups_in(batches, 7):
            if (comp == comp[0]).all():
                continue
            i_, j_, e = near_pairs(comp, sizes, side, sketch, threshold)
            if not len(e):
                continue
            order = np.argsort(-e, kind="stable")
            union = Union()
            out = [tuple(sorted((int(ids[i]), int(ids[j])))) for i, j in zip(i_[order], j_[order], strict=True) if union.join(int(comp[i]), int(comp[j]))]
            a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return sorted_groups(groups, "class_id", "component", "n_shingles", "side", "sketch").mapInArrow(compare, "a long, b long").distinct()


def hopeful(groups: DataFrame, threshold: float) -> DataFrame:
    """The members of each group that have a candidate in it: rows (``node``, ``p``, ``q``, ``class_id``, ``side``).

    A pair that meets in several nodes is a candidate in the first of them
    only. One row per member at most, whatever the number of pairs.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, p, q, ids, comp, sizes, side, sketch, nodes in groups_in(batches, 7):
            if (comp == comp[0]).all():
                continue
            i_, j_, _ = near_pairs(comp, sizes, side, sketch, threshold)
            keep = np.zeros(len(ids), bool)
            for i, j in zip(i_, j_, strict=True):  # as lists they would take five times the memory
                if not (keep[i] and keep[j]) and first_common(nodes[i], nodes[j]) == node[0]:
                    keep[i] = keep[j] = True
            if not keep.any():
                continue
            n = int(keep.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[:n], pa.int64()), pa.array(p[:n], pa.int64()), pa.array(q[:n], pa.int64()), pa.array(ids[keep], pa.int64()), pa.array(side[keep], pa.int32())], [*KEYS, "class_id", "side"]
            )

    rows = sorted_groups(groups, "class_id", "component", "n_shingles", "side", "sketch", "nodes")
    return rows.mapInArrow(compare, "node long, p long, q long, class_id long, side int")


def confirmed_inside(groups: DataFrame, threshold: float, percent: int) -> DataFrame:
    """Links (``a`` < ``b``) confirmed on the full sets of a group's members: a forest that joins all it can.

    Candidates are tried best estimates first; a pair whose components are
    joined by then is not tried, for its link would change nothing.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, _, _, ids, comp, sizes, side, sketch, nodes, full in groups_in(batches, 7):
            i_, j_, e = near_pairs(comp, sizes, side, sketch, threshold)
            union, out = Union(), []
            for k in np.argsort(-e, kind="stable"):
                i, j = int(i_[k]), int(j_[k])
                if union.root(int(comp[i])) == union.root(int(comp[j])) or first_common(nodes[i], nodes[j]) != node[0]:
                    continue
                shared = len(np.intersect1d(full[i], full[j], assume_unique=True))
                if 100 * shared >= percent * (len(full[i]) + len(full[j]) - shared):
                    union.join(int(comp[i]), int(comp[j]))
                    out.append(tuple(sorted((int(ids[i]), int(ids[j])))))
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = sorted_groups(groups, "class_id", "component", "n_shingles", "side", "sketch", "nodes", "full")
    return rows.mapInArrow(compare, "a long, b long").distinct()


def full_sets(texts: DataFrame, words: int) -> DataFrame:
    """(``class_id``, ``full``) of texts (``class_id``, ``class_check``, ``text``); a text that is not the class's own is left out."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, out = [], []
            for c, check, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = shingles(value.as_py(), words)
                if class_check(s) == check:
                    ids.append(c)
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["class_id", "full"])

    return texts.select("class_id", "class_check", "text").mapInArrow(build, "class_id long, full binary").dropDuplicates(["class_id"])


def first_groups(nodes: DataFrame, limit: int) -> DataFrame:
    """Every small node, and every block of a large one together with the node's first class.

    ``nodes`` has (``node``, ``count``, ``first``, ``class_id``).
    """
    blocks = F.ceil(F.col("count") / limit).cast("long")
    mine = nodes.select("node", F.pmod(F.xxhash64("class_id"), blocks).alias("p"), "class_id")
    lead = nodes.filter((F.col("count") > limit) & (F.col("first") == F.col("class_id")))
    leads = lead.select("node", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("p"), "class_id")
    return mine.unionByName(leads).distinct().select("node", "p", F.col("p").alias("q"), "class_id", F.lit(0).alias("side"))


def second_groups(nodes: DataFrame, limit: int) -> DataFrame:
    """Pairs of blocks that hold more than one component. ``nodes`` has ``component`` too.

    A component that fills more than half a block of a large node has blocks of
    its own; pairs of these need no comparison. The other classes get as many
    blocks as they alone fill, so that few classes beside a large component meet
    each of its blocks once.
    """
    sizes = nodes.filter(F.col("count") > limit).groupBy("node", "component").agg(F.count(F.lit(1)).alias("here"))
    own = sizes.filter(F.col("here") > limit / 2).groupBy("node").agg(F.sum("here").alias("own"))
    sizes = join_spread(sizes, own, ["node"], "component", how="left")
    placed = nodes.join(sizes, ["node", "component"], "left")
    rest = F.greatest(F.ceil((F.col("count") - F.coalesce("own", F.lit(0))) / limit).cast("long"), F.lit(1))
    apart = F.xxhash64("component", F.pmod(F.xxhash64("class_id"), F.ceil(F.col("here") / limit).cast("long")))
    block = F.when(F.col("count") <= limit, F.lit(0).cast("long")).when(F.col("here") > limit / 2, apart).otherwise(F.pmod(F.xxhash64("component"), rest))
    placed = placed.select("node", block.alias("block"), "class_id", "component")
    blocks = placed.groupBy("node", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    x, y = blocks.alias("x"), blocks.alias("y")
    mixed = ~((F.col("x.lo") == F.col("x.hi")) & (F.col("y.lo") == F.col("y.hi")) & (F.col("x.lo") == F.col("y.lo")))
    met = x.join(y, (F.col("x.node") == F.col("y.node")) & (F.col("x.block") <= F.col("y.block")) & mixed).select("x.node", F.col("x.block").alias("p"), F.col("y.block").alias("q"))
    ends = met.select("*", F.explode(F.when(F.col("p") == F.col("q"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side")).withColumn("block", F.when(F.col("side") == 0, F.col("p")).otherwise(F.col("q")))
    return placed.drop("component").join(ends, ["node", "block"]).select("node", "p", "q", "class_id", "side")


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the similarity.

    ``texts`` has (``class_id``, ``class_check``, ``text``); where rows of one id
    hold several texts, only the one whose set is the class's own counts.
    """
    side = lambda x: texts.select(F.col("class_id").alias(x), F.col("class_check").alias(f"check_{x}"), F.col("text").alias(f"text_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "check_a", "check_b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None, None)
        for batch in batches:
            ok = []
            for a, check_a, check_b, text_a, text_b in zip(*(batch.column(i) for i in (0, 2, 3, 4, 5)), strict=True):
                a, text_a = a.as_py(), text_a.as_py()
                if last[:2] != (a, text_a):
                    last = a, text_a, shingles(text_a, words)
                x, y = last[2], shingles(text_b.as_py(), words)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(class_check(x) == check_a.as_py() and class_check(y) == check_b.as_py() and 100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    trees: int = TREES,
    deep_trees: int = DEEP_TREES,
    depth: int = DEPTH,
    limit: int = LIMIT,
    id_bits: int = 64,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``text_hash``, ``n_shingles``, ``component_id``, ``kept``."""
    percent = round(100 * similarity)
    rows = materialize(set_rows(docs, doc_id=doc_id, text=text, words=words, id_bits=id_bits), "neardup-sets")
    classes = rows.filter("class_id is not null and doc_id is not null").groupBy("class_id", "class_check").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = materialize(classes, "neardup-classes")
    twins = materialize(classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("class_id", F.lit(True).alias("_twin")), "neardup-twins")
    if not twins.isEmpty():  # different sets of one name get names of both digests
        other = F.when(F.col("_twin"), F.xxhash64("class_id", "class_check")).otherwise(F.col("class_id"))
        renamed = lambda f: f.join(twins, "class_id", "left").withColumn("class_id", other).drop("_twin")
        rows, classes = materialize(renamed(rows), "neardup-sets"), materialize(renamed(classes), "neardup-classes")

    def nodes_at(level: int, frontier: DataFrame, of_trees: range) -> DataFrame:
        """(``node``, ``part``, ``class_id``, ``count``, ``first``) of the nodes of more than one class.

        A node is counted by parts first, and the counts go back to the parts, so a
        node that holds a third of all classes is never in one task.
        """
        here = branch(frontier, level, of_trees, similarity).withColumn("part", F.pmod(F.xxhash64("class_id"), F.lit(PARTS)).cast("int"))
        here = materialize(here, "neardup-level")
        parts = here.groupBy("node", "part").agg(F.count(F.lit(1)).alias("n"), F.min("class_id").alias("first"))
        counts = parts.groupBy("node").agg(F.sum("n").alias("count"), F.min("first").alias("first")).filter("count > 1")
        found = materialize(here.join(parts.select("node", "part").join(counts, "node"), ["node", "part"]).select("node", "part", "class_id", "count", "first"), "neardup-nodes")
        discard(here)
        forget_shuffles(docs.sparkSession)
        return found

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            low = [np.frombuffer(s, np.uint32).astype(np.uint8).tobytes() for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(low, pa.binary())], ["class_id", "n_shingles", "sketch"])

    at_roots = lambda of: of.select(F.lit(0).cast("long").alias("node"), "class_id", "signature")
    top = nodes_at(0, at_roots(classes), range(trees))
    drawn = classes.join(top.select("class_id").distinct(), "class_id", "left_semi").select("class_id", "n_shingles", "signature").mapInArrow(sketches, "class_id long, n_shingles long, sketch binary")
    drawn = materialize(drawn, "neardup-sketches")
    texts = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("class_id")).union(pairs.select("b")).distinct().join(classes.select("class_id", "class_check", "rep"), "class_id")
        return materialize(confirm(pairs, texts.join(ends, "rep").select("class_id", "class_check", "text"), words, percent).distinct(), "neardup-links")

    def component_of(links: DataFrame, ids: DataFrame) -> DataFrame:
        found = connected_components(links, "a", "b").select(F.col("node").alias("class_id"), "component")
        return ids.join(found, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))

    groups = first_groups(top, limit).join(drawn.withColumn("component", F.col("class_id")), "class_id")
    links = confirmed(materialize(forests(groups, similarity), "neardup-pairs"))
    now = materialize(component_of(links, drawn), "neardup-now")
    forget_shuffles(docs.sparkSession)

    def still_large(of: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of large nodes with several components, those with few classes beside the largest one, and the others."""
        held = of.join(now.select("class_id", "component"), "class_id").groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"))
        names = held.groupBy("node").agg(F.sum("n").alias("n"), F.max("n").alias("most")).filter("most < n").select("node", (F.col("n") - F.col("most")).alias("others"))
        #: a row meets one other, by the node's parts again
        found = materialize(of.join(of.select("node", "part").distinct().join(names, "node"), ["node", "part"]), "neardup-large")
        return found.filter(F.col("others") <= limit).drop("others"), found.filter(F.col("others") > limit).drop("others")

    few, large = still_large(top.filter(F.col("count") > limit))
    leaves, level = [top.filter(F.col("count") <= limit), few], 1
    if not large.isEmpty():
        deeper = classes.join(large.select("class_id").distinct(), "class_id", "left_semi")
        more = nodes_at(0, at_roots(deeper), range(trees, trees + deep_trees))
        few, others = still_large(more.filter(F.col("count") > limit))
        leaves += [more.filter(F.col("count") <= limit), few]
        large = large.unionByName(others)
    while not large.isEmpty():
        if level == depth:
            leaves.append(large)
            break
        below = nodes_at(level, large.join(classes.select("class_id", "signature"), "class_id").select("node", "class_id", "signature"), range(0))
        few, large = still_large(below.filter(F.col("count") > limit))
        leaves += [below.filter(F.col("count") <= limit), few]
        level += 1
    nodes = leaves[0]
    for more in leaves[1:]:
        nodes = nodes.unionByName(more)
    met = second_groups(nodes.join(now.select("class_id", "component"), "class_id"), limit)
    places = nodes.groupBy("class_id").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    known = materialize(now.join(places, "class_id"), "neardup-known")
    members = materialize(hopeful(met.join(known, "class_id"), similarity), "neardup-members")
    forget_shuffles(docs.sparkSession)
    ends = members.select("class_id").distinct().join(classes.select("class_id", "class_check", "rep"), "class_id")
    sets = full_sets(texts.join(ends, "rep"), words)
    links = links.unionByName(materialize(confirmed_inside(members.join(known.join(sets, "class_id"), "class_id"), similarity, percent), "neardup-links"))

    whole = component_of(links, classes.select("class_id", "rep"))
    names = whole.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = whole.join(names, "component").select("class_id", "component_id")
    #: rows without words get keys that match nothing and spread evenly
    keyed = rows.select("doc_id", "text_hash", "n_shingles", F.coalesce("class_id", F.xxhash64("doc_id", "text_hash")).alias("class_id"))
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return keyed.join(named, "class_id", "left").select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """The rows of ``docs`` with one of each component kept: the smallest id.

    Rows without words, and rows without an id, all stay.
    """
    found = near_duplicates(docs, doc_id=doc_id, text=text, **options)
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    #: one row of each component, even where rows of equal id repeat
    chosen = found.filter(F.col("kept") & ~alone).groupBy("component_id").agg(F.min("text_hash").alias("text_hash")).select(F.col("component_id").alias("_nd_id"), F.col("text_hash").alias("_nd_hash"))
    keyed = docs.withColumns({"_nd_id": F.col(doc_id).cast("long"), "_nd_hash": F.xxhash64(F.col(text))})
    blank = F.col("_nd_id").isNull() | F.coalesce(~F.col(text).rlike(WORD), F.lit(True))
    kept = keyed.filter(~blank).join(chosen, ["_nd_id", "_nd_hash"], "left_semi")
    return kept.dropDuplicates(["_nd_id", "_nd_hash"]).select(*docs.columns).unionByName(keyed.filter(blank).select(*docs.columns))


def op3_near_duplicates(spark, sf_dir):
    """Components of documents whose three-word shingle sets are 85 % alike."""
    from folioframe.session import table

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, similarity=0.85).drop("text_hash")
