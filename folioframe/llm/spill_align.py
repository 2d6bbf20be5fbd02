"""Cross-tokenizer alignment by external spill counting.

Two tokenizers cut the same bytes. Where a token of each ends at the same byte,
the bytes before it are a group; tokens of the two sides that share a group are
linked. How often an id pair is linked is counted in documents over the corpus,
and every document gets back what its links count.

* Pair-document records are radix-partitioned by the first side's id and spilled
  as runs: sorted, in zstd chunks, one run per block of documents and radix. A
  run names each pair once, with the block's documents that hold it, so a pair
  that all documents hold is one entry a block.
* Runs of up to ``FAN`` groups are merged into one: a heap holds the runs by the
  last pair of the chunk that each has open, and what no other run can still
  precede is summed. Levels of merges follow until a radix has one run; its pairs
  are bounded by the two vocabularies, whatever the corpus.
* The last run is in first-side order, so an id's pairs stand together and its
  highest count is known when they end. Totals and marks then go back down the
  same levels, each group taking those of its own pairs, and at the bottom the
  blocks' records turn them into sums per document.

Each level's runs and answers are written to the shared folder; a lost executor
costs the tasks that it ran. No task holds more than a block, or one open chunk of
each of ``FAN`` runs with the runs in compressed form.

Defined cases: a null or empty text, and one that either tokenizer does not give
back byte by byte, has no tokens (zeros, an empty digest); special token
strings in a text are plain text; a null id stays null; rows with equal ids or
texts are documents of their own and count separately; ties for an id's highest
count are all best; an empty table gives an empty result; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.lm import pack, unpack
from folioframe.session import discard, materialize, table

FIRST, SECOND = "byte_bpe_50k", "piece_bpe_32k"
#: A power of two; ids of the first side are dealt by their low bits.
RADIX = 64
#: Runs that a merge reads at most, on average.
FAN = 256
#: A block ends with the document that brings it to so many records or documents.
BLOCK_RECORDS, BLOCK_DOCS = 1 << 20, 1 << 15
CHUNK = 1 << 14
#: Bits of an id and of a document's place in its block; a record is one number.
ID_BITS, PLACE_BITS = 20, 16
#: Pairs of a group that are made one by one; larger groups go by distinct ids.
PLAIN_PAIRS = 1 << 16

DIGEST = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
SPILLED = f"block long, place int, doc_id long, {DIGEST}, radix int, keys array<binary>, holders array<binary>"
RUN = "radix int, node long, keys array<binary>"
ANSWER = "radix int, node long, answers array<binary>"
SUMS = "block long, sums binary, best binary"
RESULT = f"doc_id long, {DIGEST}, n_best long, count_sum long"


class Side:
    """A tokenizer with the byte length and the written id of each of its tokens."""

    def __init__(self, encode: Callable[[str], list[int]], tokens: list[bytes], ends: str):
        self.encode, self.tokens = encode, tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.more, self.last = (np.array([f"{i}{c}" for i in range(len(tokens))], object) for c in ends)


@lru_cache(maxsize=2)
def sides(first: str = FIRST, second: str = SECOND) -> tuple[Side, Side]:
    """Both tokenizers, for texts that begin with a space.

    The rank file of the first gives its json file's ids faster; texts on which
    its pattern gives up go to the json file. The second adds the space itself.
    """
    import public_tokenizers
    import sentencepiece
    import tiktoken
    import tokenizers

    with open(public_tokenizers.path(f"{first}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(first, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slower: list[tokenizers.Tokenizer] = []

    def encode_first(text: str) -> list[int]:
        try:
            return fast.encode_ordinary(text)
        except ValueError:  # the pattern's stack is exhausted
            if not slower:
                slower.append(tokenizers.Tokenizer.from_file(public_tokenizers.path(f"{first}.json")))
                slower[0].encode_special_tokens = True
            return slower[0].encode(text, add_special_tokens=False).ids

    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{second}.model"))

    def piece_bytes(i: int) -> bytes:
        piece = pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()

    by_rank = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
    return Side(encode_first, by_rank, ",|"), Side(lambda text: pieces.encode(text[1:], num_threads=1), [piece_bytes(i) for i in range(pieces.vocab_size())], ",;")


def link_pairs(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct linked id pairs (first id above the second's bits), their links, and all links."""
    n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    start_b = np.cumsum(n_b) - n_b
    crowded = n_a * n_b > PLAIN_PAIRS
    a64, b64 = a.astype(np.int64), b.astype(np.int64)
    plain = ~crowded[group_a]
    times = n_b[group_a[plain]]
    before = np.cumsum(times) - times
    at_b = np.arange(times.sum()) - np.repeat(before - start_b[group_a[plain]], times)
    keys, links = np.unique(np.repeat(a64[plain], times) << ID_BITS | b64[at_b], return_counts=True)
    if not crowded.any():
        return keys, links, int(links.sum())
    start_a = np.cumsum(n_a) - n_a
    parts = [(keys, links)]
    for g in np.flatnonzero(crowded):
        ua, ca = np.unique(a64[start_a[g] : start_a[g] + n_a[g]], return_counts=True)
        ub, cb = np.unique(b64[start_b[g] : start_b[g] + n_b[g]], return_counts=True)
        parts.append((np.add.outer(ua << ID_BITS, ub).ravel(), np.multiply.outer(ca, cb).ravel()))
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    links = np.zeros(len(keys), np.int64)
    np.add.at(links, at, np.concatenate([n for _, n in parts]))
    return keys, links, int(links.sum())


def align(text: str | None, first: Side, second: Side) -> tuple[tuple, np.ndarray, np.ndarray]:
    """A text's digest (DIGEST), its distinct pairs and their links."""
    none = (0, 0, 0, 0, ""), np.empty(0, np.int64), np.empty(0, np.int64)
    if not text:
        return none
    want = b" " + text.encode("utf-8", "surrogatepass")
    a, b = first.encode(" " + text), second.encode(" " + text)
    if b"".join(map(first.tokens.__getitem__, a)) != want or b"".join(map(second.tokens.__getitem__, b)) != want:
        return none
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    end_a, end_b = np.cumsum(first.sizes[a]), np.cumsum(second.sizes[b])
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    keys, links, total = link_pairs(a, b, group_a, group_b, len(cuts))
    closes_a, closes_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
    written = np.empty(len(a) + len(b), object)
    written[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = np.where(closes_a, first.last[a], first.more[a])
    written[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = np.where(closes_b, second.last[b], second.more[b])
    digest = hashlib.sha256("".join(written.tolist())[:-1].encode()).hexdigest()
    return (len(a), len(b), len(cuts), total, digest), keys, links


def chunks(*columns: np.ndarray, size: int = CHUNK) -> list[bytes]:
    """Columns of equal length as packed chunks; the first column, sorted, by its steps."""
    out = []
    for i in range(0, len(columns[0]), size):
        parts = [c[i : i + size] for c in columns]
        packed = [pack(np.diff(parts[0], prepend=0)), *map(pack, parts[1:])]
        out.append(b"".join(len(p).to_bytes(4, "little") + p for p in packed))
    return out


def parts_of(chunk: bytes) -> list[np.ndarray]:
    found, at = [], 0
    while at < len(chunk):
        n = int.from_bytes(chunk[at : at + 4], "little")
        found.append(unpack(chunk[at + 4 : at + 4 + n], np.int64))
        at += 4 + n
    return [np.cumsum(found[0]), *found[1:]]


def spill(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radix: int = RADIX, block_records: int = BLOCK_RECORDS) -> DataFrame:
    """SPILLED: a row per document with its digest, and a run per block and radix.

    ``keys`` holds a run's pairs with the number of the block's documents that
    have each, ``holders`` these documents' places and their links, in that
    order. A pair's key has the radix bits of its first id in front.
    """
    low = radix.bit_length() - 1

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = sides()
        schema = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("radix", pa.int32()), ("keys", pa.list_(pa.binary())), ("holders", pa.list_(pa.binary()))])
        ids, digests, found, held, number = [], [], [], 0, 0

        def block() -> Iterator[pa.RecordBatch]:
            name = xxhash.xxh3_64_intdigest(f"{partition}/{number}") >> 1
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(range(len(ids)), pa.int32()), pa.array(ids, pa.int64()), *(pa.array(c, schema.field(3 + i).type) for i, c in enumerate(zip(*digests, strict=True))), pa.nulls(len(ids), pa.int32()), *(pa.nulls(len(ids), schema.field(c).type) for c in ("keys", "holders"))], schema=schema)
            pairs, places, links = np.concatenate([k for k, _ in found]), np.repeat(np.arange(len(found)), [len(k) for k, _ in found]), np.concatenate([n for _, n in found])
            a = pairs >> ID_BITS
            turned = (a & radix - 1) << ID_BITS - low | a >> low
            record = (turned << ID_BITS | pairs & (1 << ID_BITS) - 1) << PLACE_BITS | places
            by = np.argsort(record)
            record, links = record[by], links[by]
            key, place = record >> PLACE_BITS, record & (1 << PLACE_BITS) - 1
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            n, of = np.diff(starts, append=len(key)), key[starts] >> 2 * ID_BITS - low
            edges, rows = np.searchsorted(of, np.arange(radix + 1)), []
            for r in range(radix):
                lo, hi = edges[r], edges[r + 1]
                if lo < hi:
                    runs, holders = chunks(key[starts[lo:hi]], n[lo:hi]), []
                    for i in range(lo, hi, CHUNK):
                        j = min(i + CHUNK, hi)
                        s, e = starts[i], starts[j] if j < len(starts) else len(key)
                        holders.append(chunks(place[s:e], links[s:e], size=e - s)[0])
                    rows.append((r, runs, holders))
            if rows:
                nulls = [pa.nulls(len(rows), schema.field(i).type) for i in range(1, 8)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *nulls, *(pa.array([x[i] for x in rows], schema.field(8 + i).type) for i in range(3))], schema=schema)

        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                digest, keys, links = align(value.as_py(), first, second)
                ids.append(key)
                digests.append(digest)
                found.append((keys, links))
                held += len(keys)
                if held >= block_records or len(ids) >= BLOCK_DOCS:
                    yield from block()
                    ids, digests, found, held, number = [], [], [], 0, number + 1
        if ids:
            yield from block()

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(build, SPILLED)


def merged(runs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The k-way merge: (keys, sums) in order, each key once.

    Only one chunk of each run is open. The run whose open chunk ends first is
    on top of the heap; no other run can hold an unseen key up to there.
    """
    todo = [iter(r) for r in runs]
    opened: dict[int, list[np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def advance(i: int) -> None:
        chunk = next(todo[i], None)
        if chunk is None:
            opened.pop(i, None)
        else:
            opened[i] = parts_of(chunk)[:2]
            heapq.heappush(heap, (int(opened[i][0][-1]), i))

    for i in range(len(runs)):
        advance(i)
    while heap:
        bound, top = heapq.heappop(heap)
        keys, counts = [], []
        for i, (k, n) in opened.items():
            upto = np.searchsorted(k, bound, "right")
            if upto:
                keys.append(k[:upto])
                counts.append(n[:upto])
                opened[i] = [k[upto:], n[upto:]]
        if keys:
            key, count = np.concatenate(keys), np.concatenate(counts)
            by = np.argsort(key, kind="stable")
            key, count = key[by], count[by]
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            yield key[starts], np.add.reduceat(count, starts)
        advance(top)


def rechunked(pieces: Iterator[tuple[np.ndarray, ...]], whole: Callable[[np.ndarray], np.ndarray] = lambda k: k) -> Iterator[tuple[np.ndarray, ...]]:
    """Stretches of at least a chunk that never part keys of which ``whole`` is equal."""
    held: list[tuple[np.ndarray, ...]] = []
    for piece in pieces:
        held.append(piece)
        if sum(len(p[0]) for p in held) < CHUNK:
            continue
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        sides_ = whole(columns[0])
        cut = int(np.searchsorted(sides_, sides_[-1]))
        if cut:
            yield tuple(c[:cut] for c in columns)
        held = [tuple(c[cut:] for c in columns)]
    if held and sum(len(p[0]) for p in held):
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def with_best(run: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs in first-side order with their totals, marked where no pair of that id has more."""
    for key, total in rechunked(run, lambda k: k >> ID_BITS):
        side = key >> ID_BITS
        starts = np.flatnonzero(np.diff(side, prepend=-1))
        top = np.maximum.reduceat(total, starts)
        yield key, total, (total == np.repeat(top, np.diff(starts, append=len(side)))).astype(np.int64)


def merge_level(runs: DataFrame, nodes: int, last: bool) -> DataFrame:
    """Runs (RUN) of one level as those of ``nodes`` groups a radix; the last level's as answers."""

    def run(group: pa.Table) -> pa.Table:
        found = merged(group.column("keys").to_pylist())
        stretches = with_best(found) if last else rechunked(found)
        packed = [c for s in stretches for c in chunks(*s)]
        return pa.table({"radix": group.column("radix").slice(0, 1), "node": group.column("node").slice(0, 1), name: pa.array([packed], pa.list_(pa.binary()))})

    name = "answers" if last else "keys"
    return runs.withColumn("node", F.pmod("node", F.lit(nodes))).groupBy("radix", "node").applyInArrow(run, ANSWER if last else RUN)


def looked_up(run: list[bytes], answers: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk of a run: its keys, their totals and marks, from sorted answers that hold them all."""
    todo, empty = iter(answers), np.empty(0, np.int64)
    have = [empty, empty, empty]
    for chunk in run:
        key = parts_of(chunk)[0]
        at = np.searchsorted(have[0], key[0])
        have = [c[at:] for c in have]
        while not len(have[0]) or have[0][-1] < key[-1]:
            have = [np.concatenate(c) for c in zip(have, parts_of(next(todo)), strict=True)]
        at = np.searchsorted(have[0], key)
        yield key, have[1][at], have[2][at]


def answers_down(runs: DataFrame, answers: DataFrame, nodes: int) -> DataFrame:
    """ANSWER for each run of a level, from the answers of the ``nodes`` groups above."""

    def run(below: pa.Table, above: pa.Table) -> pa.Table:
        known = above.column("answers").to_pylist()
        packed = [[c for found in looked_up(r, known[0]) for c in chunks(*found)] for r in below.column("keys").to_pylist()]
        return pa.table({"radix": below.column("radix"), "node": below.column("own"), "answers": pa.array(packed, pa.list_(pa.binary()))})

    under = runs.select("radix", F.col("node").alias("own"), F.pmod("node", F.lit(nodes)).alias("node"), "keys")
    return under.groupBy("radix", "node").cogroup(answers.groupBy("radix", "node")).applyInArrow(run, ANSWER)


def sums_of_blocks(spilled: DataFrame, answers: DataFrame, nodes: int) -> DataFrame:
    """SUMS per block and radix: what its records count, by the documents' places."""

    def run(below: pa.Table, above: pa.Table) -> pa.Table:
        known, out = above.column("answers").to_pylist(), []
        for r, holders in zip(below.column("keys").to_pylist(), below.column("holders").to_pylist(), strict=True):
            sums, best = np.zeros(1 << PLACE_BITS, np.int64), np.zeros(1 << PLACE_BITS, np.int64)
            for chunk, (_, total, mark), held in zip(r, looked_up(r, known[0]), holders, strict=True):
                n = parts_of(chunk)[1]
                place, links = parts_of(held)
                np.add.at(sums, place, np.repeat(total, n) * links)
                np.add.at(best, place, np.repeat(mark, n) * links)
            size = int(np.flatnonzero(sums)[-1]) + 1
            out.append((pack(sums[:size]), pack(best[:size])))
        return pa.table({"block": below.column("block"), "sums": pa.array([s for s, _ in out], pa.binary()), "best": pa.array([b for _, b in out], pa.binary())})

    under = spilled.filter("radix is not null").select("radix", F.pmod("block", F.lit(nodes)).alias("node"), "block", "keys", "holders")
    return under.groupBy("radix", "node").cogroup(answers.groupBy("radix", "node")).applyInArrow(run, SUMS)


def alignment(docs: DataFrame, *, radix: int = RADIX, fan: int = FAN, **options: object) -> DataFrame:
    """RESULT: one row per document."""
    spilled = materialize(spill(docs, radix=radix, **options), "alignment-spill")
    blocks = spilled.filter("place = 0").count()
    levels = [max(1, -(-blocks // fan))]
    while levels[-1] > 1:
        levels.append(-(-levels[-1] // fan))
    runs = [spilled.filter("radix is not null").select("radix", F.col("block").alias("node"), "keys")]
    for nodes in levels[:-1]:
        runs.append(materialize(merge_level(runs[-1], nodes, last=False), "alignment-runs"))
    answers = materialize(merge_level(runs[-1], 1, last=True), "alignment-answers")
    for level in range(len(levels) - 1, 0, -1):
        above, answers = answers, materialize(answers_down(runs[level], answers, levels[level]), "alignment-answers")
        discard(above)
        discard(runs[level])
    sums = sums_of_blocks(spilled, answers, levels[0])

    def run(documents: pa.Table, parts: pa.Table) -> pa.Table:
        totals = [np.zeros(documents.num_rows, np.int64) for _ in range(2)]
        for name, total in zip(("sums", "best"), totals, strict=True):
            for packed in parts.column(name):
                values = unpack(packed.as_py(), np.int64)
                total[: len(values)] += values
        documents = documents.sort_by("place").drop_columns(["block", "place"])
        return documents.append_column("n_best", pa.array(totals[1])).append_column("count_sum", pa.array(totals[0]))

    documents = spilled.filter("radix is null").select("block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return documents.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(run, RESULT)


def op12_align_tokenizers(spark, sf_dir):
    """The links between two tokenizers' tokens in every document, with their counts over all documents."""
    return alignment(table(spark, sf_dir, "documents"))
