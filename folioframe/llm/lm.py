"""Language-model scores from a weighted backoff automaton.

The training documents' tokens (words, then one end each) give unigram
probabilities with add-0.1 smoothing over the seen tokens and one unknown. On
top stands a backoff model of ``order``: a history is a state, every n-gram
of the training documents an arc with its smoothed weight, and every state has
a failure arc to the state of the shorter history, weighted so that its arcs
and what the failure arc leads to sum to one. As all n-grams are arcs, a
failure arc weighs prior / (count of the history + prior), and an arc (count +
prior * lower) / (count of the history + prior).

No count is dropped at any corpus size and no table is collected: documents are
read once into blocks that name each distinct word once, a block asks for the
training counts of its own n-grams, and the questions of all blocks meet by
the n-gram's hash. The answers hold every arc and failure weight that the
block's documents can take, so a block is scored by itself. Questions and
answers are packets, one per block and range of hashes; there are never more
packets than n-grams, and the ranges get narrower as blocks get more.

Blocks and answers are written once to the shared folder. Ranges are asked for
in a few turns, so that not all questions are on disk at once.

``build_automaton`` gives the same model as one object in memory, cut by floors;
it is for looking at models and as the tests' counterpart.

Defined cases: a null or empty text is one end token; a null id is in the fold
of the empty text; rows with equal ids are scored separately; with no training
document every score is log10(0.1 / 0.1) = 0; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.words import remainder, words_of
from folioframe.session import forget_shuffles, materialize, table

ORDER = 3
CORE_FLOOR = 2.0**-15
ARC_FLOOR = 2.0**-18
SMOOTHING = 0.1
PRIOR = 20.0
FOLDS = 10
BLOCK_TOKENS = 1 << 20
#: Ranges of hashes at least, and blocks to a range beyond them.
RANGES, BLOCKS_A_RANGE = 256, 2
#: Ranges are asked for in turns, so that the questions of one turn only are on disk.
TURNS = 3
MULTIPLIER, MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Hash of the end token; words are never empty, so it can't be a word's.
END = 0
ASKED = "range int, block long, n int, n_words int, grams binary, here binary"
ANSWERS = "range int, block long, totals binary, tokens long, words long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
BLOCKS = "block long, docs binary, train binary, sizes binary, tokens binary, words binary, counts binary"


def pack(values: np.ndarray) -> bytes:
    """Numbers as their count and compressed planes of equal bytes."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(packed[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.decompress(packed[8:], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).reshape(-1).view(kind)


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) | 1


def token_blocks(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents as blocks of tokens that number the block's distinct words.

    One row per block: ids (with a null mask folded into ``train``), sizes,
    token numbers, and per distinct word its hash and training count.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[bytes, int] = {}
        docs_, train_, sizes_, tokens_ = [], [], [], []
        held = 0

        def block() -> pa.RecordBatch:
            tokens = np.concatenate(tokens_)
            trained = np.repeat(np.array([t & 1 for t in train_], bool), sizes_)
            counts = np.bincount(tokens[trained], minlength=len(names) + 1).astype(np.int64)
            words = np.array([END, *map(word_hash, names)], np.uint64)
            row = (uuid.uuid4().int >> 65, np.array(docs_, np.int64), np.array(train_, np.uint8), np.array(sizes_, np.int64), tokens, words, counts)
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([pack(c)], pa.binary()) for c in row[1:])], ["block", "docs", "train", "sizes", "tokens", "words", "counts"])

        for batch in batches:
            for key, train, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = words_of(value.as_py())
                number = names.setdefault
                tokens_.append(np.array([*(number(w, len(names) + 1) for w in found), 0], np.uint32))
                docs_.append(key or 0)
                train_.append(int(train) | (2 if key is None else 0))
                sizes_.append(len(found) + 1)
                held += len(found) + 1
                if held >= block_tokens:
                    yield block()
                    names, held = {}, 0
                    docs_, train_, sizes_, tokens_ = [], [], [], []
        if docs_:
            yield block()

    return docs.select(F.col(doc_id).cast("long"), (remainder(F.col(doc_id), folds) != 0).alias("train"), F.col(text)).mapInArrow(build, BLOCKS)


@dataclass
class Automaton:
    """States are histories of core words; state 0 is the empty history.

    ``core`` maps a word's hash to its number. ``arcs`` maps
    ``state * width + number`` to (weight, next state); ``fail`` and ``backoff``
    give each state's failure arc. ``next_root`` is the state after a word
    taken at the root. Everything is bounded by the floors.
    """

    core: np.ndarray
    core_p: np.ndarray
    width: int
    arcs: dict[int, tuple[float, int]]
    fail: list[int]
    backoff: list[float]
    next_root: list[int]
    start: int

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Core numbers of word hashes, -1 for the others."""
        if not len(self.core):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.core, hashes), len(self.core) - 1)
        return np.where(self.core[at] == hashes, at, -1)

    def score(self, numbers: list[int], logs: list[float]) -> float:
        """log10 probability of a document: core numbers and unigram logs of its tokens."""
        total, state = 0.0, self.start
        arcs, fail, backoff, width, next_root = self.arcs, self.fail, self.backoff, self.width, self.next_root
        for c, log in zip(numbers, logs, strict=True):
            if c < 0:
                while state:
                    total += backoff[state]
                    state = fail[state]
                total += log
                continue
            while state:
                arc = arcs.get(state * width + c)
                if arc is not None:
                    total += arc[0]
                    state = arc[1]
                    break
                total += backoff[state]
                state = fail[state]
            else:
                total += log
                state = next_root[c]
        return total


def _read(row: dict) -> tuple[np.ndarray, ...]:
    kinds = {"docs": np.int64, "train": np.uint8, "sizes": np.int64, "tokens": np.uint32, "words": np.uint64, "counts": np.int64}
    return tuple(unpack(row[k], t) for k, t in kinds.items() if k in row)


def word_totals(blocks: DataFrame) -> DataFrame:
    """(``block``, ``slot``, ``word``, ``c``): the training count, over all blocks, of each block's words."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = unpack(row["words"], np.int64), unpack(row["counts"], np.int64)
                for i in range(0, len(words), 1 << 16):
                    n = len(words[i : i + (1 << 16)])
                    slots = np.arange(i, i + n, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(words[i : i + n]), pa.array([row["block"]] * n, pa.int64()), pa.array(slots), pa.array(counts[i : i + n])], ["word", "block", "slot", "here"])

    rows = blocks.select("block", "words", "counts").mapInArrow(spread, "word long, block long, slot int, here long")
    #: a word has one row per block at most, so a frequent word's run is short
    return rows.withColumn("c", F.sum("here").over(Window.partitionBy("word"))).select("block", "slot", "word", "c")


def ngram_counts(blocks: DataFrame, core: np.ndarray, kept: list[np.ndarray]) -> DataFrame:
    """Counts of n-grams whose history and suffix are kept: (``history``, ``number``, ``c``).

    ``kept[k]`` holds the sorted keys of the kept (k + 2)-grams; the number of
    an n-gram is its place in its array. The end token stands before every
    document as its start.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(core)
        for batch in batches:
            for row in batch.to_pylist():
                _, train, sizes, tokens, words = _read({k: row[k] for k in ("docs", "train", "sizes", "tokens", "words")})
                at = np.minimum(np.searchsorted(core, words), width - 1)
                slot = np.where(core[at] == words, at, -1)
                c = slot[tokens]
                first = np.zeros(len(tokens), bool)
                first[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = True
                end = slot[0]
                hist = np.concatenate([[end], c[:-1]])
                hist[first] = end
                ok = (hist >= 0) & (c >= 0)
                for keys in kept:  # from the place of each token's n-gram to the history of the next
                    gram = hist * width + c
                    at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
                    here = np.where(ok & (keys[at] == gram), at, -1)
                    hist = np.concatenate([[-1], here[:-1]])
                    hist[first] = -1
                    ok = (hist >= 0) & (here >= 0)
                ok &= np.repeat((train & 1).astype(bool), sizes)
                grams, counts = np.unique(hist[ok] * width + c[ok], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams // width), pa.array(grams % width), pa.array(counts)], ["history", "number", "c"])

    found = blocks.select("block", "docs", "train", "sizes", "tokens", "words").mapInArrow(count, "history long, number long, c long")
    return found.groupBy("history", "number").agg(F.sum("c").alias("c"))


def build_automaton(blocks: DataFrame, totals: DataFrame, *, order: int = ORDER, core_floor: float = CORE_FLOOR, arc_floor: float = ARC_FLOOR, prior: float = PRIOR, fewest: int = 2) -> tuple[Automaton, int, int]:
    """The automaton, with N and V. At most 1 / floor rows of any kind reach the driver."""
    #: one row per word of the corpus
    words = totals.groupBy("word").agg(F.first("c").alias("c")).filter("c > 0")
    size = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(size["n"]), int(size["v"])
    frequent = words.filter(F.col("c") >= F.lit(max(float(fewest), core_floor * n))).collect() if n else []
    counts = {np.uint64(r["word"] & 0xFFFFFFFFFFFFFFFF): r["c"] for r in frequent}
    core = np.array(sorted(counts), np.uint64)
    total = np.array([counts[w] for w in core], np.float64)
    p1 = (total + SMOOTHING) / (n + SMOOTHING * (v + 1))
    width = max(1, len(core))
    least = max(float(fewest), arc_floor * n)
    end = 0 if len(core) and core[0] == END else -1

    #: order two: one state per core word; the end's state is the document's start
    arcs: dict[int, tuple[float, int]] = {}
    fail, backoff, next_root = [0], [0.0], list(range(1, len(core) + 1))
    fail += [0] * len(core)
    backoff += [0.0] * len(core)
    if end < 0 or order < 2:
        return Automaton(core, p1, width, {}, [0], [0.0], [0] * len(core), 0), n, v
    state_of_history = np.arange(1, len(core) + 1)
    history_count = total.copy()
    kept: list[np.ndarray] = []
    lower = {0: p1}

    def weight(state: int, number: int) -> float:
        """The probability of a core word after a state, by the arcs built so far."""
        logs = 0.0
        while state:
            arc = arcs.get(state * width + number)
            if arc is not None:
                return 10.0 ** (logs + arc[0])
            logs += backoff[state]
            state = fail[state]
        return float(10.0**logs * lower[0][number])

    for k in range(2, order + 1):
        rows = ngram_counts(blocks, core, kept).filter(F.col("c") >= least).collect()
        if not rows:
            break
        keys = np.array(sorted(r["history"] * width + r["number"] for r in rows), np.int64)
        count = {r["history"] * width + r["number"]: r["c"] for r in rows}
        deeper = k < order
        base = len(fail)
        if deeper:  # a kept n-gram is a history of the next order
            for key in keys:
                h, c = divmod(int(key), width)
                fail.append(int(next_root[c]) if k == 2 else arcs.get(fail[int(state_of_history[h])] * width + c, (0.0, next_root[c]))[1])
                backoff.append(0.0)
        fresh: dict[int, tuple[float, int]] = {}
        by_state: dict[int, list[tuple[int, float, float]]] = {}
        for i, key in enumerate(keys):
            h, c = divmod(int(key), width)
            state = int(state_of_history[h])
            below = weight(fail[state], c)
            p = (count[int(key)] + prior * below) / (history_count[h] + prior)
            if deeper and c != end:
                target = base + i
            else:  # the longest history that ends with this word
                target = arcs.get(fail[state] * width + c, (0.0, next_root[c]))[1] if fail[state] else next_root[c]
            fresh[state * width + c] = (float(np.log10(p)), int(target))
            by_state.setdefault(state, []).append((c, p, below))
        for state, found in by_state.items():
            left, room = 1.0 - sum(p for _, p, _ in found), 1.0 - sum(b for _, _, b in found)
            backoff[state] = float(np.log10(max(left, 1e-12) / max(room, 1e-12)))
        arcs.update(fresh)
        kept.append(keys)
        state_of_history = np.arange(base, base + len(keys))
        history_count = np.array([count[int(x)] for x in keys], np.float64)
    return Automaton(core, p1, width, arcs, fail, backoff, next_root, int(next_root[end])), n, v


def _follow(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of their histories and last words."""
    x = (history + np.uint64(1)) * MULTIPLIER + word  # the end after the end isn't the end
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


@dataclass
class Grams:
    """The distinct n-grams of a block by range of their hash, words before longer ones.

    ``place[k]`` gives each token the place of its (k + 1)-gram, -1 where the
    document has begun too late for one; the end token stands before every document.
    """

    keys: np.ndarray
    here: np.ndarray
    is_word: np.ndarray
    place: list[np.ndarray]
    first: np.ndarray
    bounds: np.ndarray


def block_grams(row: dict, order: int, ranges: int) -> Grams:
    _, train, sizes, tokens, words, counts = _read(row)
    word = words[tokens]
    starts = np.cumsum(sizes) - sizes
    inside = np.arange(len(tokens)) - np.repeat(starts, sizes)
    trained = np.repeat((train & 1).astype(bool), sizes)
    keys, here, place, gram = [words], [counts], [tokens.astype(np.int64)], word
    for k in range(2, order + 1):
        history = np.concatenate([[np.uint64(END)], gram[:-1]])
        if k == 2:
            history[starts] = END
        gram = _follow(history, word)
        ok = inside >= k - 2
        found, at = np.unique(gram[ok], return_inverse=True)
        where = np.full(len(tokens), -1, np.int64)
        where[ok] = at + sum(map(len, keys))
        keys.append(found), here.append(np.bincount(at[trained[ok]], minlength=len(found))), place.append(where)
    every = np.concatenate(keys)
    part = (every >> np.uint64(64 - (ranges - 1).bit_length())).astype(np.uint16 if ranges <= 1 << 16 else np.uint32)
    by_range = np.argsort(part, kind="stable")
    back = np.empty(len(every) + 1, np.int64)
    back[by_range], back[-1] = np.arange(len(every)), -1
    bounds = np.searchsorted(part[by_range], np.arange(ranges + 1))
    return Grams(every[by_range], np.concatenate(here)[by_range].astype(np.int64), by_range < len(words), [back[p] for p in place], inside == 0, bounds)


def ask(blocks: DataFrame, order: int, ranges: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """Packets of a block's n-grams, of every ``turns``-th range, with their training counts in the block."""

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                g = block_grams(row, order, ranges)
                rows = []
                for r in range(turn, ranges, turns):
                    a, b = int(g.bounds[r]), int(g.bounds[r + 1])
                    if a < b:
                        rows.append((r, row["block"], b - a, int(g.is_word[a:b].sum()), pack(g.keys[a:b]), pack(g.here[a:b])))
                if not rows:
                    continue
                types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["range", "block", "n", "n_words", "grams", "here"])

    return blocks.mapInArrow(questions, ASKED)


def answer(asked: DataFrame) -> DataFrame:
    """Every packet's training counts over all blocks; the first packet of a range has the range's tokens and known words."""

    def total(packets: pa.Table) -> pa.Table:
        rows = packets.to_pylist()
        keys = np.concatenate([unpack(r["grams"], np.uint64) for r in rows])
        here = np.concatenate([unpack(r["here"], np.int64) for r in rows])
        found, at = np.unique(keys, return_inverse=True)
        sums = np.bincount(at, here, minlength=len(found)).astype(np.int64)  # exact below 2^53
        ends = np.cumsum([r["n"] for r in rows])
        words = np.unique(np.concatenate([at[e - r["n"] : e - r["n"] + r["n_words"]] for e, r in zip(ends, rows, strict=True)]))
        rest = [0] * (len(rows) - 1)
        arrays = [
            packets.column("range"), packets.column("block"), pa.array([pack(sums[at[e - r["n"] : e]]) for e, r in zip(ends, rows, strict=True)], pa.binary()),
            pa.array([int(sums[words].sum()), *rest], pa.int64()), pa.array([int((sums[words] > 0).sum()), *rest], pa.int64()),
        ]
        return pa.Table.from_arrays(arrays, ["range", "block", "totals", "tokens", "words"])

    return asked.groupBy("range").applyInArrow(total, ANSWERS)


def score_blocks(blocks: DataFrame, answers: DataFrame, n: int, v: int, order: int, ranges: int, prior: float = PRIOR) -> DataFrame:
    """Per document: tokens, known tokens, base and model scores."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        totals = {r: t for r, t in zip(right.column("range").to_pylist(), right.column("totals").to_pylist(), strict=True)}
        out: list[list] = [[] for _ in range(6)]
        for row in left.to_pylist():
            g = block_grams(row, order, ranges)
            docs, train, sizes = _read({k: row[k] for k in ("docs", "train", "sizes")})
            c = np.zeros(len(g.keys) + 1, np.int64)  # the last place stands for no n-gram
            for r in range(ranges):
                a, b = int(g.bounds[r]), int(g.bounds[r + 1])
                if a < b:
                    c[a:b] = unpack(totals[r], np.int64)
            starts = np.cumsum(sizes) - sizes
            count = c[g.place[0]]
            p = (count + SMOOTHING) / (n + SMOOTHING * (v + 1))
            base, known = np.add.reduceat(np.log10(p), starts), np.add.reduceat((count > 0).astype(np.int64), starts)
            for k in range(1, order):
                history = np.concatenate([[0], c[g.place[k - 1]][:-1]])
                history[g.first] = c[g.place[0][int(sizes[0]) - 1]] if k == 1 else 0  # the end's count is that of the beginnings
                p = (c[g.place[k]] + prior * p) / (history + prior)
            made = [[None if t & 2 else d for d, t in zip(docs.tolist(), train.tolist(), strict=True)], (train & 1 == 0).tolist(), sizes.tolist(), known.tolist(), base.tolist(), np.add.reduceat(np.log10(p), starts).tolist()]
            for column, values in zip(out, made, strict=True):
                column += values
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    found = blocks.groupBy("block").cogroup(answers.select("block", "range", "totals").groupBy("block")).applyInArrow(score, SCORES)
    return found.withColumn("train_tokens", F.lit(n).cast("long"))


def lm_scores(docs: DataFrame, *, folds: int = FOLDS, order: int = ORDER, block_tokens: int = BLOCK_TOKENS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all ``docs``, learned from those outside the held-out fold."""
    blocks = materialize(token_blocks(docs, doc_id=doc_id, text=text, folds=folds, block_tokens=block_tokens), "lm-blocks")
    ranges = max(RANGES, 1 << (max(1, blocks.count() // BLOCKS_A_RANGE) - 1).bit_length())
    answers = None
    for turn in range(TURNS):
        found = materialize(answer(ask(blocks, order, ranges, turn, TURNS)), "lm-answers")
        answers = found if answers is None else answers.unionByName(found)
        forget_shuffles(docs.sparkSession)
    size = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("v")).first()
    return score_blocks(blocks, answers, int(size["n"]), int(size["v"]), order, ranges)


def token_counts(texts: list[str | None]) -> Counter:
    """Brute-force token counts, for tests: words and one end (an empty word) per text."""
    found: Counter = Counter()
    for t in texts:
        found.update(words_of(t))
        found[b""] += 1
    return found


def op4_lm_scores(spark, sf_dir):
    """Every document's log10 probability."""
    return lm_scores(table(spark, sf_dir, "documents"))
