"""Phrase collocations by dynamic itemset counting.

A phrase of k + 1 words is counted only once both its phrases of k words have
reached the threshold, and starts as soon as they have, not when all lengths k
are done: lengths are interleaved over the scans.

* Documents are read once into blocks: words numbered within the block, each with
  a hash of 96 bits that includes its language. Blocks belong to ``shards``
  parts of the corpus.
* Each round is a scan in which the shards stand at different lengths: shard s
  starts with its words in round s. A block posts (phrase, occurrences) for what
  has become active since it was last scanned. Posts meet by phrase; where the
  sum has reached the threshold, every block that posted the phrase is told, and
  activates in the next scan what it and another such phrase make together.
* So each block counts a phrase once, and a phrase has completed its cycle when
  every shard was scanned after its activation. Words are complete after as many
  rounds as there are shards, each further length one round later; then the
  scans end.

A phrase has one post a block, so neither a frequent word nor a language that
holds a third of all rows makes a group that grows with its occurrences. Blocks
are written once, in buckets by number, and never shuffled again; posts are
written to the shared folder and deleted when their lengths are complete. Phrases that reached the threshold get their words from one block
that holds them, their parts' counts by joins, and scores from exact decimals.

Texts of any length are read whole; a piece (what lies between two marks) stays in
one block. Defined cases: null or empty texts have no words; a null language is
``und``; rows with equal ids or texts count each; phrases that tie are ordered by
score, count and then bytes; an empty table gives an empty result; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.lm import pack, unpack
from folioframe.llm.spread import join_spread
from folioframe.session import cleaned, delete, discard, materialize, materialize_by, shared_folder, table

LONGEST, LEAST, FIRST = 5, 100, 2000
SHARDS = 2
#: Posts of a length are summed in so many turns, by hash, so that not all are shuffled at once.
TURNS = 7
#: A block's hashes are sorted: their steps are shorter, and the counts are small.
POST_FILES = {"parquet.writer.version": "v2", "compression": "zstd"}
BLOCK_WORDS = 1 << 20
UNKNOWN = "und"
#: Marks that end a piece, as bytes; LF to CR are among them.
MARKS = b".,;:!?\n\x0b\x0c\r"
FOLDED = bytes(10 if c in MARKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Odd multipliers of the two hashes of a word sequence.
STEP_1, STEP_2 = np.uint64(0x9E3779B97F4A7C15), np.uint32(0x27D4EB4F)

BLOCK = "block long, shard int, ids binary, words binary, word_langs binary, langs array<string>, lang_words array<long>"
#: ``m`` is 32 times the occurrences plus twice the length.
POST = "block long, h1 long, h2 int, m long"
#: In this order a sort by key can go by the first hash alone.
KEY = ["h1", "h2", "k"]
NAMED = "lang string, phrase string, k int, h1 long, h2 int, a long, cuts array<struct<cut:int,l1:long,l2:int,r1:long,r2:int>>"


class _Numbers(dict):
    """Words of a language to their numbers in the block."""

    def __init__(self, seen: list[bytes]):
        super().__init__({b"": -2, b"\n": -1})
        self.seen = seen

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.seen)
        self.seen.append(word)
        return n


def word_blocks(docs: DataFrame, *, text: str = "text", lang: str = "lang", shards: int = SHARDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """BLOCK rows: word numbers with -1 between pieces, and each number's word and language."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition, number = TaskContext.get().partitionId(), 0
        schema = pa.schema([("block", pa.int64()), ("shard", pa.int32()), *((c, pa.binary()) for c in ("ids", "words", "word_langs")), ("langs", pa.list_(pa.string())), ("lang_words", pa.list_(pa.int64()))])
        seen: list[bytes] = []
        of: list[str] = []
        numbers: dict[str, _Numbers] = {}
        counts: dict[str, int] = {}
        parts, held = [], 0

        def block() -> pa.RecordBatch:
            langs = {name: i for i, name in enumerate(numbers)}
            kinds = np.zeros(len(seen), np.int32)
            for name, found in numbers.items():
                kinds[[n for n in found.values() if n >= 0]] = langs[name]
            key = xxhash.xxh3_64_intdigest(f"{partition}/{number}") >> 1
            row = (key, key % shards, pack(np.concatenate(parts)), pa.compress(b"\n".join(seen), codec="zstd", asbytes=True) + sum(map(len, seen), len(seen)).to_bytes(8, "little"), pack(kinds), list(langs), [counts[x] for x in langs])
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for value, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text_ = value.as_py()
                if not text_:
                    continue
                if name not in numbers:
                    numbers[name], counts[name] = _Numbers(seen), 0
                    of.append(name)
                tokens = text_.encode("utf-8", "surrogatepass").translate(FOLDED).replace(b"\n", b" \n ").split(b" ")
                ids = np.fromiter(map(numbers[name].__getitem__, tokens), np.int32, len(tokens))
                ids = np.append(ids[ids != -2], np.int32(-1))
                words = int((ids >= 0).sum())
                counts[name] += words
                held += words
                parts.append(ids)
                if held >= block_words:
                    yield block()
                    number, parts, held = number + 1, [], 0
                    seen.clear()
                    numbers.clear()
                    counts.clear()
        if held:
            yield block()

    return docs.select(F.col(text), F.coalesce(F.col(lang), F.lit(UNKNOWN))).mapInArrow(build, BLOCK)


def words_in(row: dict) -> list[bytes]:
    """A block's words by number."""
    size = int.from_bytes(row["words"][-8:], "little")
    return pa.decompress(row["words"][:-8], decompressed_size=max(0, size - 1), codec="zstd", asbytes=True).split(b"\n")


def word_hashes(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of a block's words, each with its language."""
    kinds = unpack(row["word_langs"], np.int32)
    langs = np.array([xxhash.xxh3_64_intdigest(x) for x in row["langs"]], np.uint64)[kinds]
    halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words_in(row))), np.uint64).reshape(-1, 2)
    return halves[:, 0] ^ langs, ((halves[:, 1] ^ langs * STEP_1) >> np.uint64(32)).astype(np.uint32)


class Sequences:
    """A block's word sequences: hashes of each length by place."""

    def __init__(self, row: dict):
        self.ids = unpack(row["ids"], np.int32)
        self.words = [np.append(h, h.dtype.type(0)) for h in word_hashes(row)]
        here = np.arange(len(self.ids))
        ends = np.where(self.ids < 0, here, len(here))
        self.room = np.minimum.accumulate(ends[::-1])[::-1] - here  # words from a place to its piece's end
        self.made: dict[int, list[np.ndarray]] = {1: [w[self.ids] for w in self.words]}

    def hashes(self, k: int) -> list[np.ndarray]:
        """Both hashes of ``k`` words from each place; only those within a piece mean anything."""
        if k not in self.made:
            shorter = self.hashes(k - 1)
            self.made[k] = [s[:-1] * m + w[k - 1 :] for s, m, w in zip(shorter, (STEP_1, STEP_2), self.made[1], strict=True)] if len(shorter[0]) else shorter
        return self.made[k]

    def keys(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, second = self.hashes(k)
        return first[at].view(np.int64), second[at].view(np.int32)


def counted(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their numbers."""
    by = np.argsort(h1)
    h1, h2 = h1[by], h2[by]
    starts = np.flatnonzero((np.diff(h1, prepend=h1[:1] - 1) != 0) | (np.diff(h2, prepend=h2[:1]) != 0)) if len(h1) else np.empty(0, np.int64)
    return h1[starts], h2[starts], np.diff(starts, append=len(h1))


def active_places(text: Sequences, k: int, h1: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Places of ``k`` words whose two phrases of k - 1 words have reached the threshold, one of them since the last scan.

    ``h1`` and ``fresh`` are what the block was told of phrases of k - 1 words.
    """
    if k == 2:  # by words of the block, not by places
        found = pc.index_in(pa.array(text.words[0].view(np.int64)), value_set=pa.array(h1)).fill_null(-1).to_numpy(zero_copy_only=False).copy()
        found[-1] = -1  # what stands between pieces
        at = found[text.ids]
    else:
        at = pc.index_in(pa.array(text.hashes(k - 1)[0].view(np.int64)), value_set=pa.array(h1)).fill_null(-1).to_numpy()
    known, new = at >= 0, np.append(fresh, False)[at]
    return np.flatnonzero(known[:-1] & known[1:] & (new[:-1] | new[1:]) & (text.room[: len(at) - 1] >= k))


def scan(blocks: DataFrame, told: DataFrame | None) -> DataFrame:
    """POST rows of a shard's blocks in one round: their words when it enters (``told`` is None), then what has become active."""

    entering = told is None

    def posts(block: int, k: int, h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> pa.Table:
        return pa.table({"block": np.full(len(h1), block, np.int64), "h1": h1, "h2": h2, "m": n.astype(np.int64) * 32 + 2 * k})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [posts(0, 0, *(np.empty(0, t) for t in (np.int64, np.int32, np.int64)))]
        for row in left.to_pylist():
            if entering:
                n = np.bincount((ids := unpack(row["ids"], np.int32))[ids >= 0])
                first, second = word_hashes(row)
                by = np.argsort(first)
                out.append(posts(row["block"], 1, first[by].view(np.int64), second[by].view(np.int32), n[by]))
            elif right.num_rows:
                text = Sequences(row)
                for length in sorted(pc.unique(right["k"]).to_pylist()):
                    part = right.filter(pc.equal(right["k"], length))
                    fresh = part["fresh"].to_numpy()
                    if fresh.any():
                        at = active_places(text, length + 1, part["h1"].to_numpy(), fresh)
                        out.append(posts(row["block"], length + 1, *counted(*text.keys(length + 1, at))))
        return pa.concat_tables(out)

    if entering:
        return blocks.groupBy("block").applyInArrow(lambda left: run(left, left.slice(0, 0)), POST)
    return blocks.groupBy("block").cogroup(told.select("block", "k", "h1", "fresh").groupBy("block")).applyInArrow(run, POST)


def told_blocks(posts: list[tuple[DataFrame, bool]], lengths: list[int], least: int, turn: int, turns: int) -> DataFrame:
    """(block, k, h1, h2, total, fresh): phrases that have reached ``least``, to each block that posted them.

    ``fresh`` are those that the block is told for the first time: they reached
    it with the last posts, or the block's own is among these. ``posts`` come with
    whether they are of the last round.
    """
    rows = None
    for post, last_round in posts:
        part = post.filter(F.expr("(m & 31) >> 1").isin(lengths) & (F.pmod("h1", F.lit(turns)) == turn)).withColumn("m", F.col("m") + int(last_round))
        rows = part if rows is None else rows.unionByName(part)
    of, newest = Window.partitionBy("h1", "h2", "k"), F.expr("m & 1") == 1
    rows = rows.select("block", "h1", "h2", F.expr("cast((m & 31) >> 1 as int)").alias("k"), "m")
    last = F.sum(F.when(newest, F.expr("m >> 5")).otherwise(F.lit(0))).over(of)
    found = rows.select("block", *KEY, "m", F.sum(F.expr("m >> 5")).over(of).alias("total"), last.alias("last")).filter(F.col("total") >= least)
    return found.select("block", *KEY, "total", ((F.col("total") - F.col("last") < least) | newest).alias("fresh"))


def frequent(blocks: DataFrame, *, longest: int = LONGEST, least: int = LEAST, shards: int = SHARDS, turns: int = TURNS) -> DataFrame:
    """(h1, h2, k, a, home): every phrase of up to ``longest`` words that occurs ``least`` times, written.

    ``home`` is a block that holds it. A length's counts are complete ``shards``
    rounds after its first. The posts of a round, shard and length are a table of
    their own, which goes when the length is complete; what blocks were told goes
    when they were scanned.
    """
    scanned = blocks.select("block", "shard", "ids", "words", "word_langs", "langs")
    posts: dict[tuple[int, int, int], DataFrame] = {}  # by round, shard and length
    none = blocks.sparkSession.createDataFrame([], POST)
    told: list[DataFrame] = []
    complete: list[DataFrame] = []
    try:
        for n in range(shards + longest):
            if n:
                lengths = [*range(max(1, n - shards + 1), min(longest - 1, n) + 1), *([longest] if n == shards + longest - 1 else [])]
                for length in lengths:
                    known = [(p, r == n - 1) for (r, _, k), p in posts.items() if k == length] or [(none, True)]
                    for turn in range(turns):
                        told.append(materialize(told_blocks(known, [length], least, turn, turns), "phrases-told"))
                    for at in [x for x in posts if x[2] <= min(length, n - shards + 1)]:
                        discard(posts.pop(at))  # of lengths that are complete now
                if n >= shards:
                    ended = reduce(DataFrame.unionByName, told).filter(F.col("k") == n - shards + 1).groupBy(*KEY)
                    complete.append(materialize(ended.agg(F.max("total").alias("a"), F.min_by("block", F.xxhash64("block", "h1")).alias("home")), "phrases-ended"))
            if n < shards + longest - 1:
                for shard in range(min(n + 1, shards)):
                    heard = reduce(DataFrame.unionByName, told).filter(F.col("block") % shards == shard) if shard < n else None
                    made = scan(scanned.filter(F.col("shard") == shard), heard)
                    if shard < min(n, shards - 1):  # later shards make shorter phrases active, too
                        posts |= {(n, shard, k): p for k, p in materialize_by(made.withColumn("k", F.expr("(m & 31) >> 1")), "phrase-posts", "k", **POST_FILES).items()}
                    else:
                        posts[n, shard, min(n - shard + 1, longest)] = materialize(made, "phrase-posts", **POST_FILES)
            while told:
                discard(told.pop())
        return materialize(reduce(DataFrame.unionByName, complete), "phrases")
    finally:
        for table_ in [*posts.values(), *told, *complete]:
            discard(table_)


def named(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """NAMED: the language and words of each frequent phrase, with the keys of both parts of each cut."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("lang", "phrase", "k", "h1", "h2", "a", "cuts")}
        row = left.to_pylist()[0]
        text = Sequences(row)
        words = words_in(row)
        kinds = unpack(row["word_langs"], np.int32)
        for k in sorted(pc.unique(right["k"]).to_pylist()):
            part = right.filter(pc.equal(right["k"], k))
            places = np.flatnonzero(text.room[: len(text.hashes(k)[0])] >= k)
            h1, h2 = text.keys(k, places)
            want = {(x, y): a for x, y, a in zip(*(part[c].to_pylist() for c in ("h1", "h2", "a")), strict=True)}
            near = np.flatnonzero(pc.is_in(pa.array(h1), value_set=part["h1"].combine_chunks()).to_numpy(zero_copy_only=False))
            for p, x, y in zip(places[near].tolist(), h1[near].tolist(), h2[near].tolist(), strict=True):
                a = want.pop((x, y), None)
                if a is None:
                    continue
                ids = text.ids[p : p + k]
                cuts = []
                for cut in range(1, k):
                    (l1, l2), (r1, r2) = ((int(v) for v in text.keys(n, np.array([at]))) for n, at in ((cut, p), (k - cut, p + cut)))
                    cuts.append({"cut": cut, "l1": l1, "l2": l2, "r1": r1, "r2": r2})
                for column, value in zip(out, (row["langs"][kinds[ids[0]]], b" ".join(words[i] for i in ids).decode("utf-8", "surrogatepass"), k, x, y, a, cuts), strict=True):
                    out[column].append(value)
        key = pa.struct([("cut", pa.int32()), ("l1", pa.int64()), ("l2", pa.int32()), ("r1", pa.int64()), ("r2", pa.int32())])
        kinds_ = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(key))
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds_, strict=True)})

    asked = found.filter("k > 1").withColumnRenamed("home", "block")
    homes = blocks.join(asked.select("block").distinct(), "block", "left_semi")
    return homes.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(run, NAMED)


@contextmanager
def bucketed(blocks: DataFrame) -> Iterator[DataFrame]:
    """``blocks`` as a table in buckets by ``block``, so that no scan has to shuffle it; it goes at the end."""
    spark = blocks.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"phrase_blocks_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    with cleaned(spark):
        blocks.repartition(n, "block").write.bucketBy(n, "block").sortBy("block").option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"drop table {name}")
        delete(spark, [path])


def collocations(docs: DataFrame, *, longest: int = LONGEST, least: int = LEAST, first: int = FIRST, shards: int = SHARDS, **options: object) -> DataFrame:
    """The ``first`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    with bucketed(word_blocks(docs, shards=shards, **options)) as blocks:
        found = frequent(blocks, longest=longest, least=least, shards=shards)
        phrases = materialize(named(blocks, found), "phrases-named")
        totals = blocks.select(F.explode(F.arrays_zip("langs", "lang_words")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.lang_words").alias("n"))
        totals = materialize(totals, "phrase-totals")

    cuts = phrases.select(*KEY, "a", F.explode("cuts").alias("c")).select(*KEY, "a", "c.*")
    part = lambda side, n, x, y: found.select(F.col("k").alias(n), F.col("h1").alias(x), F.col("h2").alias(y), F.col("a").alias(side))
    cuts = cuts.join(part("l", "cut", "l1", "l2"), ["cut", "l1", "l2"]).withColumn("rest", F.col("k") - F.col("cut")).join(part("r", "rest", "r1", "r2"), ["rest", "r1", "r2"])
    cuts = materialize(cuts, "phrase-cuts")

    inside = lambda cut, side, count: cuts.filter((cut == F.col("k") - 1) & (F.col(count) == F.col("a"))).select((F.col("k") - 1).alias("k"), F.col(f"{side}1").alias("h1"), F.col(f"{side}2").alias("h2"))
    dropped = inside(F.col("cut"), "l", "l").unionByName(inside(F.col("rest"), "r", "r")).filter("k > 1").distinct()
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    parts = cuts.groupBy(*KEY).agg(F.collect_list(F.struct("cut", "l", "r")).alias("parts"))
    kept = materialize(phrases.drop("cuts").join(parts, KEY).join(dropped, KEY, "left_anti"), "phrases-kept")
    scored = join_spread(kept, totals, ["lang"], "phrase").withColumn("p", F.explode("parts")).select("lang", "phrase", *KEY, "a", "n", "p.*")
    scored = scored.withColumn("score", F.expr("cast((cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as bigint)"))
    lowest = F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("x")
    best = scored.groupBy("lang", "phrase", "a", "n", *KEY).agg(lowest).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = best.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_n") <= first)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return few.withColumn("rank", rank).filter(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP11_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, row_number() over () as d, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
numbered as (select lang, row_number() over () as p, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces),
totals as (select lang, sum(len(ws))::hugeint as n from numbered group by lang),
words as (select lang, p, unnest(ws) as w, generate_subscripts(ws, 1) as i from numbered),
ahead as (select lang, w, lead(w, 1) over o as w2, lead(w, 2) over o as w3, lead(w, 3) over o as w4, lead(w, 4) over o as w5 from words window o as (partition by p order by i)),
grams as (
  select lang, 1 as k, w as phrase from ahead
  union all select lang, 2, concat_ws(' ', w, w2) from ahead where w2 is not null
  union all select lang, 3, concat_ws(' ', w, w2, w3) from ahead where w3 is not null
  union all select lang, 4, concat_ws(' ', w, w2, w3, w4) from ahead where w4 is not null
  union all select lang, 5, concat_ws(' ', w, w2, w3, w4, w5) from ahead where w5 is not null),
f as (select lang, k, phrase, count(*)::hugeint as a from grams group by all having count(*) >= 100),
c as (select * from f where k > 1),
cut as (
  select c.lang, c.phrase, c.k, c.a, x.k as cut, x.a as l, y.a as r
  from c, range(1, 5) t(j)
  join f x on x.k = j and x.lang = c.lang and x.phrase = array_to_string(string_split(c.phrase, ' ')[1 : j], ' ')
  join f y on y.lang = c.lang and y.k = c.k - j and y.phrase = array_to_string(string_split(c.phrase, ' ')[j + 1 :], ' ')
  where j < c.k),
scored as (select cut.*, t.n, (1000 * cut.a * t.n) // (cut.l * cut.r) as score from cut join totals t using (lang)),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
kept as (
  select * from best b where not exists (
    select 1 from c o where o.lang = b.lang and o.k > b.k and 100 * o.a >= 100 * b.a and contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ')))
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept) where rank <= 2000
"""


def op11_collocations(spark, sf_dir):
    """The 2,000 strongest phrases of each language, over all documents."""
    return collocations(table(spark, sf_dir, "documents"))
