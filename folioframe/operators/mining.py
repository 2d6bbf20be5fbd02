"""Term statistics, concepts, fill-in cards, links and summaries."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.text import let, sentences

#: A name is two to four capitalised words.
CAP_PHRASE = r"\b([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){1,3})\b"
#: Patterns of the two domains and their labels.
DOMAINS = {
    "legal": [(r"\bSection\s+\d+\w*", "LAW"), (r"\bArticle\s+\d+\w*", "LAW"), (r"\bAct\s+of\s+\d{4}", "LAW"), (r"§\s*\d+\w*", "LAW")],
    "medical": [(r"\b[A-Z]{2,5}\b", "DRUG"), (r"\b[a-zA-Z]{3,}(?:mab|ine|ase|cillin|olol|pril|sartan)\b", "DRUG")],
}
#: Small words inside names.
PARTICLES = "of the and de von van".split()
NUMBER = r"\b\d[\d,]*(?:\.\d+)?%?"
#: Groups repeat possessively: nothing follows that could take back from them, and others take stack for each time, which long runs of names use up.
PROPER = rf"(?U)\b[A-Z][\w'-]*(?:\s+(?:(?:{'|'.join(PARTICLES)})\s+)?[A-Z][\w'-]*)*+"
LETTERS = r"\p{L}[\p{L}\p{M}]*(?:[-'][\p{L}\p{M}]+)*+"
#: English function words by class; one that opens a sentence is no name.
FUNCTION_WORDS = {
    "determiners": "a all an another any both each either every few many most much neither no several some such that the these this those what which",
    "pronouns": "he her hers him his i it its me mine my one our ours she their theirs them they us we who whose you your yours",
    "prepositions": "about above across after against along among around at before behind below beneath beside between beyond by despite down during except for from in inside into near of off on onto out outside over past since through throughout till to toward under until up upon with within without",
    "conjunctions": "although and as because but if lest nor once or provided so than though unless when whenever where whereas wherever whether while yet",
    "adverbs": "afterwards again also always besides even finally first furthermore hence here how however indeed instead later meanwhile moreover never nevertheless next not now often only otherwise perhaps rather sometimes soon still then there thereafter therefore thus today too very why",
    "verbs": "are be been being can could did do does had has have is may might must shall should was were will would",
}
OPENERS = frozenset(w for words in FUNCTION_WORDS.values() for w in words.split())
#: The order in which a word's parts of speech are listed.
PARTS = ("noun", "verb", "adjective", "adverb")


def words_in(docs: DataFrame, pattern: str = "[A-Za-z]+", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ``word``) of every word, in lower case."""
    return docs.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern.replace("A-Z", ""))  , F.lit(0))).alias("word"))


def token_frequencies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``word``, ``count``, ``docs``, ``zipf``): corpus and document counts.

    Counted per document first, so a word has one row per document in the
    shuffle at most.
    """
    per_doc = words_in(docs, key=key, text=text).groupBy("word", key).agg(F.count(F.lit(1)).alias("n"))
    counts = per_doc.groupBy("word").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("docs"))
    total = counts.agg(F.sum("count").alias("total"))
    return counts.join(F.broadcast(total)).withColumn("zipf", F.round(F.log10(F.col("count") / F.col("total") * 1e9), 4)).drop("total")


#: From this zipf value on, the words above are at most a million.
LISTED = 3.0


def common_words_of(frequencies: DataFrame, threshold: float) -> DataFrame:
    """The words of at least this zipf value, to be broadcast: 10^(9 - threshold) at most, as shares of a corpus add up to one."""
    return F.broadcast(frequencies.filter(F.col("zipf") >= threshold).select("word"))


def difficult_words(docs: DataFrame, frequencies: DataFrame, *, threshold: float = 4.5, least: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ``word``): distinct words of a document that are rare; unlisted words are.

    The words that are not rare go first, by a list of them that no corpus makes
    longer (``common_words_of``); what is left is not looked up any more.
    """
    found = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= least))
    words = docs.select(key, F.explode(found).alias("word"))
    if threshold >= LISTED:
        return words.join(common_words_of(frequencies, threshold), "word", "left_anti").select(key, "word").distinct()
    words = words.distinct()
    return words.join(frequencies.select("word", "zipf"), "word", "left").filter(F.coalesce("zipf", F.lit(0.0)) < threshold).select(key, "word")


def unknown_words(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ``word``): distinct words without digits that no list holds."""
    found = docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w+\b"), F.lit(0)))).alias("word"))
    return found.filter(~F.col("word").rlike("[0-9]")).join(known.select(F.lower("word").alias("word")).distinct(), "word", "left_anti").select(key, "word")


def define_words(words: DataFrame, glossary: DataFrame, custom: DataFrame) -> DataFrame:
    """(``word``, ``pos``, ``definition``): the custom glossary before the general one, parts of speech in order."""
    norm = lambda c: F.lower(F.regexp_replace(c, r"^\W+|\W+$", ""))
    both = custom.withColumn("_p", F.lit(0)).unionByName(glossary.withColumn("_p", F.lit(1))).withColumn("_k", norm(F.col("word")))
    best = both.withColumn("_n", F.rank().over(Window.partitionBy("_k").orderBy("_p"))).filter("_n = 1").select("_k", "pos", "definition")
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PARTS)), F.col("pos")), F.lit(0)), F.lit(9))
    return words.withColumn("_k", norm(F.col("word"))).join(best, "_k", "left").withColumn("order", F.when(F.col("pos").isNotNull(), place)).drop("_k")


def spans_of(docs: DataFrame, pattern: str, label: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ``i``, ``gap``, ``text``, ``label``, ``start``, ``end``) of a pattern's matches."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m"))
    rows = docs.filter(F.col(text).isNotNull()).select(key, F.posexplode(both).alias("i", "x")).select(key, "i", F.col("x.g").alias("gap"), F.col("x.m").alias("_m"))
    end = F.sum(F.length("gap") + F.length("_m")).over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end", end).select(key, "i", "gap", F.col("_m").alias("text"), F.lit(label).alias("label"), (F.col("end") - F.length("_m")).alias("start"), "end")


def concept_spans(docs: DataFrame, domain: str = "", key: str = "doc_id", text: str = "text", terms: list[tuple[str, str]] | None = None) -> DataFrame:
    """Names of two to four capitalised words that open no sentence, and a domain's terms, with their places.

    ``terms`` are (pattern, label) pairs to use instead of the domain's.
    """
    caps = spans_of(docs, "(?U)" + CAP_PHRASE, "CONCEPT", key, text)
    before = F.regexp_replace("gap", r"[ \t]+$", "")
    opens = ((F.col("i") == 0) & (before == "")) | before.rlike(r"[.!?\n]$")
    out = caps.filter(~opens).drop("i", "gap")
    for pattern, label in DOMAINS.get(domain, []) if terms is None else terms:
        out = out.unionByName(spans_of(docs, "(?U)" + pattern, label, key, text).drop("i", "gap"))
    return out


def distinct_concepts(spans: DataFrame, key: str = "doc_id", cap: int = 500) -> DataFrame:
    """Distinct concepts of each document by first place, the first ``cap``."""
    grouped = spans.groupBy(key, "label", "text").agg(F.min("start").alias("first"), F.count(F.lit(1)).alias("count"))
    return grouped.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("first", "label", "text"))).filter(F.col("n") <= cap)


#: Parts that the notes holding a word are dealt to.
NOTE_SALTS = 64


def suggest_links(concepts: DataFrame, notes: DataFrame) -> DataFrame:
    """(``concept``, ``ids``): notes whose anchor or text holds a concept.

    Candidates share the concept's first word (an equi-join on an inverted
    index of the notes); containment is verified on these. Where many notes hold
    a word, they are dealt by the word and the note to a stated number of tasks:
    notes are alike and shrink in a shuffle, whose bytes would put them all in one.
    """
    c = concepts.groupBy(F.lower("text").alias("_c")).agg(F.min_by("text", "first").alias("concept")).withColumn("_w", F.regexp_extract("_c", "^[a-z0-9]+", 0)).filter("_w <> ''")
    hay = notes.select("id", F.lower(F.concat_ws(" ", "anchor", "note")).alias("_hay"))
    index = hay.select("id", "_hay", F.explode(F.array_distinct(F.regexp_extract_all("_hay", F.lit("[a-z0-9]+"), F.lit(0)))).alias("_w"))
    tasks = int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = c.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(NOTE_SALTS - 1))))
    index = index.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(NOTE_SALTS)).cast("int")).repartition(tasks, "_w", "_salt")
    return c.join(index, ["_w", "_salt"]).filter(F.expr("contains(_hay, _c)")).groupBy("concept").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def cloze_candidates(sentence: Column, rare: Column | None = None, most: int = 3) -> Column:
    """Up to ``most`` terms to blank, in text order: the first names and numbers, then the rarest words if these are too few."""
    opener = lambda p: F.lower(F.element_at(F.split(p, r"\s+"), 1)).isin(*sorted(OPENERS))
    names = F.transform(F.regexp_extract_all(sentence, F.lit(PROPER), F.lit(0)), lambda p: F.when(opener(p), F.regexp_replace(p, r"^\S+\s*", "")).otherwise(p))
    numbers = F.regexp_extract_all(sentence, F.lit(NUMBER), F.lit(0))
    once = lambda terms: F.filter(terms, lambda t, i: (F.length(t) > 1) & ~F.exists(F.slice(terms, 1, i), lambda u: F.lower(u) == F.lower(t)))
    placed = lambda terms: F.transform(F.array_sort(F.transform(terms, lambda t: F.struct(F.instr(sentence, t).alias("at"), t.alias("t")))), lambda x: x["t"])
    facts = let(F.concat(names, numbers), lambda t: F.slice(placed(once(t)), 1, most))
    if rare is None:
        return facts
    return placed(let(F.concat(facts, F.coalesce(rare, F.array().cast("array<string>"))), lambda t: F.slice(once(t), 1, most)))


def rare_words(sentences_: DataFrame, frequencies: DataFrame, keys: list[str], sentence: str, *, most: int = 3, least: int = 4, threshold: float = 4.5) -> DataFrame:
    """(keys, ``rare``): the rarest words of each sentence that the frequency table (``word``, ``zipf``) knows."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(sentence, F.lit(LETTERS), F.lit(0)), lambda w: F.length(w) >= least))
    rows = sentences_.select(*keys, F.posexplode(words).alias("_at", "_w")).withColumn("word", F.lower("_w"))
    if threshold >= LISTED:  # the frequent ones don't travel to be turned away
        rows = rows.join(common_words_of(frequencies, threshold), "word", "left_anti")
    found = rows.join(frequencies.filter((F.col("zipf") > 0) & (F.col("zipf") < threshold)).select("word", "zipf"), "word")
    return found.groupBy(*keys).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("zipf", "_at", "_w"))), 1, 2 * most), lambda x: x["_w"]).alias("rare"))


def blanked(sentence: Column, term: Column, mark: Column) -> Column:
    """The sentence with the first whole-word occurrence of a term replaced, or unchanged."""
    quoted = F.concat(F.lit(r"(?s)^(.*?)(?<!\w)\Q"), term, F.lit(r"\E(?!\w)(.*)$"))
    return F.when(F.regexp_like(sentence, quoted), F.concat(F.call_function("regexp_extract", sentence, quoted, F.lit(1)), mark, F.call_function("regexp_extract", sentence, quoted, F.lit(2)))).otherwise(sentence)


def cloze_cards(docs: DataFrame, *, most: int = 3, numbered: bool = False, key: str = "doc_id", text: str = "text", note: str | None = None, frequencies: DataFrame | None = None) -> DataFrame:
    """(key, ``n``, ``front``, ``back``, ``terms``): one card per sentence with something to blank.

    ``numbered`` marks blanks as ``{{cN::term}}``. With a frequency table
    (``word``, ``zipf``), rare words fill up the terms.
    """
    rows = docs.select(key, F.col(note).alias("_note") if note else F.lit(None).cast("string").alias("_note"), F.posexplode(sentences(F.col(text))).alias("n", "_s"))
    if frequencies is not None:
        rows = rows.join(rare_words(rows, frequencies, [key, "n"], "_s", most=most), [key, "n"], "left")
    rows = rows.withColumn("terms", cloze_candidates(F.col("_s"), F.col("rare") if frequencies is not None else None, most)).filter(F.size("terms") > 0)
    mark = (lambda t, i: F.concat(F.lit("{{c"), i.cast("string"), F.lit("::"), t, F.lit("}}"))) if numbered else (lambda t, i: F.lit("_____"))
    numbered_terms = F.transform("terms", lambda t, i: F.struct(t.alias("t"), (i + 1).alias("i")))
    front = F.aggregate(numbered_terms, F.col("_s"), lambda a, x: blanked(a, x["t"], mark(x["t"], x["i"])))
    back = F.concat_ws("\n", "_s", F.when(F.trim(F.coalesce("_note", F.lit(""))) != "", F.col("_note")))
    return rows.withColumn("front", front).filter(F.col("front") != F.col("_s")).select(key, "n", "front", back.alias("back"), "terms")


_GAP = re.compile(r"(?<=[.!?…])\s+(?=[A-Z\"“‘(])|(?<=[.!?…])\s*\n|\n{2,}")


def sentence_links(parts: list[str], threshold: float, cells: int = 1 << 22) -> list[np.ndarray]:
    """Rows of the matrix of linked sentences, in blocks of about ``cells`` cells; blocks of large matrices are packed bits.

    Similarities are products of dense blocks over the words that a block shares
    with other sentences; a word of one sentence links it to itself alone.
    """
    n = len(parts)
    numbers: dict[str, int] = {}
    words = [np.array([numbers.setdefault(w, len(numbers)) for w in re.findall(r"\w+", s.lower())], np.int64) for s in parts]
    row = np.repeat(np.arange(n), [len(w) for w in words])
    place, count = np.unique(row * max(1, len(numbers)) + np.concatenate(words), return_counts=True)
    row, word = np.divmod(place, max(1, len(numbers)))
    seen = np.bincount(word, minlength=len(numbers))
    value = count * (np.log(n / seen[word]) + 1.0)
    value /= np.sqrt(np.bincount(row, value**2, minlength=n))[row]
    shared = seen[word] > 1
    row, word, value = row[shared], word[shared], value[shared]
    block, found = max(1, min(n, cells // n)), []
    at = np.searchsorted(row, np.arange(0, n + block, block))
    filled = np.array([len(w) > 0 for w in words])
    column = np.full(len(numbers), -1)
    for i in range(len(at) - 1):
        here = slice(at[i], at[i + 1])
        mine, local = np.unique(word[here], return_inverse=True)
        column[mine] = np.arange(len(mine))
        height = min(block, n - i * block)
        left = np.zeros((height, len(mine)), np.float32)
        left[row[here] - i * block, local] = value[here]
        linked = np.zeros((height, n), bool)
        for j in range(len(at) - 1):
            there = slice(at[j], at[j + 1])
            known = column[word[there]] >= 0
            right = np.zeros((min(block, n - j * block), len(mine)), np.float32)
            right[row[there][known] - j * block, column[word[there][known]]] = value[there][known]
            linked[:, j * block : j * block + len(right)] = left @ right.T >= threshold
        column[mine] = -1
        own = np.arange(height)
        linked[own, own + i * block] = filled[own + i * block]
        found.append(linked if n * n <= cells else np.packbits(linked, axis=1))
    return found


def lexrank(parts: list[str], threshold: float = 0.1, damping: float = 0.85, rounds: int = 100) -> np.ndarray:
    """Centrality of sentences: a random walk over pairs whose tf-idf vectors are alike (Erkan and Radev, 2004)."""
    n = len(parts)
    if not n:
        return np.empty(0)
    blocks = sentence_links(parts, threshold)
    whole = lambda b: b if b.dtype == bool else np.unpackbits(b, axis=1, count=n)
    if len(blocks) == 1:
        blocks = [whole(blocks[0]).astype(np.float64)]
        whole = lambda b: b
    degree = np.maximum(1, np.concatenate([whole(b).sum(axis=1) for b in blocks]))
    score = np.full(n, 1.0 / n)
    for _ in range(rounds):
        share = score / degree
        new = (1 - damping) / n + damping * np.concatenate([whole(b) @ share for b in blocks])
        new /= new.sum()
        done = np.abs(new - score).max() < 1e-9
        score = new
        if done:
            break
    return score


def summarize(docs: DataFrame, *, n: int = 7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ``summary``): the ``n`` most central sentences of each document, in document order."""
    n = max(1, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1).to_pylist():
                parts = [s.strip() for s in _GAP.split(value or "") if s.strip()]
                score = lexrank(parts) if parts else np.empty(0)
                best = sorted(np.lexsort((np.arange(len(parts)), -np.round(score, 9)))[:n])
                out.append(" ".join(parts[i] for i in best))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, "summary"])

    rows = docs.select(key, text)
    return rows.mapInArrow(run, rows.select(key).schema.add("summary", "string"))


#: Words of a window that is compared word by word, and of its part whose matches are kept.
WINDOW, KEPT = 768, 512
#: Anchors are sought in runs of so many words, one after the other.
ANCHOR_RUNS = (1, 2, 4)


def _rising(values: np.ndarray) -> np.ndarray:
    """Places of a longest strictly rising subsequence; of several, one that keeps to the front, sought from the end."""
    values = -values[::-1]
    tails: list[int] = []
    ends: list[int] = []
    before = np.full(len(values), -1)
    for i, v in enumerate(values.tolist()):
        at = bisect_left(tails, v)
        before[i] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[at], ends[at] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return len(values) - 1 - np.array(out, np.int64)


def anchors(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words, or else of short runs, that stand once on either side, in an order both sides share."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    for n in ANCHOR_RUNS:
        if min(len(a), len(b)) < n:
            return none
        # a run is numbered by its first half and its second
        both = np.concatenate([a, b]) if n == 1 else np.concatenate([x[: len(x) - n // 2] * (int(runs.max()) + 1) + x[n // 2 :] for x in (runs[:cut], runs[cut:])])
        runs = np.unique(both, return_inverse=True)[1]
        cut = len(a) - n + 1
        once = (np.bincount(runs[:cut], minlength=runs.max() + 1) == 1) & (np.bincount(runs[cut:], minlength=runs.max() + 1) == 1)
        if once.any():
            in_b = np.zeros(len(once), np.int64)
            in_b[runs[cut:]] = np.arange(len(runs) - cut)
            at_a = np.flatnonzero(once[runs[:cut]])
            at_b = in_b[runs[at_a]]
            keep = _rising(at_b)
            return at_a[keep], at_b[keep]
    return none


def common_words(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Matched places of two short stretches: a longest common subsequence, as far in front as it can be.

    A matched word moves to the next one's side where an equal word stands
    there, so that matches lie in runs.
    """
    best = np.zeros((len(a) + 1, len(b) + 1), np.int16)
    for i, word in enumerate(a):
        np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + (b == word)), out=best[i + 1, 1:])
    i, j, found = len(a), len(b), []
    while i and j:
        here = best[i, j]
        if best[i, j - 1] == here:
            j -= 1
        elif best[i - 1, j] == here:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.append((i, j))
    for n in range(1, len(found)):  # from the end
        (i, j), (p, q) = found[n - 1], found[n]
        if p == i - 1 and b[j - 1] == a[p]:
            found[n] = p, j - 1
        elif q == j - 1 and a[i - 1] == b[q]:
            found[n] = i - 1, q
    return found[::-1]


def _between(a: np.ndarray, b: np.ndarray, pad: int) -> list[tuple[int, int]]:
    """Matched places of stretches without anchors, window by window.

    Each window begins where the last kept match ended; where one has no word in
    common, both sides move on by half of it.
    """
    found, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        last = i + WINDOW >= len(a) and j + WINDOW + pad >= len(b)
        pairs = common_words(a[i : i + WINDOW], b[j : j + WINDOW + pad])
        kept = pairs if last else [p for p in pairs if p[0] < KEPT]
        found += [(i + p, j + q) for p, q in kept]
        if last:
            break
        i, j = (i + kept[-1][0] + 1, j + kept[-1][1] + 1) if kept else (i + WINDOW // 2, j + WINDOW // 2)
    return found


def matched_places(spoken: list[str], shown: list[str], pad: int = 256) -> list[int | None]:
    """For each spoken word the place of the shown word it was matched with, if any.

    What both sides begin and end with is matched first. In what is left, words
    that stand once on either side are anchors, if they come in an order both
    sides share (the longest such order); matches grow from anchors while words
    are equal, and the stretches between are treated alike. Where no
    word or short run is alone, windows are compared word by word. Time grows with
    the words, whatever repeats.
    """
    number: dict[str, int] = {}
    a, b = (np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in (spoken, shown))
    return [None if f < 0 else f for f in matched_numbers(a, b, pad).tolist()]


def matched_numbers(a: np.ndarray, b: np.ndarray, pad: int = 256) -> np.ndarray:
    """``matched_places`` of words that are numbered; -1 where there is none."""
    found = np.full(len(a), -1, np.int64)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        n = min(a1 - a0, b1 - b0)
        differ = np.flatnonzero(a[a0 : a0 + n] != b[b0 : b0 + n])
        same = int(differ[0]) if len(differ) else n
        found[a0 : a0 + same] = np.arange(b0, b0 + same)
        a0, b0, n = a0 + same, b0 + same, n - same
        differ = np.flatnonzero(a[a1 - n : a1][::-1] != b[b1 - n : b1][::-1])
        same = int(differ[0]) if len(differ) else n
        found[a1 - same : a1] = np.arange(b1 - same, b1)
        a1, b1 = a1 - same, b1 - same
        if a0 == a1 or b0 == b1:
            continue
        at_a, at_b = anchors(a[a0:a1], b[b0:b1])
        if not len(at_a):
            for i, j in _between(a[a0:a1], b[b0:b1], pad):
                found[a0 + i] = b0 + j
            continue
        at_a, at_b = at_a + a0, at_b + b0
        found[at_a] = at_b
        starts, ends = np.append(at_a + 1, a1), np.append(at_b + 1, b1)
        todo += [(x, y, u, v) for x, y, u, v in zip([a0, *starts[:-1]], [*at_a, a1], [b0, *ends[:-1]], [*at_b, b1], strict=True) if x < y and u < v]
    return found


def filled_places(found: list[int | None]) -> list[int]:
    """Words without a match take the next one's place, at the end the last one's, else 0."""
    out, ahead = [0] * len(found), None
    tail = max((f for f in found if f is not None), default=0)
    for i in range(len(found) - 1, -1, -1):
        ahead = found[i] if found[i] is not None else ahead
        out[i] = tail if ahead is None else ahead
    return out


def filled_numbers(found: np.ndarray) -> np.ndarray:
    """``filled_places`` of an array with -1 where there is no match."""
    if not len(found):
        return found
    at = np.where(found >= 0, np.arange(len(found)), len(found))
    ahead = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(found, max(0, int(found.max())))[ahead]


def align_tokens(docs: DataFrame, *, key: str = "doc_id", spoken: str = "spoken", rendered: str = "rendered", word: str = r"\S+", fold: bool = False) -> DataFrame:
    """(key, ``idx``, ``offset``): for each spoken word the place of the rendered word it stands for.

    ``word`` is the pattern of a word; with ``fold`` words are compared in lower
    case. Documents whose word lists are equal are matched by position in the
    JVM; only the others go to Python.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c) if fold else c, F.lit(word), F.lit(0))
    rows = docs.select(key, words(F.coalesce(F.col(spoken), F.lit(""))).alias("_a"), words(F.coalesce(F.col(rendered), F.lit(""))).alias("_b"))
    same = rows.filter(F.col("_a") == F.col("_b")).select(key, F.posexplode("_a").alias("idx", "_")).select(key, "idx", F.col("idx").alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                k, a, b = (batch.column(c)[i] for c in range(3))
                n, words = len(a.values), pa.concat_arrays([a.values, b.values]).dictionary_encode().indices.to_numpy().astype(np.int64)
                places = filled_numbers(matched_numbers(words[:n], words[n:]))
                yield pa.RecordBatch.from_arrays([pa.repeat(k, n), pa.array(np.arange(n, dtype=np.int32)), pa.array(places.astype(np.int32))], [key, "idx", "offset"])

    other = rows.filter(F.col("_a") != F.col("_b"))
    return same.unionByName(other.mapInArrow(run, other.select(key).schema.add("idx", "integer").add("offset", "integer")))
