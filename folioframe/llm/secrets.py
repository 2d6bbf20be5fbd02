"""Secret scans with multipart credential linking, in Spark expressions only.

Strong patterns (assigned secrets, access identifiers, long hex strings) are
always reported. Weak parts (login-like identifiers, high-entropy strings,
service endpoints) are common in clean text, so a weak part is reported only
when its complement stands within ``window`` code points of it in the same
text: an identifier or an endpoint needs a secret, and a weak secret needs an
identifier or an endpoint. The link is an interval join: the parts of a text
are placed in buckets of ``window`` code points, each part looks in the
buckets it covers and one on each side, and a semi-join on (row, bucket) with the
distance condition keeps a part once, whatever the number of its partners.

Every text is scanned once: spans are written to the shared folder with a number
for the row, and the join moves numbers and spans only. As a row is a scope of
its own, copies of one text are spread over as many keys.

Spans are code points, end exclusive. Positions come from the lengths of the
gaps and the matches, because Spark's expressions return matches without
offsets.

Defined cases: a null or empty text has no spans; rows with equal ids or equal
texts are scopes of their own and keep their spans; a null id stays null; texts
of any length are read whole; of overlapping spans of one kind the leftmost
counts; an empty table gives an empty result; extra columns, whatever their
names, are kept by ``redact`` and ignored by the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.session import materialize

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LOGIN = r"\b(?i:user(?:name)?|login|account|client_?id|access_?key_?id)\x20*[:=]\x20*[\"']?[A-Za-z0-9][A-Za-z0-9@._-]{2,}"
STRONG_LOOKING = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"\b(?i:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|ssh|jdbc:[a-z]+)://[^\x20\x09-\x0D\"'<>]+"

#: In the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "login", "opaque", "endpoint")
WINDOW = 200
CHUNK = 512
#: Spans that are cut out of a text at a time.
PART = 64
SPAN = "array<struct<start:long,kind:int,end:long>>"


def _spans(text: Column, matches: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """Spans of ``matches``, the results of ``pattern`` over ``text`` in order.

    Running positions are folded in chunks: an appending fold over all matches
    would copy the array once per match.
    """
    gaps = F.split(text, pattern, -1)
    flags = keep if keep is not None else F.transform(matches, lambda m: F.lit(True))
    steps = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("g"), matches.alias("m"), flags.alias("k")),
        lambda x: F.struct(F.length(x["g"]).cast("long").alias("g"), F.length(x["m"]).cast("long").alias("m"), x["k"].alias("k")),
    )
    pieces = lambda x: F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / F.lit(CHUNK)).cast("int") - 1), lambda c: F.slice(x, c * CHUNK + 1, F.lit(CHUNK)))
    #: the steps are bound to a name, so that they are made once and not once per chunk
    chunks = F.flatten(F.transform(F.array(steps), pieces))
    total = lambda chunk: F.aggregate(chunk, F.lit(0).cast("long"), lambda a, s: a + s["g"] + s["m"])
    empty = F.array().cast(SPAN)

    def inside(chunk: Column, base: Column) -> Column:
        return F.aggregate(
            chunk,
            F.struct(base.cast("long").alias("at"), empty.alias("out")),
            lambda a, s: F.struct(
                (a["at"] + s["g"] + s["m"]).alias("at"),
                F.concat(
                    a["out"],
                    F.when(s["k"], F.array(F.struct((a["at"] + s["g"]).alias("start"), F.lit(kind).alias("kind"), (a["at"] + s["g"] + s["m"]).alias("end")))).otherwise(empty),
                ).alias("out"),
            ),
            lambda a: a["out"],
        )

    placed = F.aggregate(
        chunks,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")),
        lambda a, c: F.struct((a["at"] + total(c)).alias("at"), F.concat(a["out"], F.array(inside(c, a["at"]))).alias("out")),
        lambda a: F.flatten(a["out"]),
    )
    return F.when(F.size(matches) > 0, placed).otherwise(empty)


def _digest(spans: Column) -> Column:
    """``kind:start:end`` of each span by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_assign``, ``_access``, ``_hex`` span arrays."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumns(
        {
            "_m0": F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(0)),
            "_m1": F.regexp_extract_all(t, F.lit(ACCESS), F.lit(0)),
            "_m2": F.regexp_extract_all(t, F.lit(HEX), F.lit(0)),
        }
    )
    #: a match whose value has under six characters is dropped, but has taken its place in the text
    long_enough = F.transform(F.col("_m0"), lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6)
    return found.withColumns(
        {
            "_assign": _spans(t, F.col("_m0"), ASSIGN, 0, long_enough),
            "_access": _spans(t, F.col("_m1"), ACCESS, 1),
            "_hex": _spans(t, F.col("_m2"), HEX, 2),
        }
    ).drop("_m0", "_m1", "_m2")


def weak_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_weak``: login-like, opaque and endpoint spans together."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumns(
        {
            "_m3": F.regexp_extract_all(t, F.lit(LOGIN), F.lit(0)),
            "_m4": F.regexp_extract_all(t, F.lit(STRONG_LOOKING), F.lit(0)),
            "_m5": F.when(t.contains("://"), F.regexp_extract_all(t, F.lit(ENDPOINT), F.lit(0))).otherwise(F.array().cast("array<string>")),
        }
    )
    every = F.concat(_spans(t, F.col("_m3"), LOGIN, 3), _spans(t, F.col("_m4"), STRONG_LOOKING, 4), _spans(t, F.col("_m5"), ENDPOINT, 5))
    return found.withColumn("_weak", every).drop("_m3", "_m4", "_m5")


def linked_spans(parts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Weak parts with a complement nearby: rows (``_key``, ``_linked``).

    ``parts`` has ``_key`` and ``_spans`` (all spans of a text).
    """
    rows = parts.select("_key", F.explode("_spans").alias("_s")).select(
        "_key",
        F.col("_s.start").alias("start"),
        F.col("_s.kind").alias("kind"),
        F.col("_s.end").alias("end"),
        F.element_at(F.array(*(F.lit(x) for x in ("secret", "name", "secret", "name", "secret", "place"))), F.col("_s.kind") + 1).alias("role"),
    )
    weak = rows.filter("kind >= 3").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / window) - 1, F.floor((F.col("end") - 1) / window) + 1)))
    #: a part is found by the buckets that it covers
    others = rows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / window), F.floor((F.col("end") - 1) / window))))
    a, b = weak.alias("a"), others.alias("b")
    near = (F.col("b.start") <= F.col("a.end") + window) & (F.col("a.start") <= F.col("b.end") + window)
    complement = ((F.col("a.role") == "secret") & (F.col("b.role") != "secret")) | ((F.col("a.role") != "secret") & (F.col("b.role") == "secret"))
    hit = a.join(b, (F.col("a._key") == F.col("b._key")) & (F.col("a.bucket") == F.col("b.bucket")) & near & complement, "left_semi")
    return hit.groupBy("_key").agg(F.collect_set(F.struct("start", "kind", "end")).cast(SPAN).alias("_linked"))


def _scanned(docs: DataFrame, text: str, window: int, keep: list[str]) -> DataFrame:
    """(``_row``, ``_base``, ``_all``): the columns ``keep`` as one struct, strong spans, and all with the linked weak ones.

    Rows without weak parts stay where they are; only the others meet the links.
    """
    found = weak_spans(base_spans(docs.select(F.struct(*keep).alias("_row"), F.col(text).alias("_text")), "_text"), "_text")
    numbered = found.select(F.monotonically_increasing_id().alias("_key"), "_row", F.concat("_assign", "_access", "_hex").alias("_base"), "_weak")
    rows = materialize(numbered, "secrets-spans")
    weak = rows.filter(F.size("_weak") > 0)
    linked = linked_spans(weak.select("_key", F.concat("_base", "_weak").alias("_spans")), window)
    met = weak.join(linked, "_key", "left").select("_row", "_base", F.concat("_base", F.coalesce("_linked", F.array().cast(SPAN))).alias("_all"))
    return met.unionByName(rows.filter(F.size("_weak") == 0).select("_row", "_base", F.col("_base").alias("_all")))


def scan_secrets(docs: DataFrame, *, text: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``base_spans`` and ``all_spans`` arrays."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("base_spans", "all_spans")]
    found = _scanned(docs, text, window, keep)
    return found.select("_row.*", F.array_sort("_base").alias("base_spans"), F.array_sort("_all").alias("all_spans"))


def without_spans(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with each run of overlapping or touching ``spans`` (sorted) replaced by ``mark``.

    A part of the spans is cut from its own stretch of the text, so a long text
    is walked once a part, not once a span.
    """
    n_parts = F.ceil(F.size(spans) / F.lit(PART)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n_parts - 1), lambda c: F.slice(spans, c * PART + 1, F.lit(PART)))
    begun = lambda at: F.greatest(at, F.lit(0).cast("long"))
    cut = lambda t, a, b: F.substring(t, (a + 1).cast("int"), F.greatest(b - a, F.lit(0).cast("long")).cast("int"))

    def woven(stretch: Column, part: Column, at: Column) -> Column:
        """What a part leaves of its stretch, which begins at ``at``."""
        return F.aggregate(
            part,
            F.struct(at.alias("at"), F.lit("").alias("out")),
            lambda a, s: F.struct(
                F.greatest(a["at"], s["end"]).alias("at"),
                F.concat(a["out"], cut(stretch, begun(a["at"]) - begun(at), s["start"] - begun(at)), F.when(s["start"] > a["at"], mark).otherwise("")).alias("out"),
            ),
            lambda a: a["out"],
        )

    def step(a: Column, part: Column) -> Column:
        last = F.greatest(a["at"], F.array_max(F.transform(part, lambda s: s["end"])))
        stretch = F.transform(F.array(cut(text, begun(a["at"]), last)), lambda t: woven(t, part, a["at"]))
        return F.struct(last.alias("at"), F.concat(a["out"], stretch).alias("out"))

    start = F.struct(F.lit(-1).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(parts, start, step, lambda a: F.concat(F.array_join(a["out"], ""), cut(text, begun(a["at"]), F.length(text).cast("long"))))


def redact(docs: DataFrame, *, text: str = "text", length: str | None = None, mark: str = "[secret]", window: int = WINDOW) -> DataFrame:
    """``docs`` with every span of its text replaced; rows with clean texts are unchanged.

    ``length`` names a column that holds the text's length in code points.
    """
    found = _scanned(docs, text, window, docs.columns).withColumn("_all", F.array_sort("_all"))
    old = F.col("_row").getField(text)
    dirty = F.size("_all") > 0
    found = found.withColumn("_new", F.when(dirty, without_spans(old, F.col("_all"), mark)).otherwise(old))
    changed = {text: F.col("_new")}
    if length is not None:
        changed[length] = F.when(dirty, F.length("_new").cast(docs.schema[length].dataType)).otherwise(F.col("_row").getField(length))
    return found.select(*(changed.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns))


def op6_scan_secrets(spark, sf_dir):
    """The secrets of every whole document, as counts and span digests."""
    from folioframe.session import table

    found = scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_digest(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        _digest(F.col("all_spans")).alias("spans"),
    )
