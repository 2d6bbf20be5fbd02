"""Mixing sources to target weights by systematic sampling.

Sources get shares of the corpus in proportion to their weights, but never
more than ``max_repeat`` times their own size; what a capped source cannot
take is shared among the others. Within a source every document expects
``target / source_size`` copies. The expectations are prefix-summed in a fixed
order, one random offset is added per source, and a document is emitted once
for each integer that its stretch of the sum crosses.

The order within a source is by size class, then salt, then size, so that
copies are spread evenly over document sizes and the words taken stay close to
the target. The prefix sum is two-level: row numbers inside (source, class,
salt) groups, and offsets from the groups' row counts, so no task ever sees a
whole source.

Defined cases: null or blank text has size 0 and takes 0 words; the null
source is a source of its own, last in order; rows with equal ids are separate
rows; a source without words has target 0; an empty table gives an empty
result. Columns of the input are kept, but those named ``size``,
``source_size``, ``target``, ``copies`` or ``taken`` give way to the results
(``mixed_rows`` keeps every column); helper columns start with ``_mix_`` and are
dropped. The water-filling sorts one row per source in one task; sources are
names of collections, not hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.words import n_words

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SALTS = 64


def _unit(key: Column) -> Column:
    """A number in [0, 1) with 16 bits, from a text key."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 4), 16, 10).cast("double") / 65536.0


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Water-filling over one row per source (``_mix_null``, ``_mix_source``, ``source_size``).

    A source is capped if, sharing what is left after the more constrained
    ones, it would exceed its cap. The windows run over one row per source.
    """
    order = Window.orderBy("_mix_null", "_mix_source")
    tight = Window.orderBy("_mix_ratio", "_mix_null", "_mix_source")
    before, onward = tight.rowsBetween(Window.unboundedPreceding, -1), tight.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    cap = F.col("source_size") * max_repeat
    return (
        sizes.withColumn("_mix_rank", F.row_number().over(order) - 1)
        .withColumn("_mix_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_mix_rank") % len(weights) + 1).cast("int")))
        .withColumn("_mix_ratio", cap.cast("double") / F.col("_mix_weight"))
        .withColumn("_mix_left", F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("_mix_rate", F.col("_mix_left").cast("double") / F.sum("_mix_weight").over(onward))
        .withColumn("_mix_capped", F.col("_mix_rate") >= F.col("_mix_ratio"))
        .withColumn("_mix_level", F.max(F.when(~F.col("_mix_capped"), F.col("_mix_rate"))).over(everything))
        .withColumn("target", F.when(F.col("_mix_capped"), cap.cast("double")).otherwise(F.col("_mix_level") * F.col("_mix_weight")))
        .select("_mix_null", "_mix_source", "source_size", "target")
    )


def mix_sources(
    docs: DataFrame,
    *,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    salts: int = SALTS,
    seed: int = 0,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``."""
    keep = docs.columns if keep is None else keep
    clash = {"size", "source_size", "target", "copies", "taken"}
    size = n_words(F.col(text))
    top = F.rpad(F.substring(F.bin("_mix_size"), 1, 5), 5, "0")
    key = ["_mix_null", "_mix_source", "_mix_class", "_mix_salt"]
    kept = [c for c in keep if c not in clash]
    rows = (
        docs.select(*(F.col(c) for c in kept), size.alias("_mix_size"), F.col(doc_id).alias("_mix_id"), F.col(source).isNull().alias("_mix_null"), F.coalesce(F.col(source), F.lit("")).alias("_mix_source"))
        .withColumn("_mix_class", F.length(F.bin("_mix_size")) * 32 + F.conv(top, 2, 10).cast("int"))
        .withColumn("_mix_salt", F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col("_mix_id").cast("string"), F.lit("")).cast("binary")), 1, 4), 16, 10).cast("int"), F.lit(salts)))
    )
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_mix_n"), F.sum("_mix_size").alias("_mix_words"))
    targets = source_targets(groups.groupBy("_mix_null", "_mix_source").agg(F.sum("_mix_words").alias("source_size")), weights, max_repeat)
    ahead = Window.partitionBy("_mix_null", "_mix_source").orderBy("_mix_class", "_mix_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        groups.withColumn("_mix_start", F.coalesce(F.sum("_mix_n").over(ahead), F.lit(0)))
        .join(targets, ["_mix_null", "_mix_source"])
        .withColumn("_mix_per", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("_mix_u", _unit(F.concat(F.lit(f"{seed}:"), F.when(F.col("_mix_null"), "n").otherwise("s"), F.col("_mix_source"))))
        .select(*key, "_mix_start", "_mix_per", "_mix_u", "source_size", "target")
    )
    inside = Window.partitionBy(*key).orderBy("_mix_size", "_mix_id", *([F.xxhash64(*kept)] if kept else []))
    rank = F.col("_mix_start") + F.col("_mix_rank")
    crossed = F.floor(F.col("_mix_per") * rank + F.col("_mix_u")) - F.floor(F.col("_mix_per") * (rank - 1) + F.col("_mix_u"))
    return (
        rows.withColumn("_mix_rank", F.row_number().over(inside))
        .join(starts, key)
        .withColumn("copies", F.least(crossed.cast("long"), F.lit(max_repeat).cast("long")))
        .select(*kept, F.col("_mix_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("_mix_size")).alias("taken"))
    )


def mixed_rows(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: the rows of ``docs``, each repeated as often as it was drawn."""
    drawn = mix_sources(docs.select(*docs.columns, F.struct(*docs.columns).alias("_mix_row")), keep=["_mix_row"], **options)
    return drawn.filter("copies > 0").select("_mix_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_mix_copy")).select("_mix_row.*")


def op1_mix_sources(spark, sf_dir):
    """Every document of the corpus with its source's target and the words the mix takes."""
    from folioframe.session import table

    return mix_sources(table(spark, sf_dir, "documents"), keep=["doc_id"])


OP1_SQL = """
with d as (
  select doc_id, source is null as nul, coalesce(source, '') as src,
         cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size
  from documents),
k as (
  select *, length(bin(size)) * 32 + case when length(bin(size)) > 5 then size >> (length(bin(size)) - 5) else size << (5 - length(bin(size))) end as cls,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 4) as int) % 64 as salt
  from d),
s as (select nul, src, cast(sum(size) as bigint) as source_size from d group by all),
w as (select *, case (row_number() over (order by nul, src) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w from s),
l as (
  select *, 3 * source_size / cast(w as double) as ratio,
         sum(source_size) over () - coalesce(sum(3 * source_size) over (order by 3 * source_size / cast(w as double), nul, src rows between unbounded preceding and 1 preceding), 0) as rest,
         sum(w) over (order by 3 * source_size / cast(w as double), nul, src rows between current row and unbounded following) as tail
  from w),
c as (select *, cast(rest as double) / tail as rate, cast(rest as double) / tail >= ratio as capped from l),
t as (
  select nul, src, source_size,
         case when capped then cast(3 * source_size as double) else max(case when not capped then rate end) over () * w end as target
  from c),
r as (
  select k.*, source_size, target, row_number() over (partition by k.nul, k.src order by cls, salt, size, doc_id) as rank,
         case when source_size > 0 then target / source_size else 0.0 end as per,
         cast('0x' || substr(md5('0:' || case when k.nul then 'n' else 's' end || k.src), 1, 4) as int) / 65536.0::double as u
  from k join t on k.nul = t.nul and k.src = t.src)
select doc_id, size, source_size, target,
       cast(least(floor(per * rank + u) - floor(per * (rank - 1) + u), 3) as bigint) as copies,
       cast(least(floor(per * rank + u) - floor(per * (rank - 1) + u), 3) * size as bigint) as taken
from r
"""
