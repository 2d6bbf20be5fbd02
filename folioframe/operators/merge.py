"""Merging replicas and snapshots with explicit policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Types whose values count as progress; a boolean does not.
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def refresh_index(old: DataFrame, new: DataFrame, *, key: str = "path", mark: tuple[str, ...] = ("size", "mtime"), text: str = "text") -> DataFrame:
    """The next snapshot with each row's action.

    ``new`` holds the current files; its text is null where extraction failed.
    Unchanged rows are reused, changed and new ones extracted, missing ones
    dropped (listed with a null text); a failed extraction keeps the old row
    (``stale``) or, without one, is listed as ``failed``.
    """
    a, b = old.alias("a"), new.alias("b")
    same = None
    for m in mark:
        c = F.col(f"a.{m}").eqNullSafe(F.col(f"b.{m}"))
        same = c if same is None else same & c
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    has_old, has_new = F.col(f"a.{key}").isNotNull(), F.col(f"b.{key}").isNotNull()
    fresh = F.col(f"b.{text}").isNotNull()
    action = F.when(~has_new, "drop").when(has_old & same, "reuse").when(fresh, "extract").when(has_old, "stale").otherwise("failed")
    old_side = F.col("_action").isin("reuse", "stale")
    pick = lambda c: F.when(old_side, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    kept = F.when(F.col("_action").isin("drop", "failed"), None).otherwise(pick(text))
    return joined.withColumn("_action", action).select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), *(pick(m).alias(m) for m in mark), kept.alias(text), F.col("_action").alias("action"))


def _newer(a: str, b: str, prefer: str) -> Column:
    """The remote side wins: by later ts, a missing one losing; by preference on a tie."""
    x, y = F.coalesce(F.col(f"{a}.ts").cast("string"), F.lit("")), F.coalesce(F.col(f"{b}.ts").cast("string"), F.lit(""))
    return (y > x) | ((y == x) & F.lit(prefer == "remote"))


def _progress(side: str, columns: list[str], types: dict[str, str]) -> Column:
    """Offset, else percentage, else -1."""
    found = [F.col(f"{side}.{c}").cast("double") for c in ("offset", "pct") if c in columns and types[c] in NUMERIC]
    return F.coalesce(*found, F.lit(-1.0))


def merge_progress(local: DataFrame, remote: DataFrame, *, key: str | list[str] = "key", policy: str = "newest", prefer: str = "remote") -> DataFrame:
    """Both replicas' rows with the winner per key and how the conflict was resolved.

    ``policy`` is ``newest``, ``highest_progress`` or ``manual``; any other
    counts as ``newest``. ``resolution`` is null where there was no conflict,
    else ``local``, ``remote`` or ``unresolved``.
    """
    keys = [key] if isinstance(key, str) else key
    values = [c for c in local.columns if c not in keys]
    types = dict(local.dtypes)
    a, b = local.withColumn("_in", F.lit(True)).alias("a"), remote.withColumn("_in", F.lit(True)).alias("b")
    on = None
    for k in keys:
        c = F.col(f"a.{k}") == F.col(f"b.{k}")
        on = c if on is None else on & c
    newer = _newer("a", "b", prefer)
    x, y = _progress("a", values, types), _progress("b", values, types)
    wins = {"highest_progress": F.when(y > x, True).when(y < x, False).otherwise(newer), "manual": F.lit(False)}.get(policy, newer)
    struct = lambda s: F.struct(*[F.col(f"{s}.{c}") for c in values])
    both = F.col("a._in").isNotNull() & F.col("b._in").isNotNull()
    conflict = both & ~struct("a").eqNullSafe(struct("b"))
    remote_side = F.col("a._in").isNull() | (conflict & wins)
    resolution = F.when(conflict, F.lit("unresolved") if policy == "manual" else F.when(wins, "remote").otherwise("local"))
    joined = a.join(b, on, "full_outer")
    return joined.select(
        *(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys),
        *(F.when(remote_side, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in values),
        resolution.alias("resolution"),
    )


def merge_meta(local: DataFrame, remote: DataFrame, *, key: str = "rel", prefer: str = "remote") -> DataFrame:
    """Statistics per relative path; the newest wins under every policy."""
    return merge_progress(local, remote, key=key, policy="newest", prefer=prefer)


def merge_notes(local: DataFrame, remote: DataFrame, *, prefer: str = "remote") -> DataFrame:
    """Notes of one or more documents merged by (``doc``, ``id``), with ``position`` for the order.

    Local rows come first, then ids that only the remote side has, then the
    remote rows without an id; rows without an id are kept from both sides.
    Against a local row the last remote duplicate is compared; a remote-only
    id keeps its first.
    """
    values = [c for c in local.columns if c not in ("doc", "id", "pos")]
    named = remote.filter("id is not null")
    first, last = Window.partitionBy("doc", "id").orderBy("pos"), Window.partitionBy("doc", "id").orderBy(F.desc("pos"))
    r = named.withColumn("_first", F.row_number().over(first)).withColumn("_last", F.row_number().over(last))
    a, b = local.filter("id is not null").alias("a"), r.filter("_last = 1").alias("b")
    joined = a.join(b, (F.col("a.doc") == F.col("b.doc")) & (F.col("a.id") == F.col("b.id")), "left")
    struct = lambda s: F.struct(*[F.col(f"{s}.{c}") for c in values])
    wins = F.col("b.id").isNotNull() & ~struct("a").eqNullSafe(struct("b")) & _newer("a", "b", prefer)
    kept = joined.select(F.col("a.doc").alias("doc"), F.col("a.id").alias("id"), *(F.when(wins, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in values), F.struct(F.lit(0).alias("part"), F.col("a.pos").alias("pos")).alias("position"))
    only = r.filter("_first = 1").join(local.select("doc", "id"), ["doc", "id"], "left_anti")
    at = lambda part: F.struct(F.lit(part).alias("part"), F.col("pos").alias("pos")).alias("position")
    return (
        kept.unionByName(only.select("doc", "id", *values, at(1)))
        .unionByName(local.filter("id is null").select("doc", "id", *values, at(0)))
        .unionByName(remote.filter("id is null").select("doc", "id", *values, at(2)))
    )


def conflict_report(merged: DataFrame) -> DataFrame:
    """How conflicts were resolved, counted."""
    return merged.filter("resolution is not null").groupBy("resolution").agg(F.count(F.lit(1)).alias("conflicts"))


def upsert_citations(old: DataFrame, new: DataFrame, *, key: str = "id") -> DataFrame:
    """Incoming fields overwrite, absent ones survive; rows without an id are appended."""
    values = [c for c in old.columns if c != key]
    a, b = old.filter(F.col(key).isNotNull()).alias("a"), new.filter(F.col(key).isNotNull()).alias("b")
    merged = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *(F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in values))
    return merged.unionByName(old.filter(F.col(key).isNull())).unionByName(new.filter(F.col(key).isNull()), allowMissingColumns=True)
