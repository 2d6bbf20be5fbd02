"""The library listing: joins of catalog, progress and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def library_entries(library: DataFrame, positions: DataFrame, stats: DataFrame) -> DataFrame:
    """Library rows with progress: the position's percentage, else the statistics', else 0."""
    p = positions.select("path", F.col("pct").alias("_pct"))
    s = stats.select("path", F.col("pct").alias("_stat"), "seconds")
    out = library.join(p, "path", "left").join(s, "path", "left")
    return out.withColumn("pct", F.coalesce("_pct", "_stat", F.lit(0))).withColumn("seconds", F.coalesce("seconds", F.lit(0.0))).drop("_pct", "_stat")


def combined_listing(folder_files: DataFrame, recents: DataFrame, synced: DataFrame) -> DataFrame:
    """Folder files first, a synced percentage before the local one; then recents outside all folders."""
    s = synced.select("path", F.col("pct").alias("_synced"))
    files = folder_files.join(s, "path", "left").select("path", "title", F.coalesce("_synced", "pct").alias("pct"), F.lit("folder").alias("source"), F.lit(0).alias("part"))
    rest = recents.join(folder_files.select("path"), "path", "left_anti").select("path", "title", "pct", F.lit("recent").alias("source"), F.lit(1).alias("part"))
    return files.unionByName(rest)


def owning_folder(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """Each path with the deepest folder that contains it, and the rest of the path.

    A path is split into its parent prefixes, so this is an equi-join and the
    folders need not fit anywhere.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = paths.select("path", F.explode(prefixes).alias("folder"))
    owned = up.join(folders.select(F.regexp_replace("folder", "/+$", "").alias("folder")).distinct(), "folder")
    deepest = owned.groupBy("path").agg(F.max_by("folder", F.length("folder")).alias("folder"))
    return deepest.withColumn("rel", F.substring("path", F.length("folder") + 2, F.length("path")))


def progress_lookup(paths: DataFrame, folders: DataFrame, progress: DataFrame) -> DataFrame:
    """Progress found by (folder name, relative path), so it survives another mount point."""
    owned = owning_folder(paths, folders).withColumn("name", F.element_at(F.split("folder", "/"), -1))
    return owned.join(progress.withColumnRenamed("folder", "name"), ["name", "rel"], "left")


def keep_newest(rows: DataFrame, *, by: str = "ts", tie: str = "path", cap: int = 500, drop: int = 100) -> DataFrame:
    """All rows up to ``cap``; beyond it, the oldest ``drop`` (or more, down to the cap) go.

    The limit is a distributed top-k: tasks keep their newest rows first.
    """
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    ranked = rows.orderBy(F.desc(by), tie)
    #: the count decides how many stay, at most ``cap``
    total = n.first()["_n"]
    return rows if total <= cap else ranked.limit(max(0, min(cap, total - drop)))


def recent_list(opens: DataFrame, *, cap: int = 20) -> DataFrame:
    """Paths by their first opening, newest first; opening again does not move a path."""
    return opens.groupBy("path").agg(F.min("ts").alias("first_opened")).orderBy(F.desc("first_opened"), "path").limit(cap)


def reading_totals(stats: DataFrame) -> DataFrame:
    """One row: seconds, words and documents read."""
    return stats.agg(F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), F.coalesce(F.sum("words_read"), F.lit(0)).alias("words"), F.count(F.lit(1)).alias("documents"))


def most_read(stats: DataFrame, *, n: int = 10, width: int = 49) -> DataFrame:
    """The ``n`` documents read longest, long titles cut and marked."""
    title = F.when(F.length("title") > width, F.concat(F.substring("title", 1, width - 1), F.lit("…"))).otherwise(F.col("title"))
    return stats.orderBy(F.desc("seconds"), "path").limit(n).select("path", title.alias("title"), "seconds")


def portable_meta(stats: DataFrame, notes: DataFrame) -> DataFrame:
    """Statistics and note counts that travel with a document; rows with neither are left out."""
    counted = notes.groupBy(F.col("doc").alias("path")).agg(F.count(F.lit(1)).alias("annotations"))
    both = stats.join(counted, "path", "full_outer")
    return both.withColumn("annotations", F.coalesce("annotations", F.lit(0))).filter("seconds is not null or annotations > 0")


def bookmarks_in_order(rows: DataFrame, key: str = "doc", by: str = "char_pos") -> DataFrame:
    """Rows sorted inside their document, without a global sort."""
    return rows.repartition(key).sortWithinPartitions(key, by)


def unique_catalog(catalog: DataFrame, order: str = "folder_order") -> DataFrame:
    """One row per path: the first folder that lists it wins."""
    return catalog.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(order))).filter("_n = 1").drop("_n")
