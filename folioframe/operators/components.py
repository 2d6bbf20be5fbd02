"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.session import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (``node``, ``component``): the smallest node that each node reaches.

    Alternates the large-star and small-star steps (Kiveris et al., 2014),
    which turn every component into a star around its smallest node in a
    number of rounds that grows with the logarithm of its size. Minima are
    pre-aggregated before each shuffle, and each round is written to the
    shared folder, so lineage stays short. Null ends and loops are ignored;
    nodes without an edge to another node do not appear.
    """
    now = materialize(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter(f"{src} is not null and {dst} is not null and {src} <> {dst}").distinct(),
        "components",
    )
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)), F.lit(0)).alias("h"))
    seen = now.agg(mark.alias("m")).first()["m"]
    while seen["n"]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        now = materialize(small, "components")
        last, seen = seen, now.agg(mark.alias("m")).first()["m"]
        if last == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
