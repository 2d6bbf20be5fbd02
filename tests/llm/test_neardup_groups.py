"""Groups of the near-duplicate join around large components."""

from pyspark.sql import functions as F

from folioframe.llm import neardup
from folioframe.llm.neardup import second_groups


def test_few_classes_beside_a_large_component_make_few_rows(spark):
    """Rows grow with a node's members, not with their square, and every pair of components meets."""
    node = spark.range(4100).select(F.lit(1).cast("long").alias("node"), F.lit(4100).cast("long").alias("count"), F.lit(0).cast("long").alias("first"), F.col("id").alias("class_id"), F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).cast("long").alias("component"))
    rows = second_groups(node, 256).collect()
    assert len(rows) < 3 * 4100, len(rows)
    groups = {}
    for r in rows:
        groups.setdefault((r.p, r.q), ([], []))[r.side].append(r.class_id)
    met = set()
    for (p, q), (a, b) in groups.items():
        met |= {(min(x, y), max(x, y)) for x in a for y in (a if p == q else b)}
    assert all((x, y) in met for x in range(4000) for y in range(4000, 4100))
    assert all((x, y) in met for x in range(4000, 4100) for y in range(x + 1, 4100))


def test_a_common_passage_costs_few_rows(spark, monkeypatch):
    """Hundreds of texts that share a passage, too unlike to be linked, meet once a tree instead of branching on."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"w{i}x{j}" for j in range(30))) for i in range(700)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(0, 700, 100)]
    made = []

    def written(df, name, **options):
        found = materialize(df, name, **options)
        if name in ("neardup-nodes", "neardup-large"):
            made.append(found.count())
        return found

    materialize = neardup.materialize
    monkeypatch.setattr(neardup, "materialize", written)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, words=3, similarity=0.85).collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i in got}
    assert sum(made) < 1.5 * neardup.TREES / 0.85 * len(rows), made
